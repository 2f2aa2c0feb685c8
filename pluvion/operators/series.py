"""Operators on long hourly series: rows of (keys..., t, value), t the number of steps since 1970.

Stamps are step-ending: the row of step t holds what fell in (t - 1, t]. Windows are partitioned by the series' keys, so
many regions run side by side; a step may be an hour, a day or any other length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def epoch_day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def hour_ending(ts: Column) -> Column:
    """The step of a stamp: its hour, or the next one unless it is full."""
    past = (F.minute(ts) > 0) | (F.date_format(ts, "ss.SSSSSS") != "00.000000")
    return epoch_day(ts) * 24 + F.hour(ts) + F.when(past, 1).otherwise(0)


def dedup(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the last or first in the given order (max_by of whole rows, so it is combined map-side)."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in key])
    pick = F.max_by if keep == "last" else F.min_by
    got = df.groupBy(*key).agg(pick(row, F.struct(*order)).alias("_row"))
    return got.select(*key, "_row.*").select(*df.columns)


def to_steps(df: DataFrame, keys: Sequence[str], step: Column, value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Sub-step readings summed by step; a step whose readings are all null stays null."""
    return df.withColumn("t", step).groupBy(*keys, "t").agg(
        F.sum(value).alias(value), *[c.alias(n) for n, c in (extra or {}).items()]
    )


def clean_values(df: DataFrame, value: str, most: float, bias: float = 1.0) -> DataFrame:
    """value cleaned in this order: non-numbers and non-finite to null, negatives to 0, times bias, cut at `most`.

    is_imputed tells which were null; null is filled with 0.
    """
    number = F.expr(f"try_cast(`{value}` as double)")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    kept = F.least(F.greatest(finite, F.lit(0.0)) * bias, F.lit(float(most)))
    return df.withColumn("is_imputed", finite.isNull()).withColumn(value, F.coalesce(kept, F.lit(0.0)))


def spine(df: DataFrame, keys: Sequence[str], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """(keys, t) for every step from lo to hi, each series' own first and last by default."""
    lo = F.min("t") if lo is None else lo
    hi = F.max("t") if hi is None else hi
    spans = df.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    return spans.select(*keys, F.explode(F.sequence("lo", "hi")).alias("t"))


def fill_gaps(df: DataFrame, keys: Sequence[str], value: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Every step of the spine: absent ones get 0, is_imputed and source `missing`; unlabelled rows the modal source."""
    on = [*keys, "t"]
    modal = df.groupBy(*keys).agg(F.mode("source", True).alias("_modal")) if keys else df.agg(F.mode("source", True).alias("_modal"))
    joined = spine(df, keys, lo, hi).join(df.withColumn("_here", F.lit(True)), on, "left")
    joined = joined.join(modal, list(keys), "left") if keys else joined.join(F.broadcast(modal), how="left", on=F.lit(True))
    here = F.col("_here").isNotNull()
    return joined.select(
        *on,
        F.when(here, F.col(value)).otherwise(0.0).alias(value),
        F.when(here, F.coalesce("is_imputed", F.lit(False))).otherwise(True).alias("is_imputed"),
        F.when(here, F.coalesce("source", "_modal")).otherwise("missing").alias("source"),
    )


def blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with block_id: the first step of its run of consecutive steps."""
    order = Window.partitionBy(*keys).orderBy("t")
    island = F.col("t") - F.row_number().over(order)
    return df.withColumn("_island", island).withColumn("block_id", F.min("t").over(Window.partitionBy(*keys, "_island"))).drop("_island")


def block_spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block_id, first_t, last_t, n) of the runs of consecutive steps."""
    return blocks(df, keys).groupBy(*keys, "block_id").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")
    )


def blocks_holding(requests: DataFrame, record: DataFrame, keys: Sequence[str], width: int = 168) -> DataFrame:
    """requests(keys, t, ...) with block_id, first_t, last_t and place: the stored block of `record` that holds each stamp.

    place is `block`, or `gap` for a stamp between blocks and `outside` for one before, after or without any (the three are
    null then). Spans and stamps meet in buckets of `width` steps: a stamp takes the last span that begins in its bucket up
    to it, or else the last one of the buckets before, which a table of one row a bucket carries forward. Null stamps are
    outside; requests may repeat, and keep all their columns.
    """
    spans = block_spans(record, keys)
    names = [c for c in requests.columns if c not in keys]
    asked = requests.select(*keys, F.col("t").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    stamp = F.struct("block_id", "first_t", "last_t")
    begins = spans.select(*keys, F.col("first_t").alias("_at"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), stamp.alias("_span"), F.lit(0).alias("_kind"))
    stamps = asked.select("*", F.lit(None).cast(begins.schema["_span"].dataType).alias("_span"), F.lit(1).alias("_kind"))
    mixed = begins.unionByName(stamps).withColumn("_bucket", F.floor(F.col("_at") / width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = mixed.withColumn("_last", F.last("_span", True).over(inside))
    ends = mixed.groupBy(*keys, "_bucket").agg(F.max_by("_span", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.last("_end", True).over(before).alias("_carried"))
    last = spans.groupBy(*keys).agg(F.max("last_t").alias("_final")).select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], "_final")
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    whose = F.lit(True)
    for i, k in enumerate(keys):
        on, whose = on & F.col(k).eqNullSafe(F.col(f"_k{i}")), whose & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    span = F.coalesce("_last", "_carried")
    met = here.where("_kind = 1").join(carried, on, "left").join(last, whose, "left").withColumn("_s", span)
    held = F.col("_at").between(F.col("_s.first_t"), F.col("_s.last_t"))
    place = F.when(held, "block").when(F.col("_s").isNotNull() & (F.col("_at") < F.col("_final")), "gap").otherwise("outside")
    fields = [F.when(held, F.col(f"_s.{c}")).alias(c) for c in ("block_id", "first_t", "last_t")]
    return met.select(*keys, "_row.*", *fields, place.alias("place"))


def long_runs(df: DataFrame, keys: Sequence[str], flag: str, longer_than: int) -> DataFrame:
    """df with in_long_run: flagged rows in runs of more than `longer_than` rows; a gap in time ends a run."""
    order = Window.partitionBy(*keys).orderBy("t")
    start = F.when((F.lag(flag).over(order) == F.col(flag)) & (F.lag("t").over(order) == F.col("t") - 1), 0).otherwise(1)
    runs = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(order))
    n = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn("in_long_run", F.col(flag) & (n > longer_than)).drop("_start", "_run")


def rain_events(df: DataFrame, keys: Sequence[str], value: str, wet: float, max_gap: int) -> DataFrame:
    """Wet rows with event_id, from 1: a wet step opens one if more than max_gap dry steps lie since the last, by clock."""
    order = Window.partitionBy(*keys).orderBy("t")
    rows = df.where(F.col(value) > wet)
    opens = F.when(F.col("t") - F.lag("t").over(order) - 1 <= max_gap, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("event_id", F.sum("_opens").over(order)).drop("_opens")


def event_totals(events: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per event: first_t, last_t, wet_steps, total, peak and the first step of the peak."""
    return events.groupBy(*keys, "event_id").agg(
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.count("*").alias("wet_steps"),
        F.sum(value).alias("total"),
        F.max(value).alias("peak"),
        F.min_by("t", F.struct(-F.col(value), F.col("t"))).alias("peak_t"),
    )


def steps_of_events(totals: DataFrame, keys: Sequence[str], steps: DataFrame) -> DataFrame:
    """steps with event_id: the event whose first to last wet step holds t, dry steps between included, else -1."""
    inside = totals.select(*keys, "event_id", F.explode(F.sequence("first_t", "last_t")).alias("t"))
    return steps.join(inside, [*keys, "t"], "left").withColumn("event_id", F.coalesce("event_id", F.lit(-1)))


def trailing_sums(df: DataFrame, keys: Sequence[str], value: str, windows: Sequence[int], name: str = "sum_{w}") -> DataFrame:
    """Sums over (t - w, t], partial at the start; all windows share one sort."""
    over = lambda w: Window.partitionBy(*keys).orderBy("t").rangeBetween(-(w - 1), 0)
    return df.select("*", *[F.sum(value).over(over(w)).alias(name.format(w=w)) for w in windows])


def antecedent(df: DataFrame, keys: Sequence[str], value: str, window: int, name: str = "antecedent") -> DataFrame:
    """Sums over t - w to t - 1: the current step is left out."""
    over = Window.partitionBy(*keys).orderBy("t").rangeBetween(-window, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0.0)))


def excess_ramp(total: Column, threshold: float, ramp: float) -> Column:
    """How far a trailing sum lies above a threshold, from 0 to 1 over the ramp."""
    return F.least(F.greatest((total - threshold) / ramp, F.lit(0.0)), F.lit(1.0))


def capacity_factor(excess: Column, gate: Column, least: float) -> Column:
    """The share of capacity left: 1 - (1 - least) x excess x gate."""
    return 1 - (1 - F.lit(least)) * excess * gate


def break_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with breaks: how many steps so far did not follow the one before at once."""
    order = Window.partitionBy(*keys).orderBy("t")
    broken = F.when(F.col("t") - F.lag("t").over(order) == 1, 0).otherwise(1)
    return df.withColumn("_b", F.when(F.lag("t").over(order).isNull(), 0).otherwise(broken)).withColumn(
        "breaks", F.sum("_b").over(order)
    ).drop("_b")


def window_starts(
    df: DataFrame, keys: Sequence[str], value: str, length: int, lookback: int, stride: int, wet_total: float, split: Column
) -> DataFrame:
    """Training windows of `length` steps: (keys, t, total, is_wet, split).

    A window starts on the stride's grid, has its lookback and all its steps without a break, and lies in one split; the
    split is its last step's. Wet: total at or above wet_total less 1e-9.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    ahead = order.rowsBetween(0, length - 1)
    rows = break_counts(df, keys).withColumn("_split", split)
    seen = rows.select(
        "*",
        F.sum(value).over(ahead).alias("total"),
        F.lead("breaks", length - 1).over(order).alias("_end"),
        F.lag("breaks", lookback).over(order).alias("_begin"),
        F.lead("_split", length - 1).over(order).alias("split"),
    )
    whole = (F.col("_end") == F.col("_begin")) & (F.col("split") == F.col("_split")) & (F.col("t") % stride == 0)
    return seen.where(whole).select(*keys, "t", "total", (F.col("total") >= wet_total - 1e-9).alias("is_wet"), "split")


def seeded_keep(windows: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """Wet windows, and a share of the dry ones drawn by md5 of key, start and seed."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("t").cast("string"), F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    return windows.where(F.col("is_wet") | (draw < share))


def window_positives(labels: DataFrame, keys: Sequence[str], label: str, length: int, warmup: int) -> DataFrame:
    """Positives over the scored steps (warmup to the end) of the window that starts at each step."""
    ahead = Window.partitionBy(*keys).orderBy("t").rangeBetween(warmup, length - 1)
    return labels.withColumn("positives", F.coalesce(F.sum(label).over(ahead), F.lit(0)))


def block_window_totals(df: DataFrame, keys: Sequence[str], value: str, steps: int) -> DataFrame:
    """(keys, block_id, t, total) for every window of `steps` steps from t on that stays in a block."""
    rows = blocks(df, keys)
    ahead = Window.partitionBy(*keys, "block_id").orderBy("t").rowsBetween(0, steps - 1)
    full = F.count("*").over(ahead) == steps
    return rows.select(*keys, "block_id", "t", F.sum(value).over(ahead).alias("total"), full.alias("_full")).where("_full").drop("_full")


def fixed_block_max(df: DataFrame, keys: Sequence[str], value: str, steps: int) -> DataFrame:
    """The maximum of consecutive blocks of `steps` steps counted from each series' first step; the last may be short."""
    first = df.groupBy(*keys).agg(F.min("t").alias("_t0"))
    joined = df.join(first, list(keys)) if keys else df.join(F.broadcast(first), on=F.lit(True))
    block = F.floor((F.col("t") - F.col("_t0")) / steps)
    return joined.groupBy(*keys, block.alias("block")).agg(F.max(value).alias(value), F.min("t").alias("first_t"))


def separated_top(totals: DataFrame, k: int, separation: int) -> list:
    """The k windows of greatest total in turn, each at least `separation` steps from those chosen, while totals are positive.

    Greedy by nature: k passes, each a top-1 over what is left. Returns rows of totals.
    """
    chosen: list = []
    left = totals.where("total > 0")
    for _ in range(k):
        best = left.orderBy(F.desc("total"), "t").limit(1).collect()
        if not best:
            break
        chosen.append(best[0])
        left = left.where(F.abs(F.col("t") - best[0]["t"]) >= separation)
    return chosen


def yearly_summary(df: DataFrame, value: str, year: Column, steps_in_year: int) -> DataFrame:
    """(year, total, n, whole): totals per year; whole if it has at least 360/365 of its steps."""
    return df.groupBy(year.alias("year")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).withColumn(
        "whole", F.col("n") >= F.lit(steps_in_year) * 360 / 365
    )


def merge_by_priority(pieces: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several tables, for each (keys, t) that of the first table that has it."""
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(pieces)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return dedup(out, [*keys, "t"], ["_rank"], keep="first").drop("_rank")


def missing_steps(target: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps of target that `have` lacks."""
    return target.join(have, [*keys, "t"], "left_anti").select(*keys, "t")


def shrink_problem(stored: DataFrame, record: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: lost_steps and lost_observations that writing record over stored would cost."""
    on = [*keys, "t"]
    lost = missing_steps(stored, record, keys).agg(F.count("*").alias("lost_steps"))
    seen = stored.where("not is_imputed").join(record.where("not is_imputed"), on, "left_anti")
    return lost.join(F.broadcast(seen.agg(F.count("*").alias("lost_observations"))), on=F.lit(True))


def rescale_bias(df: DataFrame, value: str, old: float, new: float, most: float, observed: str) -> DataFrame:
    """Observed rows times new / old, cut at most; other sources stay."""
    scaled = F.least(F.col(value) * (new / old), F.lit(float(most)))
    return df.withColumn(value, F.when(F.col("source") == observed, scaled).otherwise(F.col(value)))


def source_mix(df: DataFrame) -> DataFrame:
    """One row: observed, synthetic and gap-filled steps, whether the first two mix, and the commonest trusted source."""
    filled = F.col("source") == "missing"
    synthetic = F.col("source") == "synthetic"
    return df.agg(
        F.count_if(~filled & ~synthetic).alias("observed"),
        F.count_if(synthetic).alias("synthetic"),
        F.count_if(filled).alias("gap_filled"),
        F.mode(F.when(~filled, F.col("source")), True).alias("main_source"),
    ).withColumn("mixed", (F.col("observed") > 0) & (F.col("synthetic") > 0))


def tiles(df: DataFrame, first: int, scored: int, warmup: int) -> DataFrame:
    """Target steps in windows of `scored` steps, each led in by `warmup` earlier ones: df with tile and is_scored."""
    own = F.floor((F.col("t") - first) / scored)
    later = F.floor((F.col("t") + warmup - first) / scored)
    return df.select("*", F.explode(F.sequence(own, later)).alias("tile")).withColumn("is_scored", F.col("tile") == own)


def dry_padding(df: DataFrame, lo: int, hi: int, value: str) -> DataFrame:
    """df with rows of 0 for the steps of lo to hi that lie before its first or after its last."""
    ends = df.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    all_steps = df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "t")
    pad = all_steps.join(F.broadcast(ends), on=F.lit(True)).where("t < _lo or t > _hi").select("t", F.lit(0.0).alias(value))
    return df.select("t", value).unionByName(pad)


def date_chunks(lo: int, hi: int, days: int, spark) -> DataFrame:
    """(first_day, last_day) of the spans of `days` days that cover lo to hi."""
    spans = spark.range(lo, hi + 1, days).withColumnRenamed("id", "first_day")
    return spans.withColumn("last_day", F.least(F.col("first_day") + days - 1, F.lit(hi)))
