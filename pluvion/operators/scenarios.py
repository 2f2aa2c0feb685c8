"""Rain scenarios: hours (t, mm, source, is_forecast, is_target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import block_spans, blocks, fill_gaps, rain_events


def design_storm(spark: SparkSession, total: float, duration: int, shape: str = "triangular", peak: float = 0.4, lead: int = 0, horizon: int | None = None) -> DataFrame:
    """(t, mm) of a storm from t = 1: hourly differences of a mass curve; what rounding leaves goes to the peak hour.

    chicago: intensity falls off from the peak with power 0.7 on both sides; triangular; uniform.
    """
    horizon = max(horizon or 0, lead + duration)
    hours = spark.range(1, horizon + 1).select(F.col("id").alias("t"))
    x = lambda t: F.least(F.greatest((t - lead) / duration, F.lit(0.0)), F.lit(1.0))

    def mass(f: Column) -> Column:
        if shape == "uniform":
            return f
        if shape == "triangular":
            return F.when(f <= peak, f * f / peak).otherwise(1 - F.pow(1 - f, F.lit(2)) / (1 - peak))
        if shape == "chicago":
            left = peak * (1 - F.pow(F.greatest(1 - f / peak, F.lit(0.0)), F.lit(0.3)))
            right = peak + (1 - peak) * F.pow(F.greatest((f - peak) / (1 - peak), F.lit(0.0)), F.lit(0.3))
            return F.when(f <= peak, left).otherwise(right)
        raise ValueError(f"unknown shape {shape!r}")

    raw = hours.withColumn("mm", F.round((mass(x(F.col("t").cast("double"))) - mass(x(F.col("t").cast("double") - 1))) * total, 4))
    ends = raw.agg(F.sum("mm").alias("_sum"), F.max_by("t", F.struct("mm", -F.col("t"))).alias("_peak"))
    joined = raw.join(F.broadcast(ends), on=F.lit(True))
    return joined.select("t", F.when(F.col("t") == F.col("_peak"), F.col("mm") + total - F.col("_sum")).otherwise(F.col("mm")).alias("mm"))


def block_containing(df: DataFrame, t: int) -> DataFrame:
    """One row: the stored block that holds step t; an error that names the blocks if none does."""
    spans = block_spans(df, [])
    got = spans.where((F.col("first_t") <= t) & (F.col("last_t") >= t))
    if got.isEmpty():
        known = [(r["first_t"], r["last_t"]) for r in spans.orderBy("first_t").limit(20).collect()]
        raise ValueError(f"step {t} is in none of the blocks {known}")
    return got


def replay(record: DataFrame, start: int, hours: int, history: int, wet: float, gap: int, most_back: int = 168) -> DataFrame:
    """History and target rows of the block that holds `start`, which moves back to its rain event's start (at most
    most_back steps); is_target and notes on truncation and gaps."""
    inside = blocks(record, [])
    block = block_containing(record, start).select(F.col("block_id").alias("_b"), F.col("last_t").alias("_last"))
    rows = inside.join(F.broadcast(block), F.col("block_id") == F.col("_b"))
    events = rain_events(rows, [], "mm", wet, gap).groupBy("event_id").agg(F.min("t").alias("_first"), F.max("t").alias("_end"))
    holding = events.where((F.col("_first") <= start) & (F.col("_end") >= start)).agg(F.min("_first").alias("_event"))
    marked = rows.join(F.broadcast(holding), on=F.lit(True))
    begin = F.greatest(F.coalesce("_event", F.lit(start)), F.lit(start - most_back))
    target = F.col("t").between(begin, begin + hours - 1)
    notes = F.filter(
        F.array(
            F.when(F.coalesce("_event", F.lit(start)) < start - most_back, "moved back as far as allowed"),
            F.when(begin + hours - 1 > F.col("_last"), "the block ends before the target"),
        ),
        lambda x: x.isNotNull(),
    )
    kept = marked.where((F.col("t") >= begin - history) & (F.col("t") <= begin + hours - 1))
    return kept.select("t", "mm", target.alias("is_target"), notes.alias("notes"))


def forecast_scenario(record: DataFrame, hours: int, history: int) -> DataFrame:
    """Recent steps as history; the first forecast step begins a target of at most `hours` steps."""
    first = record.where("is_forecast").agg(F.min("t").alias("_t0"))
    rows = record.join(F.broadcast(first), on=F.lit(True)).where(F.col("t").between(F.col("_t0") - history, F.col("_t0") + hours - 1))
    return rows.withColumn("is_target", F.col("t") >= F.col("_t0")).drop("_t0")


def custom_scenario(series: DataFrame, target: int) -> DataFrame:
    """Any (t, mm): the last row of a step counts; null, negative and missing steps are 0."""
    one = series.groupBy("t").agg(F.max_by("mm", "order").alias("mm"))
    mm = F.greatest(F.coalesce(F.nanvl(F.col("mm").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    cleaned = one.select("t", mm.alias("mm"), F.lit("custom").alias("source"), F.lit(False).alias("is_imputed"))
    return fill_gaps(cleaned, [], "mm").select("t", "mm", (F.col("t") >= target).alias("is_target"))


def hour_category(kind: Column, source: Column, is_forecast: Column, is_target: Column) -> Column:
    return (
        F.when(~is_target & (source == "missing"), "dry lead-in").when(kind == "design", "design").when(is_forecast, "forecast").otherwise("observed")
    )


def scenario_total(hours: DataFrame, first_hours: int) -> DataFrame:
    """One row: rain over the first `first_hours` target steps."""
    t0 = hours.where("is_target").agg(F.min("t").alias("_t0"))
    joined = hours.join(F.broadcast(t0), on=F.lit(True))
    return joined.where("is_target").agg(F.sum(F.when(F.col("t") < F.col("_t0") + first_hours, F.col("mm")).otherwise(0.0)).alias("total"))


def member_seeds(spark: SparkSession, base: int, offset: int, members: int, stride: int) -> DataFrame:
    return spark.range(members).select(F.col("id").cast("int").alias("member"), (F.lit(base) + (offset + F.col("id")) * stride).alias("seed"))


def lead_pairs(observed: DataFrame, leads: list[int]) -> DataFrame:
    """(lead_h, t, observed, forecast): each step against the value `lead` steps before, a persistence forecast."""
    later = observed.select(F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead_h"), F.col("t"), F.col("mm").alias("forecast"))
    shifted = later.select("lead_h", (F.col("t") + F.col("lead_h")).alias("t"), "forecast")
    return shifted.join(observed.select("t", F.col("mm").alias("observed")), "t").select("lead_h", "t", "observed", "forecast")


def find_preset(table: DataFrame, name: str) -> DataFrame:
    """The row of table(idx, name) named exactly, by its number, or by a prefix that only it has."""
    exact = table.where((F.col("name") == name) | (F.col("idx").cast("string") == name))
    prefix = table.where(F.lower("name").startswith(name.lower()))
    got = exact if not exact.isEmpty() else prefix
    if got.limit(2).count() != 1:
        raise ValueError(f"no single preset {name!r}")
    return got
