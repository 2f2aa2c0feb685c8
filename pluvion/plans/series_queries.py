"""Queries of series: cleaning, gaps, events, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import scenarios as C
from ..operators import series as S
from . import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


@query("SELECT user_id, t, round(sum(value), 4) AS mm, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events_t GROUP BY 1, 2")
def hour_ending_totals(spark, d):
    out = S.to_steps(A.events(spark, d), ["user_id"], F.col("t"), "value", {"n": F.count("*"), "last_type": F.max_by("event_type", "event_id")})
    return out.select("user_id", "t", F.round("value", 4).alias("mm"), "n", "last_type")


@query("SELECT event_id, t, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE least(greatest(value - 50, 0.0) * 1.5, 150.0) END AS mm, event_id % 11 = 0 AS is_imputed FROM events_t")
def cleaned_values(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise((F.col("value") - 50).cast("string"))
    rows = A.events(spark, d).select("event_id", "t", text.alias("mm"))
    return S.clean_values(rows, "mm", 150.0, 1.5).select("event_id", "t", "mm", "is_imputed")


@query("SELECT user_id, t, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events_t GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    rows = A.events(spark, d).select("user_id", "t", "event_id", "value").withColumn("o", F.col("event_id"))
    return S.dedup(rows, ["user_id", "t"], ["o"]).drop("o")


SPINE = "spine AS (SELECT unnest(range(lo, hi + 1))::BIGINT AS t FROM (SELECT min(t) AS lo, max(t) AS hi FROM wet))"


@query(f"WITH {SPINE} SELECT s.t, coalesce(w.mm, 0.0) AS mm, w.t IS NULL AS is_imputed, CASE WHEN w.t IS NULL THEN 'missing' ELSE 'gauge' END AS source FROM spine s LEFT JOIN wet w ON s.t = w.t")
def gap_filled(spark, d):
    rows = A.wet(spark, d).withColumn("is_imputed", F.lit(False)).withColumn("source", F.lit(None).cast("string"))
    rows = rows.withColumn("source", F.when(F.col("t") % 2 == 0, "gauge"))
    return S.fill_gaps(rows, [], "mm")


@query("WITH i AS (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM wet) SELECT min(t) AS block_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM i GROUP BY g")
def contiguous_blocks(spark, d):
    return S.block_spans(A.wet(spark, d), [])


@query(
    "WITH h AS (SELECT user_id, t, sum(value) > 100 AS wet_flag FROM events_t GROUP BY 1, 2), "
    "r AS (SELECT *, CASE WHEN lag(wet_flag) OVER w = wet_flag AND lag(t) OVER w = t - 1 THEN 0 ELSE 1 END AS st FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t)), "
    "g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t) AS run FROM r) "
    "SELECT user_id, t, wet_flag, wet_flag AND count(*) OVER (PARTITION BY user_id, run) > 1 AS in_long_run FROM g"
)
def long_flagged_runs(spark, d):
    rows = A.events(spark, d).groupBy("user_id", "t").agg((F.sum("value") > 100).alias("wet_flag"))
    return S.long_runs(rows, ["user_id"], "wet_flag", 1)


EVENTS = (
    "o AS (SELECT t, mm, CASE WHEN t - lag(t) OVER (ORDER BY t) - 1 <= 2 THEN 0 ELSE 1 END AS op FROM wet), "
    "e AS (SELECT t, mm, (sum(op) OVER (ORDER BY t))::BIGINT AS event_id FROM o)"
)
TOTALS = (
    "tot AS (SELECT event_id, min(t) AS first_t, max(t) AS last_t, count(*) AS wet_steps, round(sum(mm), 4) AS total, max(mm) AS peak, "
    "arg_min(t, (-mm, t)) AS peak_t FROM e GROUP BY event_id)"
)


def _events(spark, d):
    rows = S.rain_events(A.wet(spark, d), [], "mm", 0.0, 2)
    return S.event_totals(rows, [], "mm").withColumn("total", F.round("total", 4))


@query(f"WITH {EVENTS}, {TOTALS} SELECT * FROM tot")
def rain_event_totals(spark, d):
    return _events(spark, d)


@query(f"WITH {EVENTS}, {TOTALS}, {SPINE} SELECT s.t, coalesce(tot.event_id, -1) AS event_id FROM spine s LEFT JOIN tot ON s.t BETWEEN first_t AND last_t")
def event_of_each_hour(spark, d):
    return S.steps_of_events(_events(spark, d), [], S.spine(A.wet(spark, d), []))


@query(
    "SELECT node_id, t, rain, round(sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum_3, "
    "round(sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS sum_6, "
    "round(sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS sum_24 FROM node_hours"
)
def trailing_rain_sums(spark, d):
    out = S.trailing_sums(A.node_hours(spark, d), ["node_id"], "rain", [3, 6, 24])
    return out.withColumns({c: F.round(c, 4) for c in ("sum_3", "sum_6", "sum_24")})


@query("SELECT node_id, t, round(coalesce(sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING), 0.0), 4) AS antecedent FROM node_hours")
def antecedent_rain(spark, d):
    out = S.antecedent(A.node_hours(spark, d), ["node_id"], "rain", 24)
    return out.select("node_id", "t", F.round("antecedent", 4).alias("antecedent"))


@query(
    "WITH x AS (SELECT node_id, t, least(greatest((round(sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 4) - 100) / 400, 0.0), 1.0) AS ex FROM node_hours) "
    "SELECT node_id, t, round(ex, 6) AS excess, round(1 - (1 - 0.2) * ex * 0.5, 6) AS factor FROM x"
)
def surcharge_excess(spark, d):
    sums = S.trailing_sums(A.node_hours(spark, d), ["node_id"], "rain", [6], "s")
    ex = S.excess_ramp(F.round("s", 4), 100.0, 400.0)
    return sums.select("node_id", "t", F.round(ex, 6).alias("excess"), F.round(S.capacity_factor(ex, F.lit(0.5), 0.2), 6).alias("factor"))


BREAKS = "b AS (SELECT t, mm, (sum(br) OVER (ORDER BY t))::BIGINT AS breaks FROM (SELECT t, mm, CASE WHEN lag(t) OVER (ORDER BY t) IS NULL OR t - lag(t) OVER (ORDER BY t) = 1 THEN 0 ELSE 1 END AS br FROM daily))"


@query(f"WITH {BREAKS} SELECT t, mm, breaks FROM b")
def series_breaks(spark, d):
    return S.break_counts(A.daily(spark, d), [])


SPLIT = "CASE WHEN y < 1999 THEN 'train' WHEN y < 2000 THEN 'val' ELSE 'test' END"


def _split():
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("t").cast("int")))
    return F.when(year < 1999, "train").when(year < 2000, "val").otherwise("test")


WINDOWS = (
    f"{BREAKS}, c AS (SELECT t, mm, breaks, {SPLIT} AS s0 FROM (SELECT *, year(DATE '1970-01-01' + t::INTEGER) AS y FROM b)), "
    "w AS (SELECT t, sum(mm) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS total, lead(breaks, 15) OVER (ORDER BY t) AS b1, "
    "lag(breaks, 24) OVER (ORDER BY t) AS b0, lead(s0, 15) OVER (ORDER BY t) AS split, s0 FROM c), "
    "k AS (SELECT t, round(total, 2) AS total, total >= 16e6 - 1e-9 AS is_wet, split FROM w WHERE b0 = b1 AND split = s0 AND t % 6 = 0)"
)


def _windows(spark, d):
    rows = S.window_starts(A.daily(spark, d), [], "mm", 16, 24, 6, 16e6, _split())
    return rows.withColumn("total", F.round("total", 2))


@query(f"WITH {WINDOWS} SELECT * FROM k")
def training_windows(spark, d):
    return _windows(spark, d)


@query(
    f"WITH {WINDOWS} SELECT t, split, is_wet FROM k WHERE is_wet OR ('0x' || substr(md5(concat_ws('|', t, '7')), 1, 8))::BIGINT / 4294967296.0 < 0.3"
)
def kept_dry_windows(spark, d):
    return S.seeded_keep(_windows(spark, d), [], 0.3, 7).select("t", "split", "is_wet")


@query(
    f"WITH {WINDOWS}, h AS (SELECT DISTINCT split, unnest(range(t - 24, t + 16))::BIGINT AS h FROM k) SELECT split, count(*) AS hours, min(h) AS first_h, max(h) AS last_h FROM h GROUP BY split"
)
def window_hours(spark, d):
    hours = _windows(spark, d).select("split", F.explode(F.sequence(F.col("t") - 24, F.col("t") + 15)).alias("h")).distinct()
    return hours.groupBy("split").agg(F.count("*").alias("hours"), F.min("h").alias("first_h"), F.max("h").alias("last_h"))


@query(
    f"WITH {WINDOWS} SELECT split, count(*) AS windows, count_if(is_wet) AS wet_windows, round(avg(total), 2) AS mean_total, min(t) AS first_t, max(t) AS last_t FROM k GROUP BY split"
)
def split_statistics(spark, d):
    return _windows(spark, d).groupBy("split").agg(
        F.count("*").alias("windows"), F.count_if("is_wet").alias("wet_windows"), F.round(F.avg("total"), 2).alias("mean_total"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


@query(
    "SELECT node_id, t, coalesce(sum(y) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 4 FOLLOWING AND 15 FOLLOWING), 0)::BIGINT AS positives "
    "FROM (SELECT node_id, t, CASE WHEN rain > 300 THEN 1 ELSE 0 END AS y FROM node_hours)"
)
def positives_per_window(spark, d):
    labels = A.node_hours(spark, d).select("node_id", "t", F.when(F.col("rain") > 300, 1).otherwise(0).alias("y"))
    return S.window_positives(labels, ["node_id"], "y", 16, 4).select("node_id", "t", "positives")


@query(
    "WITH i AS (SELECT t, mm, t - row_number() OVER (ORDER BY t) AS g FROM hourly), n AS (SELECT min(t) OVER (PARTITION BY g) AS block_id, t, "
    "sum(mm) OVER w AS total, count(*) OVER w AS k FROM i WINDOW w AS (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) "
    "SELECT block_id, t, round(total, 4) AS total FROM n WHERE k = 6"
)
def block_window_totals(spark, d):
    return S.block_window_totals(A.hourly(spark, d), [], "mm", 6).withColumn("total", F.round("total", 4))


@query("SELECT floor((t - t0) / 24)::BIGINT AS block, max(mm) AS mm, min(t) AS first_t FROM hourly, (SELECT min(t) AS t0 FROM hourly) GROUP BY 1")
def fixed_block_maxima(spark, d):
    return S.fixed_block_max(A.hourly(spark, d), [], "mm", 24)


@query()
def separated_wettest_windows(spark, d):
    totals = S.block_window_totals(A.hourly(spark, d), [], "mm", 6).withColumn("total", F.round("total", 4))
    chosen = S.separated_top(totals, 5, 48)  # five rows
    return spark.createDataFrame(chosen, totals.schema)


@query("SELECT year(DATE '1970-01-01' + t::INTEGER)::INTEGER AS year, round(sum(mm), 2) AS total, count(*) AS n, count(*) >= 365 * 360 / 365.0 AS whole FROM daily GROUP BY 1")
def yearly_totals(spark, d):
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("t").cast("int")))
    return S.yearly_summary(A.daily(spark, d), "mm", year, 365).withColumn("total", F.round("total", 2))


@query("SELECT t, mm FROM daily ORDER BY mm DESC, t LIMIT 10")
def wettest_days(spark, d):
    return A.daily(spark, d).orderBy(F.desc("mm"), "t").limit(10)


@query(f"WITH {SPINE} SELECT t FROM spine WHERE t NOT IN (SELECT t FROM wet)")
def missing_hours(spark, d):
    rows = A.wet(spark, d)
    return S.missing_steps(S.spine(rows, []), rows, [])


@query("SELECT coalesce(w.t, h.t) AS t, CASE WHEN w.t IS NOT NULL THEN w.mm ELSE h.mm END AS mm, CASE WHEN w.t IS NOT NULL THEN 'wet' ELSE 'all' END AS source FROM wet w FULL JOIN hourly h ON w.t = h.t")
def merged_by_priority(spark, d):
    first = A.wet(spark, d).withColumn("source", F.lit("wet"))
    return S.merge_by_priority([first, A.hourly(spark, d).withColumn("source", F.lit("all"))], [])


@query("SELECT (SELECT count(*) FROM hourly WHERE t NOT IN (SELECT t FROM wet)) AS lost_steps, (SELECT count(*) FROM hourly WHERE mm <= 1000 AND t NOT IN (SELECT t FROM wet)) AS lost_observations")
def shrink_guard(spark, d):
    stored = A.hourly(spark, d).withColumn("is_imputed", F.col("mm") > 1000)
    return S.shrink_problem(stored, A.wet(spark, d).withColumn("is_imputed", F.lit(False)), [])


@query("SELECT t, round(CASE WHEN t % 3 = 0 THEN mm ELSE least(mm * (1.2 / 0.9), 2000.0) END, 4) AS mm FROM hourly")
def bias_rescaled(spark, d):
    rows = A.hourly(spark, d).withColumn("source", F.when(F.col("t") % 3 == 0, "synthetic").otherwise("gauge"))
    return S.rescale_bias(rows, "mm", 0.9, 1.2, 2000.0, "gauge").select("t", F.round("mm", 4).alias("mm"))


@query(
    f"WITH {SPINE}, r AS (SELECT s.t, CASE WHEN w.t IS NULL THEN 'missing' WHEN s.t % 5 = 0 THEN 'synthetic' ELSE 'gauge' END AS source FROM spine s LEFT JOIN wet w ON s.t = w.t) "
    "SELECT count_if(source = 'gauge') AS observed, count_if(source = 'synthetic') AS synthetic, count_if(source = 'missing') AS gap_filled, "
    "mode(source) FILTER (WHERE source <> 'missing') AS main_source, count_if(source = 'gauge') > 0 AND count_if(source = 'synthetic') > 0 AS mixed FROM r"
)
def source_mixture(spark, d):
    rows = A.wet(spark, d).select("t", "mm", F.lit(False).alias("is_imputed"), F.when(F.col("t") % 5 == 0, "synthetic").otherwise("gauge").alias("source"))
    return S.source_mix(S.fill_gaps(rows, [], "mm"))


@query(
    "WITH f AS (SELECT min(t) AS t0 FROM hourly) SELECT t, tile, tile = floor((t - t0) / 12)::BIGINT AS is_scored FROM (SELECT t, t0, unnest(range(floor((t - t0) / 12)::BIGINT, floor((t + 4 - t0) / 12)::BIGINT + 1)) AS tile FROM hourly, f)"
)
def prediction_tiles(spark, d):
    rows = A.hourly(spark, d)
    return S.tiles(rows, rows.agg(F.min("t")).first()[0], 12, 4).select("t", "tile", "is_scored")


@query(
    "WITH p AS (SELECT l AS lead_h, a.mm AS forecast, b.mm AS observed FROM hourly a, (SELECT unnest([24, 48])::INTEGER AS l), hourly b WHERE b.t = a.t + l) "
    "SELECT lead_h, round(sum(observed), 3) AS observed_total, round(sum(forecast), 3) AS forecast_total, max(observed) AS observed_peak, max(forecast) AS forecast_peak, "
    "round(avg(abs(forecast - observed)), 6) AS mae, round(corr(observed, forecast), 6) AS correlation, "
    "round(count_if(observed >= 900 AND forecast >= 900) / count_if(observed >= 900), 6) AS wet_hit_rate FROM p GROUP BY 1"
)
def lead_time_skill(spark, d):
    out = M.rain_skill(C.lead_pairs(A.hourly(spark, d), [24, 48]), ["lead_h"], 900.0)
    return out.withColumns({c: F.round(c, n) for c, n in (("observed_total", 3), ("forecast_total", 3), ("mae", 6), ("correlation", 6), ("wet_hit_rate", 6))})
