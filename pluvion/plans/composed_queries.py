"""Queries of the composed operators: records, datasets, reports, backtests, enriched graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import graph as G
from ..operators import labels as L
from ..operators import records as C
from ..operators import results as R
from ..operators import series as S
from ..operators import spatial as P
from ..operators.components import cut
from . import adapters as A
from .graph_queries import DISTANCE, RECEIVERS, SEGS, _drains
from .score_queries import LABELS, _labels, rounded
from .series_queries import WINDOWS, _windows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


RECORD = (
    f"ev AS (SELECT user_id, event_id, value, {A.T} AS t, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1), "
    "hr AS (SELECT user_id, t, round(sum(CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE least(greatest(value - 50, 0.0) * 1.5, 150.0) END), 4) AS mm, bool_and(event_id % 11 = 0) AS imp FROM ev GROUP BY 1, 2), "
    "sp AS (SELECT user_id, unnest(range(lo, hi + 1))::BIGINT AS t FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM hr GROUP BY 1)), "
    "rec_ AS (SELECT sp.user_id, sp.t, coalesce(mm, 0.0) AS mm, coalesce(imp, true) AS is_imputed, CASE WHEN mm IS NULL THEN 'missing' ELSE 'gauge' END AS source FROM sp LEFT JOIN hr USING (user_id, t))"
)


def _record(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise((F.col("value") - 50).cast("string"))
    raw = A.read(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("order"), text.alias("mm"), F.lit("gauge").alias("source"))
    return C.clean_record(raw, ["user_id"], "mm", 150.0, 1.5).withColumn("mm", F.round("mm", 4))


@query(f"WITH {RECORD} SELECT * FROM rec_")
def clean_record(spark, d):
    return _record(spark, d)


@query(
    f"WITH {RECORD} SELECT user_id, count(*) AS steps, round(sum(mm), 3) AS total, round(sum(mm) / count(*) * 8760, 3) AS mean_year, arg_min(t, (-mm, t)) AS wettest_t, "
    "round(avg(CASE WHEN is_imputed THEN 1.0 ELSE 0.0 END), 8) AS imputed_share, count(*) FILTER (WHERE source = 'missing') AS missing_rows FROM rec_ GROUP BY 1"
)
def record_reports(spark, d):
    out = C.record_report(_record(spark, d), ["user_id"], "mm")
    missing = F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + F.when(x["source"] == "missing", x["rows"]).otherwise(0))
    return out.select("user_id", "steps", F.round("total", 3).alias("total"), F.round("mean_year", 3).alias("mean_year"), "wettest_t", F.round("imputed_share", 8).alias("imputed_share"), missing.alias("missing_rows"))


@query("WITH z AS (SELECT min(t) AS t0 FROM hourly) SELECT t, mm FROM hourly, z WHERE t BETWEEN t0 + 100 AND t0 + 300")
def record_in_range(spark, d):
    rows = A.hourly(spark, d)
    t0 = rows.agg(F.min("t")).first()[0]
    return C.range_filter(rows, t0 + 100, t0 + 300)


def _gappy(spark, d):
    """Nodes with elevations that are absent or not finite."""
    e = F.col("elevation")
    return A.nodes_xy(spark, d).withColumn("elevation", F.when(e < 874, F.lit(float("nan"))).when(e >= 888, None).otherwise(e))


@query("SELECT 'elevation' AS attribute, count(*) AS missing FROM nodes WHERE elevation < 874 OR elevation >= 888")
def missing_attributes(spark, d):
    return C.missing_enrichment(_gappy(spark, d), ["lon", "elevation", "lat"])


@query("WITH m AS (SELECT avg(elevation) AS m FROM nodes WHERE elevation >= 874 AND elevation < 888) SELECT node_id, round(CASE WHEN elevation >= 874 AND elevation < 888 THEN elevation ELSE m END, 6) AS elevation FROM nodes, m")
def mean_filled_elevations(spark, d):
    return C.mean_fill(_gappy(spark, d), "elevation").select("node_id", F.round("elevation", 6).alias("elevation"))


@query("SELECT node_id, elevation, lon, NULL::DOUBLE AS capacity FROM nodes")
def static_attributes(spark, d):
    return C.static_table(A.nodes(spark, d), ["elevation", "lon", "capacity"])


@query("SELECT t, node_id, CASE WHEN rain > 300 THEN 1 ELSE 0 END AS y, rain / 1000 AS depth FROM node_hours")
def valid_flood_labels(spark, d):
    rows = A.node_hours(spark, d).select("t", "node_id", F.when(F.col("rain") > 300, 1).otherwise(0).alias("y"), (F.col("rain") / 1000).alias("depth"))
    return C.valid_labels(rows, "depth")


@query("SELECT h.t, n.node_id, h.mm FROM hourly h, (SELECT DISTINCT node_id FROM node_hours) n")
def areal_rain_at_nodes(spark, d):
    return C.areal_at_nodes(A.hourly(spark, d), A.node_hours(spark, d).select("node_id").distinct())


@query("SELECT w.t, w.mm AS stored, h.mm AS now FROM wet w JOIN hourly h ON w.t = h.t")
def aligned_rows(spark, d):
    return C.aligned(A.wet(spark, d).withColumnRenamed("mm", "stored"), A.hourly(spark, d).withColumnRenamed("mm", "now"))


@query(f"WITH {WINDOWS}, s AS (SELECT t AS start, unnest(range(4, 16))::INTEGER AS step FROM k) SELECT start, step, start + step AS t, daily.mm FROM s JOIN daily ON daily.t = start + step")
def scored_values(spark, d):
    return C.scored_values(A.daily(spark, d), _windows(spark, d), [], 16, 4)


PAIRS = (
    f"{LABELS}, ld AS (SELECT l AS lead_h, a.t + l AS t, round(a.mm * l / 24, 4) AS forecast FROM hourly a, (SELECT unnest([24, 48])::INTEGER AS l)), "
    "pr AS (SELECT lead_h, t, node_id, forecast, rain AS observed, y FROM ld JOIN node_hours USING (t) JOIN lab USING (t, node_id))"
)


def _pairs(spark, d):
    h = A.hourly(spark, d)
    leads = None
    for lead in (24, 48):
        one = h.select(F.lit(lead).alias("lead_h"), (F.col("t") + lead).alias("t"), F.round(F.col("mm") * lead / 24, 4).alias("forecast"))
        leads = one if leads is None else leads.unionByName(one)
    return C.forecast_truth(leads, A.node_hours(spark, d), _labels(spark, d))


@query(f"WITH {PAIRS} SELECT * FROM pr")
def forecast_truth_pairs(spark, d):
    return _pairs(spark, d)


CONFUSED = "count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y = 0) AS tn"


@query(
    f"WITH {PAIRS}, bt AS (SELECT 'forecast' AS row_name, lead_h, t, node_id, y, least(round(forecast / 1500, 6), 1.0) AS p FROM pr UNION ALL SELECT 'perfect', lead_h, t, node_id, y, least(round(observed / 600, 6), 1.0) FROM pr), "
    f"c AS (SELECT row_name, lead_h, {CONFUSED} FROM bt GROUP BY 1, 2), a AS (SELECT row_name, lead_h, {CONFUSED} FROM (SELECT row_name, lead_h, t, max(y) AS y, max(p) AS p FROM bt GROUP BY 1, 2, 3) GROUP BY 1, 2) "
    "SELECT c.row_name, c.lead_h, c.tp, c.fp, c.fn, c.tn, round(CASE WHEN c.tp + c.fp > 0 THEN c.tp / (c.tp + c.fp) END, 8) AS precision, "
    "round(CASE WHEN c.tp + c.fn + c.fp > 0 THEN 5.0 * c.tp / (5.0 * c.tp + 4.0 * c.fn + c.fp) END, 8) AS f2, "
    "round(CASE WHEN a.tp + a.fn + a.fp > 0 THEN 5.0 * a.tp / (5.0 * a.tp + 4.0 * a.fn + a.fp) END, 8) AS any_f2 FROM c JOIN a USING (row_name, lead_h)"
)
def forecast_backtest(spark, d):
    pairs = _pairs(spark, d)
    rows = [pairs.select(F.lit(name).alias("row_name"), "lead_h", "t", "node_id", "y", F.least(F.round(F.col(c) / by, 6), F.lit(1.0)).alias("p")) for name, c, by in (("forecast", "forecast", 1500), ("perfect", "observed", 600))]
    out = C.backtest(rows[0].unionByName(rows[1]), 0.5, ["row_name", "lead_h"])
    return rounded(out.select("row_name", "lead_h", "tp", "fp", "fn", "tn", "precision", "f2", "any_f2"), 8, "precision", "f2", "any_f2")


SOURCES = "sc AS (SELECT CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE 'odd' END AS part, y, p FROM scores)"


@query(
    f"WITH {SOURCES}, c AS (SELECT part, p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1, 2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM c WINDOW w AS (PARTITION BY part ORDER BY p DESC)), "
    "m AS (SELECT part, sum(pos * tp / al) / sum(pos) AS ap, sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM r GROUP BY part), "
    "b AS (SELECT part, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM sc GROUP BY 1, 2), e AS (SELECT part, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b GROUP BY part), "
    f"k AS (SELECT part, {CONFUSED}, avg(pow(p - y, 2)) AS brier FROM sc GROUP BY part) "
    "SELECT part, tp, fp, fn, tn, round(5.0 * tp / (5.0 * tp + 4.0 * fn + fp), 8) AS f2, round(ap, 8) AS average_precision, round(auc, 8) AS roc_auc, round(brier, 8) AS brier, round(ece, 8) AS ece, round(mce, 8) AS mce "
    "FROM k JOIN m USING (part) JOIN e USING (part)"
)
def reports_by_part(spark, d):
    rows = A.scores(spark, d).select(F.when(F.col("n_chars") % 2 == 0, "even").otherwise("odd").alias("part"), "y", "p")
    out = C.reports_by_row(rows, "part", ["even", "odd"], 0.5)
    names = ["f2", "average_precision", "roc_auc", "brier", "ece", "mce"]
    return rounded(out.select("part", "tp", "fp", "fn", "tn", *names), 8, *names)


@query("SELECT round(min(x) - 2501.0, 4) AS x_min, round(min(y) - 2501.0, 4) AS y_min, round(greatest(max(x), 100.0) - min(x) + 5002.0, 4) AS width, round(greatest(max(y), 200.0) - min(y) + 5002.0, 4) AS height FROM nodes_xy")
def placement_extent(spark, d):
    out = C.placement_extent(A.nodes_xy(spark, d), (0.0, 0.0, 100.0, 200.0), 2.5, 1000.0)
    return rounded(out, 4, "x_min", "y_min", "width", "height")


@query(f"WITH {WINDOWS}, n AS (SELECT t, split, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM k) SELECT t, split FROM n WHERE i IN (SELECT round_even(j * (n - 1) / 6.0, 0)::BIGINT FROM (SELECT unnest(range(7)) AS j), (SELECT max(n) AS n FROM n))")
def evenly_spaced_windows(spark, d):
    return C.evenly_spaced(_windows(spark, d).select("t", "split"), "t", 7)


@query("SELECT t, mm FROM hourly WHERE t IN (SELECT t FROM wet)")
def hours_in_target(spark, d):
    return C.in_target(A.hourly(spark, d), A.wet(spark, d).select("t"))


USER_EVENTS = (
    "uh AS (SELECT user_id, t, round(sum(value), 4) AS mm FROM events_t WHERE value > 100 GROUP BY 1, 2), "
    "uo AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) - 1 <= 6 THEN 0 ELSE 1 END AS op FROM uh), "
    "ue AS (SELECT user_id, t, mm, (sum(op) OVER (PARTITION BY user_id ORDER BY t))::BIGINT AS event_id FROM uo), "
    "ut AS (SELECT user_id, event_id, min(t) AS first_t, max(t) AS last_t, count(*) AS wet_steps, round(sum(mm), 4) AS total, max(mm) AS peak FROM ue GROUP BY 1, 2)"
)


def _user_events(spark, d):
    hours = A.events(spark, d).where("value > 100").groupBy("user_id", "t").agg(F.round(F.sum("value"), 4).alias("mm"))
    return S.event_totals(S.rain_events(hours, ["user_id"], "mm", 0.0, 6), ["user_id"], "mm").withColumn("total", F.round("total", 4)).drop("peak_t")


@query(f"WITH {USER_EVENTS} SELECT * FROM ut")
def events_of_each_series(spark, d):
    return _user_events(spark, d)


@query("WITH i AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT DISTINCT user_id, t FROM events_t)) SELECT user_id, min(t) AS block_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM i GROUP BY user_id, g")
def blocks_of_each_series(spark, d):
    return S.block_spans(A.events(spark, d).select("user_id", "t").distinct(), ["user_id"])


@query(f"WITH {USER_EVENTS} SELECT user_id, event_id, first_t, last_t, wet_steps, total, peak FROM ut WHERE total >= 300 ORDER BY first_t DESC, event_id LIMIT 1")
def latest_notable_event(spark, d):
    return C.latest(_user_events(spark, d), "total", 300.0)


DATASET = (
    f"{WINDOWS}, st AS (SELECT t AS start, split, unnest(range(-24, 16))::INTEGER AS step FROM k), rw AS (SELECT start, split, step, start + step AS t, daily.mm FROM st JOIN daily ON daily.t = start + step), "
    "ft AS (SELECT avg(ln(1 + mm)) AS m, stddev_pop(ln(1 + mm)) AS s FROM (SELECT DISTINCT t, mm FROM rw WHERE split = 'train')), ds AS (SELECT start, split, step, t, mm, (ln(1 + mm) - m) / s AS scaled FROM rw, ft)"
)


def _dataset(spark, d):
    return C.dataset_rows(A.daily(spark, d), _windows(spark, d), [], "mm", 16, 24)


@query(f"WITH {DATASET} SELECT start, split, step, t, mm, round(scaled, 6) AS scaled FROM ds")
def split_datasets(spark, d):
    return _dataset(spark, d).select("start", "split", "step", "t", "mm", F.round("scaled", 6).alias("scaled"))


@query(
    f"WITH {DATASET}, q AS (SELECT ds.*, CASE WHEN mm > 1.2e6 THEN 1 ELSE 0 END AS y FROM ds WHERE step >= 0) SELECT split, count(DISTINCT start) AS windows, count(*) AS steps, round(avg(scaled), 6) AS mean, round(stddev_pop(scaled), 6) AS deviation, "
    "round(avg(y), 8) AS positive_rate, count(DISTINCT CASE WHEN y > 0 THEN start END) AS flood_windows FROM q GROUP BY split"
)
def dataset_statistics(spark, d):
    labels = A.daily(spark, d).select("t", F.when(F.col("mm") > 1.2e6, 1).otherwise(0).alias("y"))
    return rounded(rounded(C.dataset_statistics(_dataset(spark, d), labels), 6, "mean", "deviation"), 8, "positive_rate")


@query(
    f"WITH RECURSIVE {RECEIVERS}, path AS (SELECT node_id AS start, node_id AS pos FROM nodes UNION ALL SELECT start, receiver FROM path JOIN rec ON node_id = pos), "
    f"acc AS (SELECT pos AS node_id, count(*) AS accumulation FROM path GROUP BY pos), {SEGS}, {DISTANCE}, "
    "tp AS (SELECT a.node_id, a.elevation - avg(b.elevation) AS tpi FROM nodes_xy a JOIN nodes_xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 300 GROUP BY a.node_id, a.elevation) "
    "SELECT nodes.node_id, elevation, round(tpi, 6) AS tpi, round(d, 4) AS drain_distance, accumulation, 'survey' AS elevation_source, 'osm' AS drain_source "
    "FROM nodes JOIN tp USING (node_id) JOIN ds USING (node_id) JOIN acc USING (node_id)"
)
def enriched_graph(spark, d):
    points = A.nodes_xy(spark, d).select("node_id", "x", "y", "elevation")
    nodes, _ = C.enrich_graph(points, A.edges(spark, d), _drains(spark, d), 300.0, 400.0, "survey", "osm")
    return nodes.select("node_id", "elevation", F.round("tpi", 6).alias("tpi"), F.round("drain_distance", 4).alias("drain_distance"), "accumulation", "elevation_source", "drain_source")


INPUTS = "i AS (SELECT user_id, CASE WHEN count(*) % 3 = 0 THEN 'synthetic' ELSE 'dem' END AS e0, CASE WHEN count(*) % 4 = 0 THEN 'grid' ELSE 'survey' END AS e1, CASE WHEN count(*) % 2 = 0 THEN 'osm' END AS d0, CASE WHEN count(*) % 5 <> 0 THEN 'osm' END AS d1 FROM events GROUP BY 1)"


@query(f"WITH {INPUTS} SELECT user_id, 'elevation_source' AS input, e0 AS old, e1 AS new FROM i WHERE e0 = 'dem' AND e1 = 'grid' UNION ALL SELECT user_id, 'drain_source', d0, d1 FROM i WHERE d0 = 'osm' AND d1 IS NULL")
def source_downgrades(spark, d):
    n = A.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    when = lambda k, a, b: F.when(F.col("n") % k == 0, a).otherwise(b)
    before = n.select("user_id", when(3, "synthetic", "dem").alias("elevation_source"), when(2, "osm", None).alias("drain_source"))
    after = n.select("user_id", when(4, "grid", "survey").alias("elevation_source"), when(5, None, "osm").alias("drain_source"))
    return C.downgrades(before, after, ["user_id"])


SPEARMAN = "CASE WHEN count(*) >= 3 AND stddev_pop(f) > 0 AND stddev_pop({0}) > 0 THEN corr(rf, r_{0}) END"
STATS = (
    f"{LABELS}, un AS (SELECT n.t, n.node_id, CASE WHEN m > 220 THEN 1 ELSE 0 END AS y FROM node_hours n JOIN (SELECT t, avg(rain) AS m FROM node_hours GROUP BY t) USING (t)), "
    "hr AS (SELECT t, avg(y) AS share, sum(rain) AS mm FROM lab JOIN node_hours USING (t, node_id) GROUP BY t), "
    "h6 AS (SELECT *, month(DATE '1970-01-01' + (t // 24)::INTEGER) AS mo, sum(mm) OVER (ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS s6 FROM hr), "
    "rh AS (SELECT t, stddev_pop(rain) / avg(rain) AS cv, max(rain) / avg(rain) AS pk FROM node_hours GROUP BY t HAVING avg(rain) >= 40), "
    "own AS (SELECT t, node_id, y FROM lab SEMI JOIN (SELECT t FROM h6 WHERE mo IN (1, 2)) s USING (t)), "
    "ja AS (SELECT count_if(l.y = 1 AND u.y = 1) / count_if(l.y = 1 OR u.y = 1) AS jaccard FROM own l JOIN un u USING (t, node_id)), "
    "sp AS (SELECT min(t) + 120 AS t0, min(t) + 360 AS t1 FROM hr), ins AS (SELECT hr.* FROM hr, sp WHERE t BETWEEN t0 AND t1), "
    "op AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) - 1 <= 2 THEN 0 ELSE 1 END AS o FROM hr WHERE mm > 600), ev AS (SELECT t, sum(o) OVER (ORDER BY t) AS e FROM op), "
    "eg AS (SELECT e, min(t) AS a, max(t) AS z FROM ev GROUP BY e), eu AS (SELECT *, least(z + 6, coalesce(lead(a) OVER (ORDER BY a) - 1, z + 6)) AS till FROM eg), "
    "ef AS (SELECT count(*) AS events, count_if(EXISTS (SELECT 1 FROM hr WHERE share > 0 AND t BETWEEN a AND till)) AS floods FROM eu), "
    f"{RECEIVERS}, path AS (SELECT node_id AS start, node_id AS pos FROM nodes UNION ALL SELECT start, receiver FROM path JOIN rec ON node_id = pos), "
    "acc AS (SELECT pos AS node_id, count(*) AS accum FROM path GROUP BY pos), "
    "tp AS (SELECT a.node_id, round(a.elevation - avg(b.elevation), 6) AS relev FROM nodes_xy a JOIN nodes_xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 300 GROUP BY a.node_id, a.elevation), "
    "fq AS (SELECT node_id, avg(y) AS f FROM own GROUP BY node_id), fs AS (SELECT f, relev, accum, CASE WHEN rec.node_id IS NULL THEN 1 ELSE 0 END AS sink FROM fq JOIN tp USING (node_id) JOIN acc USING (node_id) LEFT JOIN rec USING (node_id)), "
    "fr AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {r}" for c, r in (("f", "rf"), ("relev", "r_relev"), ("accum", "r_accum"), ("sink", "r_sink"))) + " FROM fs), "
    "co AS (SELECT " + ", ".join(f"{SPEARMAN.format(c)} AS {c}" for c in ("relev", "accum", "sink")) + " FROM fr), "
    "pos AS MATERIALIZED (SELECT t, node_id FROM own WHERE y = 1), gm AS MATERIALIZED (SELECT a.node_id AS i, b.node_id AS j, count(*)::DOUBLE AS c FROM pos a JOIN pos b USING (t) GROUP BY 1, 2), "
    "pw AS (SELECT 0 AS k, node_id, count(*)::DOUBLE AS v FROM pos GROUP BY node_id UNION ALL SELECT k + 1, j, sum(c * v) FROM pw JOIN gm ON i = pw.node_id WHERE k < 30 GROUP BY k, j), "
    "nm AS (SELECT k, sqrt(sum(v * v)) AS n FROM pw GROUP BY k), "
    "r1 AS (SELECT 1 - (n - l1) / (n - n * n / cells) AS rank_one FROM (SELECT (SELECT count(*) FROM pos)::DOUBLE AS n, (SELECT count(*) FROM own)::DOUBLE AS cells, (SELECT n FROM nm WHERE k = 30) / (SELECT n FROM nm WHERE k = 29) AS l1)), "
    "st AS (SELECT (SELECT avg(share) FROM h6 WHERE mo IN (1, 2)) AS season_rate, (SELECT count(*) FROM h6 WHERE share > 0 AND s6 < 2000) AS dry_floods, (SELECT quantile_cont(share, 0.5) FROM hr WHERE share > 0) AS median_share, "
    "(SELECT max(share) FROM ins) AS peak_share, (SELECT arg_min(t, (-share, t)) FROM ins) AS peak_t, (SELECT sum(mm) FROM ins) AS peak_rain, (SELECT quantile_cont(cv, 0.5) FROM rh) AS cv_median, (SELECT quantile_cont(pk, 0.95) FROM rh) AS peak_p95, jaccard, "
    "events, floods AS flooding_events, floods / ((SELECT max(t) - min(t) + 1 FROM hr) / 8760) AS events_per_year, relev, accum, sink, rank_one FROM ja, ef, co, r1)"
)


def _static(spark, d):
    """(node_id, relev, accum, sink): position among the nodes within 300 m, flow accumulation, no receiver."""
    points = A.nodes_xy(spark, d)
    near = P.mean_within(points.select(F.col("node_id").alias("id"), "x", "y", "elevation"), "elevation", 300.0).select(F.col("id").alias("node_id"), "mean")
    receivers = cut(G.steepest_receivers(A.edges(spark, d), points))
    joined = points.join(near, "node_id").join(G.flow_accumulation(points, receivers), "node_id").join(receivers.select("node_id", "receiver"), "node_id", "left")
    return joined.select("node_id", F.round(F.col("elevation") - F.col("mean"), 6).alias("relev"), F.col("accumulation").alias("accum"), F.col("receiver").isNull().cast("int").alias("sink"))


def _statistics(spark, d):
    rain, labels = A.node_hours(spark, d), _labels(spark, d)
    mean = rain.groupBy("t").agg(F.avg("rain").alias("m"))
    uniform = rain.join(mean, "t").select("t", "node_id", F.when(F.col("m") > 220, 1).otherwise(0).alias("y"))
    per = labels.join(rain, ["t", "node_id"]).groupBy("t").agg(F.avg("y").alias("share"), F.sum("rain").alias("mm"))
    month = F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 24).cast("int")))
    hourly = S.trailing_sums(per, [], "mm", [6]).withColumn("month", month)
    span = rain.agg((F.min("t") + 120).alias("first"), (F.min("t") + 360).alias("last"))
    return C.calibration_statistics(labels, rain, uniform, hourly, _static(spark, d), span, [1, 2], 2000.0, 40.0, 600.0)


STATISTICS = ["season_rate", "median_share", "peak_share", "cv_median", "peak_p95", "jaccard", "events_per_year", "relev", "accum", "sink", "rank_one"]


@query(f"WITH RECURSIVE {STATS} SELECT dry_floods, events, flooding_events, peak_t, round(peak_rain, 3) AS peak_rain, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATISTICS) + " FROM st")
def calibration_statistics(spark, d):
    out = _statistics(spark, d).select("dry_floods", "events", "flooding_events", "peak_t", F.round("peak_rain", 3).alias("peak_rain"), *STATISTICS)
    return rounded(out, 6, *STATISTICS)


@query(
    f"WITH RECURSIVE {STATS} SELECT unnest(['season rate', 'no dry floods', 'event peak', 'clustered', 'events a year', 'rank one', 'differs from uniform', 'median share', 'rain field']) AS criterion, "
    "unnest([season_rate BETWEEN 0.005 AND 0.03, dry_floods = 0, peak_share BETWEEN 0.1 AND 0.5, relev < 0 AND accum > 0 AND sink > 0, events_per_year >= 15, rank_one < 0.6, jaccard < 0.75, median_share < 0.25, cv_median BETWEEN 0.3 AND 0.7 AND peak_p95 >= 2]) AS passed FROM st"
)
def calibration_checks(spark, d):
    return C.calibration_checks(_statistics(spark, d))


@query(
    f"WITH RECURSIVE {STATS} SELECT month(DATE '1970-01-01' + (a // 24)::INTEGER)::INTEGER AS period, count(*) AS events, count_if(EXISTS (SELECT 1 FROM hr WHERE share > 0 AND t BETWEEN a AND till)) AS floods FROM eu GROUP BY 1"
)
def flooding_events_by_month(spark, d):
    rain = A.node_hours(spark, d).groupBy("t").agg(F.sum("rain").alias("mm"))
    events = S.rain_events(rain, [], "mm", 600.0, 2).groupBy("event_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    flooding = D.flooding_events(events, _labels(spark, d).where("y = 1").select("t").distinct(), 6)
    return D.flooding_by_period(flooding, F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("first_t") / 24).cast("int"))))


ENSEMBLE = (
    f"{LABELS}, sc2 AS (SELECT y, p FROM (SELECT t, node_id, round(avg(p), 6) AS p FROM members GROUP BY 1, 2) JOIN lab USING (t, node_id)), "
    "cand AS (SELECT DISTINCT c FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS c UNION ALL SELECT p FROM sc2 WHERE y = 1)), "
    "g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc2 GROUP BY p), kk AS (SELECT c, sum(CASE WHEN p >= c THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= c THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN p < c THEN pos ELSE 0 END) AS fn FROM cand, g GROUP BY c), "
    "ff AS (SELECT c, 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) AS s FROM kk), tt AS (SELECT list(c ORDER BY c) AS cs, max(s) AS s FROM ff WHERE s >= (SELECT max(s) FROM ff) - 1e-12)"
)


@query(f"WITH {ENSEMBLE} SELECT cs[(len(cs) // 2) + 1] AS threshold, round(s, 8) AS score FROM tt")
def ensemble_threshold(spark, d):
    return rounded(C.ensemble_threshold(A.members(spark, d), _labels(spark, d), "f2", [0.1, 0.3, 0.5, 0.7, 0.9]), 8, "score")


@query(
    "WITH arc AS (SELECT u, v, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT node_id, node_id, 1.0 FROM nodes), deg AS (SELECT v, sum(w) AS d FROM arc GROUP BY v), "
    "f1 AS (SELECT arc.v AS node_id, sum(w * elevation / sqrt(a.d * b.d)) AS x FROM arc JOIN deg a ON a.v = arc.u JOIN deg b ON b.v = arc.v JOIN nodes ON node_id = arc.u GROUP BY 1), "
    "f2 AS (SELECT arc.v AS node_id, sum(w * x / sqrt(a.d * b.d)) AS x FROM arc JOIN deg a ON a.v = arc.u JOIN deg b ON b.v = arc.v JOIN f1 ON f1.node_id = arc.u GROUP BY 1) "
    "SELECT node_id, elevation, round(f1.x, 6) AS elevation_1, round(f2.x, 6) AS elevation_2 FROM nodes JOIN f1 USING (node_id) JOIN f2 USING (node_id)"
)
def neighbour_features(spark, d):
    arcs = A.edges(spark, d).select("u", "v", F.lit(1.0).alias("w"))
    return rounded(C.neighbour_features(arcs, A.nodes(spark, d).select("node_id", "elevation"), "elevation", 2), 6, "elevation_1", "elevation_2")


RAW_REPORTS = "event_id AS line, CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp, CASE event_id % 10 WHEN 0 THEN 'light' WHEN 1 THEN ' Extreme ' WHEN 2 THEN '2.7' WHEN 3 THEN 'nan' WHEN 4 THEN '3' WHEN 5 THEN '' WHEN 6 THEN 'bogus' WHEN 7 THEN 'knee' WHEN 8 THEN '2.0' END AS severity, CASE WHEN event_id % 7 = 0 THEN '-1' WHEN event_id % 7 = 1 THEN '12.5' END AS radius_m, CASE WHEN event_id % 19 = 0 THEN '95.0' ELSE '12.5' END AS lat"


def _raw_reports(spark, d):
    i = F.col("event_id")
    words = F.element_at(F.array(*[F.lit(x) for x in ("light", " Extreme ", "2.7", "nan", "3", "", "bogus", "knee", "2.0", None)]), (i % 10 + 1).cast("int"))
    stamp = F.when(i % 17 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return A.read(spark, d, "events").select(
        i.alias("line"), stamp.alias("timestamp"), F.when(i % 19 == 0, "95.0").otherwise("12.5").alias("lat"), F.lit("77.6").alias("lon"),
        F.when(i % 7 == 0, "-1").when(i % 7 == 1, "12.5").alias("radius_m"), words.alias("severity"), F.lit("").alias("description"),
    )


REJECTED = "concat_ws(', ', CASE WHEN stamp = 'soon' THEN 'bad timestamp' END, CASE WHEN lat = '95.0' THEN 'coordinates off the globe' END, CASE WHEN radius_m = '-1' THEN 'bad radius' END, CASE WHEN severity IN ('2.7', 'nan', 'bogus') THEN 'bad severity' END)"


@query(f"SELECT line, {REJECTED} AS reasons FROM (SELECT {RAW_REPORTS} FROM events) WHERE {REJECTED} <> ''")
def rejected_reports(spark, d):
    return L.split_reports(_raw_reports(spark, d))[1].select("line", F.concat_ws(", ", "reasons").alias("reasons"))


@query(f"SELECT line, CASE WHEN severity IN ('light', '') OR severity IS NULL THEN 1 WHEN severity IN ('knee', '2.0') THEN 2 ELSE 3 END AS severity, radius_m::DOUBLE AS radius_m FROM (SELECT {RAW_REPORTS} FROM events) WHERE {REJECTED} = '' QUALIFY row_number() OVER (PARTITION BY stamp ORDER BY line) = 1")
def parsed_reports(spark, d):
    return L.split_reports(_raw_reports(spark, d))[0].select("line", "severity", "radius_m")


@query("WITH x AS (SELECT event_id AS node_id, round(value, 0) AS max_p, CASE WHEN event_id % 3 > 0 THEN round(value, 1) END AS max_depth, CASE WHEN event_id % 2 = 0 THEN 1.0 END AS peak_rain FROM events) SELECT *, row_number() OVER (ORDER BY max_p DESC NULLS LAST, max_depth DESC NULLS LAST, peak_rain DESC NULLS LAST, node_id)::INTEGER AS rank FROM x QUALIFY rank <= 40")
def riskiest_with_nulls(spark, d):
    i = F.col("event_id")
    rows = A.read(spark, d, "events").select(i.alias("node_id"), F.round("value", 0).alias("max_p"), F.when(i % 3 > 0, F.round("value", 1)).alias("max_depth"), F.when(i % 2 == 0, 1.0).alias("peak_rain"))
    return R.top_nodes(rows, 40)
