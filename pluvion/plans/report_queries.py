"""Queries of whole reports: backtests with leads and views, areal skill, members one by one, calibrated baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as K
from ..operators import reports as R
from . import adapters as A
from .score_queries import LABELS, _labels, _supervised, rounded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


SCORES = ["precision", "recall", "f2", "csi", "average_precision", "roc_auc", "brier", "ece", "mce"]


def report_sql(rows: str, g: str, threshold: str) -> str:
    """Common table expressions that end in rp(g, counts, scores), as a report makes it of rows(g, y, p)."""
    case = lambda a, b, c: f"round(CASE WHEN {b} > 0 THEN {a} / ({b}) END, 8) AS {c}"
    return (
        f"c0 AS (SELECT {g}, p, sum(y) AS pos, count(*) AS n FROM {rows} GROUP BY {g}, p), "
        f"r0 AS (SELECT *, sum(pos) OVER w AS up, sum(n) OVER w AS al FROM c0 WINDOW w AS (PARTITION BY {g} ORDER BY p DESC)), "
        f"m0 AS (SELECT {g}, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * up / al) / sum(pos) END AS ap, "
        f"CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum((n - pos) * (up - pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos))) END AS auc FROM r0 GROUP BY {g}), "
        f"b0 AS (SELECT {g}, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM {rows} GROUP BY {g}, bin), "
        f"e0 AS (SELECT {g}, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b0 GROUP BY {g}), "
        f"k0 AS (SELECT {g}, count_if(p >= {threshold} AND y = 1) AS tp, count_if(p >= {threshold} AND y = 0) AS fp, count_if(p < {threshold} AND y = 1) AS fn, "
        f"count_if(p < {threshold} AND y = 0) AS tn, avg(pow(p - y, 2)) AS brier FROM {rows} GROUP BY {g}), "
        f"rp AS (SELECT {g}, tp, fp, fn, tn, {case('tp', 'tp + fp', 'precision')}, {case('tp', 'tp + fn', 'recall')}, {case('5.0 * tp', '5.0 * tp + 4.0 * fn + fp', 'f2')}, "
        f"{case('tp', 'tp + fp + fn', 'csi')}, round(ap, 8) AS average_precision, round(auc, 8) AS roc_auc, round(brier, 8) AS brier, round(ece, 8) AS ece, round(mce, 8) AS mce "
        f"FROM k0 JOIN m0 USING ({g}) JOIN e0 USING ({g}))"
    )


#: Areal rain of an hour, and what a lead forecasts of it: the areal rain so many hours before, scaled.
AREAL = "am AS (SELECT t, round(sum(rain) / 7, 4) AS mm FROM node_hours GROUP BY t)"
DRIVERS = (
    f"{AREAL}, rr AS (SELECT 'replayed' AS row_name, 0 AS lead_h, t, mm AS forecast, mm AS observed FROM am UNION ALL SELECT 'ceiling', 0, t, mm, mm FROM am "
    "UNION ALL SELECT 'forecast', l, o.t, round(f.mm * (1 + l // 24) / 7, 4), o.mm FROM am o, (SELECT unnest([24, 48])::INTEGER AS l), am f WHERE f.t = o.t - l)"
)
BACKTEST = (
    f"{LABELS}, {DRIVERS}, mb AS (SELECT 'replayed' AS row_name, 0 AS lead_h, t, node_id, y, least(round(rain / 700, 6), 1.0) AS p FROM node_hours JOIN lab USING (t, node_id) "
    "UNION ALL SELECT row_name, lead_h, t, node_id, y, least(round(forecast * (4 + m) / 3500, 6), 1.0) FROM rr JOIN lab USING (t), (SELECT unnest([0, 1, 2])::INTEGER AS m) WHERE row_name <> 'replayed'), "
    "sv AS (SELECT row_name, lead_h, t, node_id, max(y) AS y, round(avg(p), 6) AS p, count(*) AS n_members, CASE row_name WHEN 'replayed' THEN 0.5 WHEN 'ceiling' THEN 0.45 ELSE 0.4 END::DOUBLE AS threshold FROM mb GROUP BY row_name, lead_h, t, node_id), "
    "lg AS (SELECT row_name, lead_h, threshold, 'node hours' AS scored, y, p FROM sv UNION ALL SELECT row_name, lead_h, any_value(threshold), 'any node', max(y), max(p) FROM sv GROUP BY row_name, lead_h, t "
    "UNION ALL SELECT row_name, lead_h, any_value(threshold), '6 h windows', max(y), max(p) FROM sv GROUP BY row_name, lead_h, node_id, floor(t / 6.0)), "
    f"{report_sql('lg', 'row_name, lead_h, scored', 'threshold')}, "
    "fa AS (SELECT row_name, lead_h, max(n_members) AS n_members, max(threshold) AS threshold FROM sv GROUP BY row_name, lead_h), "
    "sk AS (SELECT row_name, lead_h, round(sum(observed), 6) AS observed_total, round(sum(forecast), 6) AS forecast_total, max(observed) AS observed_peak, max(forecast) AS forecast_peak, round(avg(abs(forecast - observed)), 8) AS mae, "
    "round(CASE WHEN stddev_pop(observed) > 0 AND stddev_pop(forecast) > 0 THEN corr(observed, forecast) END, 8) AS correlation, "
    "round(CASE WHEN count_if(observed >= 1) > 0 THEN count_if(observed >= 1 AND forecast >= 1) / count_if(observed >= 1) END, 8) AS wet_hit_rate FROM rr GROUP BY row_name, lead_h)"
)


def _areal(spark, d):
    return A.node_hours(spark, d).groupBy("t").agg(F.round(F.sum("rain") / 7, 4).alias("mm"))


def _drivers(spark, d):
    now = _areal(spark, d)
    out = None
    for name in ("replayed", "ceiling"):
        one = now.select(F.lit(name).alias("row_name"), F.lit(0).alias("lead_h"), "t", F.col("mm").alias("forecast"), F.col("mm").alias("observed"))
        out = one if out is None else out.unionByName(one)
    before = now.select(F.explode(F.array(F.lit(24), F.lit(48))).alias("lead_h"), F.col("t").alias("issued"), F.col("mm").alias("was"))
    before = before.select("lead_h", (F.col("issued") + F.col("lead_h")).alias("t"), F.round(F.col("was") * (1 + F.floor(F.col("lead_h") / 24)) / 7, 4).alias("forecast"))
    return out.unionByName(before.join(now, "t").select(F.lit("forecast").alias("row_name"), "lead_h", "t", "forecast", F.col("mm").alias("observed")))


@query(
    f"WITH {BACKTEST} SELECT rp.*, n_members, threshold, observed_total, forecast_total, observed_peak, forecast_peak, mae, correlation, wet_hit_rate "
    "FROM rp JOIN fa USING (row_name, lead_h) JOIN sk USING (row_name, lead_h)"
)
def forecast_backtest_report(spark, d):
    """Four rows (replayed field, ceiling, two leads), each at its own threshold, by node hours, hours and warning windows."""
    hours, drivers = A.node_hours(spark, d), _drivers(spark, d)
    labels = _labels(spark, d)
    score = lambda x, by: F.least(F.round(x / by, 6), F.lit(1.0)).alias("p")
    replayed = hours.join(labels, ["t", "node_id"]).select(F.lit("replayed").alias("row_name"), F.lit(0).alias("lead_h"), F.lit(0).alias("member"), "t", "node_id", "y", score(F.col("rain"), 700))
    others = drivers.where("row_name <> 'replayed'").withColumn("member", F.explode(F.array(*map(F.lit, range(3))))).join(labels, "t")
    others = others.select("row_name", "lead_h", "member", "t", "node_id", "y", score(F.col("forecast") * (4 + F.col("member")), 3500))
    thresholds = spark.createDataFrame([("replayed", 0.5), ("ceiling", 0.45), ("forecast", 0.4)], "row_name string, threshold double")
    out = R.backtest_report(replayed.unionByName(others), thresholds, drivers)
    names = ["row_name", "lead_h", "scored", "tp", "fp", "fn", "tn", *SCORES, "n_members", "threshold", "observed_total", "forecast_total", "observed_peak", "forecast_peak", "mae", "correlation", "wet_hit_rate"]
    return rounded(rounded(out.select(*names), 8, *SCORES, "mae", "correlation", "wet_hit_rate"), 6, "observed_total", "forecast_total")


@query(
    f"WITH {LABELS}, {AREAL}, ar AS (SELECT 'exact' AS row_name, t, node_id, round(least(rain / 700, 1.0), 6) AS p FROM node_hours UNION ALL SELECT 'ensemble', t, node_id, round(avg(p), 6) FROM members GROUP BY t, node_id "
    "UNION ALL SELECT 'one member', t, node_id, round(p, 6) FROM members WHERE member = 0 UNION ALL SELECT 'uniform', t, node_id, round(least(mm / 700, 1.0), 6) FROM node_hours JOIN am USING (t)), "
    f"sa AS (SELECT row_name, y, p FROM ar JOIN lab USING (t, node_id)), {report_sql('sa', 'row_name', '0.5')} SELECT * FROM rp"
)
def areal_skill_rows(spark, d):
    """Scores with the exact field, an ensemble, one of its members, and the same rain everywhere."""
    hours = A.node_hours(spark, d)
    p = lambda c: F.least(F.col(c) / 700, F.lit(1.0)).alias("p")
    uniform = hours.join(_areal(spark, d), "t").select("t", "node_id", p("mm"))
    out = R.areal_skill(hours.select("t", "node_id", p("rain")), A.members(spark, d), uniform, _labels(spark, d), 0.5)
    return rounded(out.select("row_name", "tp", "fp", "fn", "tn", *SCORES), 8, *SCORES)


@query(
    f"WITH {LABELS}, sm AS (SELECT member, y, round(p, 6) AS p FROM members JOIN lab USING (t, node_id)), {report_sql('sm', 'member', '0.5')} "
    "SELECT member, average_precision, roc_auc, (tp + fn)::BIGINT AS positives, (tp + fp + fn + tn)::BIGINT AS rows FROM rp"
)
def member_rankings(spark, d):
    return rounded(R.member_rankings(A.members(spark, d), _labels(spark, d)), 8, "average_precision", "roc_auc")


@query()
def baseline_report(spark, d):
    """A logistic model of the next hour's rain, calibrated and given its threshold on validation hours."""
    names = ["rain", "sum_3", "sum_24"]
    part = F.when(F.col("t") % 5 == 0, "test").when(F.col("t") % 5 == 1, "validation").otherwise("train")
    rows = _supervised(spark, d).withColumn("part", part)
    return R.baseline_report(rows, "part", names, lambda train: K.fit_logistic(train, names, "y"))
