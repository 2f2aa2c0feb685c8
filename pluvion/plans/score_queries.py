"""Queries of scores, ensembles, label diagnostics, features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import features as X
from ..operators import learn as K
from ..operators import metrics as M
from ..operators import results as R
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


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


COUNTS = "c AS (SELECT count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y <> 1) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y <> 1) AS tn FROM scores)"


@query(
    f"WITH {COUNTS} SELECT tp, fp, fn, tn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fn + fp), 8) AS f1, "
    "round(5 * tp / (5 * tp + 4 * fn + fp), 8) AS f2, round(tp / (tp + fp + fn), 8) AS csi, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, "
    "round(tn / (tn + fp), 8) AS specificity, round((tp + fn) / (tp + fp + fn + tn), 8) AS positive_rate, round((tp + fp) / (tp + fp + fn + tn), 8) AS alert_rate FROM c"
)
def confusion_scores(spark, d):
    names = ("precision", "recall", "f1", "f2", "csi", "accuracy", "specificity", "positive_rate", "alert_rate")
    return rounded(M.confusion(A.scores(spark, d), 0.5), 8, *names)


@query(
    "WITH c AS (SELECT source, count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y <> 1) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p < 0.5 AND y <> 1) AS tn FROM scores GROUP BY source) "
    "SELECT source, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 8) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 8) AS recall, "
    "round(CASE WHEN tp + fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) END, 8) AS f2 FROM c"
)
def confusion_by_source(spark, d):
    out = M.confusion(A.scores(spark, d), 0.5, ["source"], None)
    return rounded(out.select("source", "tp", "fp", "fn", "tn", "precision", "recall", "f2"), 8, "precision", "recall", "f2")


CUMULATIVE = (
    "g AS (SELECT p, sum(y)::BIGINT AS pos, count(*) AS n FROM scores GROUP BY p), "
    "u AS (SELECT *, (sum(pos) OVER (ORDER BY p DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY p DESC))::BIGINT AS alerts FROM g)"
)


@query(f"WITH {CUMULATIVE} SELECT p, pos, n, tp, alerts FROM u")
def score_ladder(spark, d):
    return M.cumulative_counts(A.scores(spark, d))


@query(
    f"WITH {CUMULATIVE}, s AS (SELECT sum(pos * tp / alerts) AS ap, sum((n - pos) * (tp - pos / 2)) AS auc, sum(pos)::BIGINT AS positives, sum(n)::BIGINT AS rows FROM u) "
    "SELECT round(ap / positives, 8) AS average_precision, round(auc / (positives * (rows - positives)), 8) AS roc_auc, positives, rows FROM s"
)
def ranking_scores(spark, d):
    return rounded(M.ranking_metrics(A.scores(spark, d)), 8, "average_precision", "roc_auc")


@query("SELECT round(avg(pow(p - y, 2)), 8) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 8) AS log_loss FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM scores)")
def brier_and_log_loss(spark, d):
    return rounded(M.brier_and_log_loss(A.scores(spark, d)), 8, "brier", "log_loss")


BEST = (
    "cand AS (SELECT DISTINCT c FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS c UNION ALL SELECT p FROM scores WHERE y = 1)), "
    "k AS (SELECT c, count_if(p >= c AND y = 1) AS tp, count_if(p >= c AND y <> 1) AS fp, count_if(p < c AND y = 1) AS fn FROM cand, scores GROUP BY c), "
    "f AS (SELECT c, 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) AS s FROM k), t AS (SELECT list(c ORDER BY c) AS cs, max(s) AS s FROM f WHERE s >= (SELECT max(s) FROM f) - 1e-12)"
)


@query(f"WITH {BEST} SELECT cs[(len(cs) // 2) + 1] AS threshold, round(s, 8) AS score FROM t")
def best_f2_threshold(spark, d):
    grid = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    return rounded(M.best_threshold(A.scores(spark, d), "f2", grid), 8, "score")


BINS = (
    "b AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM scores GROUP BY 1), "
    "r AS (SELECT k::BIGINT AS bin, k / 10 AS lo, (k + 1) / 10 AS hi, coalesce(n, 0) AS n, mp, ob FROM (SELECT unnest(range(10)) AS k) LEFT JOIN b ON b.bin = k)"
)


@query(f"WITH {BINS} SELECT bin, lo, hi, n, round(mp, 8) AS mean_p, round(ob, 8) AS observed FROM r")
def reliability_curve(spark, d):
    return rounded(M.reliability(A.scores(spark, d), 10), 8, "mean_p", "observed")


@query(f"WITH {BINS} SELECT round(sum(n * abs(mp - ob)) / sum(n), 8) AS ece, round(max(abs(mp - ob)), 8) AS mce FROM r")
def calibration_errors(spark, d):
    return rounded(M.calibration_errors(M.reliability(A.scores(spark, d), 10)), 8, "ece", "mce")


@query("WITH g AS (SELECT source, max(y) AS y, max(p) AS p FROM scores GROUP BY source) SELECT count_if(p >= 0.9 AND y = 1) AS tp, count_if(p >= 0.9 AND y <> 1) AS fp, count_if(p < 0.9 AND y = 1) AS fn, count_if(p < 0.9 AND y <> 1) AS tn FROM g")
def any_in_source(spark, d):
    return M.confusion(M.any_in_group(A.scores(spark, d), ["source"]), 0.9).select("tp", "fp", "fn", "tn")


@query("SELECT round(least(greatest((1 - avg(y)) / avg(y), 1.0), 1000.0), 8) AS pos_weight FROM scores")
def class_weight(spark, d):
    return rounded(M.class_weight(A.scores(spark, d)), 8, "pos_weight")


@query(
    "SELECT round(avg(CASE WHEN y = 1 THEN 0.75 ELSE 0.25 END * pow(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2) * -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 8) AS focal, "
    "round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 8) AS cross_entropy FROM (SELECT y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM scores)"
)
def focal_loss(spark, d):
    return rounded(M.focal_loss(A.scores(spark, d), 0.75, 2.0), 8, "focal", "cross_entropy")


@query("SELECT doc_id, round(1 / (1 + exp(-(0.8 * ln(q / (1 - q)) - 0.4))), 8) AS calibrated FROM (SELECT doc_id, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM scores)")
def calibrated_scores(spark, d):
    return A.scores(spark, d).select("doc_id", F.round(M.platt(M.logit(F.col("p")), 0.8, -0.4), 8).alias("calibrated"))


@query("SELECT t, node_id, round(avg(p), 8) AS p, round(stddev_pop(p), 6) AS spread, round(avg(rain), 4) AS rain FROM members GROUP BY t, node_id")
def ensemble_mean(spark, d):
    out = R.ensemble(A.members(spark, d))
    return out.select("t", "node_id", F.round("p", 8).alias("p"), F.round("spread", 6).alias("spread"), F.round("rain", 4).alias("rain"))


@query("WITH m AS (SELECT node_id, member, max(p) AS p FROM members GROUP BY 1, 2) SELECT node_id, count(*) AS members, count_if(p >= 0.9) AS at_risk, round(avg(CASE WHEN p >= 0.9 THEN 1.0 ELSE 0.0 END), 8) AS share FROM m GROUP BY node_id")
def members_at_risk(spark, d):
    return rounded(R.members_at_risk(A.members(spark, d), 0.9), 8, "share")


@query("WITH m AS (SELECT node_id, member, max(p) AS p FROM members GROUP BY 1, 2), c AS (SELECT member, count_if(p >= 0.9) AS n FROM m GROUP BY member) SELECT min(n) AS least, max(n) AS most FROM c")
def risk_range(spark, d):
    return R.risk_range(A.members(spark, d), 0.9)


MEAN = "mean AS (SELECT t, node_id, round(avg(p), 6) AS p, round(stddev_pop(p), 6) AS spread, round(avg(rain), 4) AS rain, round(avg(depth), 7) AS depth FROM members GROUP BY 1, 2)"


def _mean(spark, d):
    return rounded(R.ensemble(A.members(spark, d)), 6, "p", "spread").withColumns({"rain": F.round("rain", 4), "depth": F.round("depth", 7)})


@query(f"WITH {MEAN}, f AS (SELECT min(t) AS t0 FROM mean) SELECT node_id, max(p) AS p, arg_min(t, (-p, t)) AS peak_t FROM mean, f WHERE t BETWEEN t0 AND t0 + 23 GROUP BY node_id")
def horizon_maxima(spark, d):
    rows = _mean(spark, d)
    return R.horizon_max(rows, rows.agg(F.min("t")).first()[0], 24)


TIER = "CASE WHEN max_p >= 0.75 THEN 'Severe' WHEN max_p >= 0.5 THEN 'High' WHEN max_p >= 0.25 THEN 'Moderate' ELSE 'Low' END"
NODE_TABLE = (
    f"{MEAN}, nt AS (SELECT node_id, max(p) AS max_p, arg_min(spread, (-p, t)) AS spread_at_peak, arg_min(t, (-p, t)) AS peak_t, arg_min(rain, (-p, t)) AS peak_rain, "
    "round(sum(rain), 3) AS total_rain, round(max(depth), 7) AS max_depth FROM mean GROUP BY node_id), "
    "mr AS (SELECT node_id, avg(CASE WHEN p >= 0.9 THEN 1.0 ELSE 0.0 END) AS member_share FROM (SELECT node_id, member, max(p) AS p FROM members GROUP BY 1, 2) GROUP BY node_id)"
)


def _node_table(spark, d):
    out = R.node_table(_mean(spark, d), R.members_at_risk(A.members(spark, d), 0.9), 0.9)
    return out.withColumn("total_rain", F.round("total_rain", 3))


@query(f"WITH {NODE_TABLE} SELECT node_id, max_p, spread_at_peak, peak_t, peak_rain, total_rain, max_depth, member_share, {TIER} AS tier, max_p >= 0.9 AS alert FROM nt JOIN mr USING (node_id)")
def node_risk_table(spark, d):
    return _node_table(spark, d)


@query(f"WITH {NODE_TABLE} SELECT node_id, max_p, max_depth, peak_rain, row_number() OVER (ORDER BY max_p DESC, max_depth DESC, peak_rain DESC, node_id)::INTEGER AS rank FROM nt ORDER BY max_p DESC, max_depth DESC, peak_rain DESC, node_id LIMIT 10")
def riskiest_nodes(spark, d):
    return R.top_nodes(_node_table(spark, d), 10).select("node_id", "max_p", "max_depth", "peak_rain", "rank")


@query(f"WITH {NODE_TABLE}, k AS (SELECT {TIER} AS tier, count(*) AS n FROM nt GROUP BY 1) SELECT x.tier, coalesce(n, 0) AS nodes FROM (SELECT unnest(['Low', 'Moderate', 'High', 'Severe']) AS tier) x LEFT JOIN k ON k.tier = x.tier")
def tier_counts(spark, d):
    return R.tier_counts(_node_table(spark, d))


@query(
    f"WITH {MEAN}, f AS (SELECT min(t) AS t0 FROM mean), h AS (SELECT horizon, node_id, max(p) AS p FROM mean, f, (SELECT unnest([6, 24, 72])::INTEGER AS horizon) WHERE t < t0 + horizon GROUP BY 1, 2) "
    "SELECT horizon, count_if(p >= 0.9) AS nodes_at_risk, max(p) AS max_p FROM h GROUP BY horizon"
)
def horizon_counts(spark, d):
    rows = _mean(spark, d)
    return R.horizon_counts(rows, rows.agg(F.min("t")).first()[0], [6, 24, 72], 0.9)


@query(f"WITH {MEAN}, k AS (SELECT t, count_if(p >= 0.9) AS n, max(p) AS p FROM mean GROUP BY t) SELECT CASE WHEN max(n) > 0 THEN arg_min(t, (-n, t)) ELSE arg_min(t, (-p, t)) END AS peak_t, max(n) AS nodes_at_risk FROM k")
def peak_hour(spark, d):
    return R.peak_hour(_mean(spark, d), 0.9)


@query(f"WITH {MEAN} SELECT node_id, t, p, round(greatest(p - spread, 0.0), 6) AS p_low, round(least(p + spread, 1.0), 6) AS p_high, rain FROM mean")
def junction_timeline(spark, d):
    return rounded(R.junction_timeline(_mean(spark, d)), 6, "p_low", "p_high").drop("depth")


@query("SELECT source AS model, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS rate FROM scores GROUP BY source")
def metrics_by_model(spark, d):
    per = A.scores(spark, d).groupBy(F.col("source").alias("model")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    pairs = F.array(F.struct(F.lit("mean_p").alias("metric"), F.col("mean_p").alias("value")), F.struct(F.lit("rate").alias("metric"), F.col("rate").alias("value")))
    return rounded(R.metric_table(per.select("model", F.inline(pairs)), ["mean_p", "rate"]), 8, "mean_p", "rate")


@query(
    "WITH m AS (SELECT source AS model, avg(p) AS value FROM scores GROUP BY source) SELECT arg_max(model, (value, model)) AS strongest, round(max(value), 8) AS value, "
    "round((SELECT max(value) FROM m WHERE model = 'src0') - max(value), 8) AS delta FROM m WHERE model <> 'src0'"
)
def strongest_baseline(spark, d):
    per = A.scores(spark, d).groupBy(F.col("source").alias("model")).agg(F.avg("p").alias("value"))
    return rounded(R.strongest(per, "src0"), 8, "value", "delta")


LABELS = "lab AS (SELECT t, node_id, CASE WHEN rain > 300 THEN 1 ELSE 0 END AS y FROM node_hours)"


def _labels(spark, d):
    return A.node_hours(spark, d).select("t", "node_id", F.when(F.col("rain") > 300, 1).otherwise(0).alias("y"))


@query(f"WITH {LABELS}, h AS (SELECT t, avg(y) AS s FROM lab GROUP BY t) SELECT round(quantile_cont(s, 0.5), 8) AS median, round(quantile_cont(s, 0.9), 8) AS p90, round(max(s), 8) AS most, count(*) AS hours FROM h WHERE s > 0")
def flooded_share(spark, d):
    return rounded(D.flooded_share(_labels(spark, d)), 8, "median", "p90", "most")


@query(
    "WITH h AS (SELECT avg(rain) AS m, stddev_pop(rain) AS s, max(rain) AS x FROM node_hours GROUP BY t) SELECT round(quantile_cont(s / m, 0.5), 6) AS cv_median, round(quantile_cont(s / m, 0.9), 6) AS cv_p90, "
    "round(quantile_cont(x / m, 0.5), 6) AS peak_median, round(quantile_cont(x / m, 0.95), 6) AS peak_p95, count(*) AS hours FROM h WHERE m >= 40"
)
def rain_heterogeneity(spark, d):
    return rounded(D.rain_heterogeneity(A.node_hours(spark, d), 40.0), 6, "cv_median", "cv_p90", "peak_median", "peak_p95")


@query("SELECT round(count_if(rain > 300 AND rain % 2 > 1)::DOUBLE / count_if(rain > 300 OR rain % 2 > 1), 8) AS jaccard FROM node_hours")
def label_overlap(spark, d):
    other = A.node_hours(spark, d).select("t", "node_id", F.when(F.col("rain") % 2 > 1, 1).otherwise(0).alias("y"))
    return rounded(D.label_jaccard(_labels(spark, d), other), 8, "jaccard")


@query(
    f"WITH {LABELS}, q AS (SELECT node_id, avg(y) AS f FROM lab GROUP BY node_id), j AS (SELECT f, elevation FROM q JOIN nodes USING (node_id)), "
    "r AS (SELECT *, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2 AS ra, rank() OVER (ORDER BY elevation) + (count(*) OVER (PARTITION BY elevation) - 1) / 2 AS rb FROM j) "
    "SELECT round(corr(f, elevation), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r"
)
def frequency_correlation(spark, d):
    rows = D.flood_frequency(_labels(spark, d)).join(A.nodes(spark, d), "node_id")
    return rounded(D.correlations(rows, "frequency", "elevation"), 6, "pearson", "spearman")


@query(
    f"WITH {LABELS}, q AS (SELECT node_id, avg(y) AS f FROM lab GROUP BY node_id), j AS (SELECT f, elevation FROM q JOIN nodes USING (node_id)) "
    "SELECT elevation <= (SELECT quantile_cont(elevation, 0.25) FROM j) AS in_group, round(avg(f), 8) AS mean, count(*) AS n FROM j GROUP BY 1"
)
def lowest_quartile_rates(spark, d):
    rows = D.lowest_quartile(D.flood_frequency(_labels(spark, d)).join(A.nodes(spark, d), "node_id"), "elevation")
    return rounded(D.group_rates(rows, "frequency", F.col("is_lowest")), 8, "mean")


@query(
    "WITH o AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) - 1 <= 2 THEN 0 ELSE 1 END AS op FROM wet), e AS (SELECT t, (sum(op) OVER (ORDER BY t))::BIGINT AS event_id FROM o), "
    "g AS (SELECT event_id, min(t) AS first_t, max(t) AS last_t FROM e GROUP BY 1), u AS (SELECT *, least(last_t + 6, coalesce(lead(first_t) OVER (ORDER BY first_t) - 1, last_t + 6)) AS till FROM g) "
    "SELECT event_id, first_t, last_t, EXISTS (SELECT 1 FROM node_hours WHERE rain > 300 AND t BETWEEN first_t AND till) AS floods FROM u"
)
def flooding_events(spark, d):
    events = S.rain_events(A.wet(spark, d), [], "mm", 0.0, 2).groupBy("event_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    flooded = _labels(spark, d).where("y = 1").select("t").distinct()
    return D.flooding_events(events, flooded, 6)


@query(
    f"WITH {LABELS}, h AS (SELECT t, avg(y) AS share, sum(rain) AS mm FROM lab JOIN node_hours USING (t, node_id) GROUP BY t), "
    "m AS (SELECT *, month(DATE '1970-01-01' + (t // 24)::INTEGER) AS mo, sum(mm) OVER (ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS s6 FROM h) "
    "SELECT round(avg(share) FILTER (WHERE mo = 1), 8) AS season_rate, count_if(share > 0) AS flooded_hours, count_if(share > 0 AND s6 < 2000) AS dry_floods FROM m"
)
def season_rates(spark, d):
    rain = A.node_hours(spark, d)
    per = _labels(spark, d).join(rain, ["t", "node_id"]).groupBy("t").agg(F.avg("y").alias("share"), F.sum("rain").alias("mm"))
    month = F.month(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 24).cast("int")))
    return rounded(D.season_rates(S.trailing_sums(per, [], "mm", [6]).withColumn("month", month), [1], 2000.0), 8, "season_rate")


@query()
def separable_lookup(spark, d):
    """Ranking of the separable score on the last part of the record, fitted on the rest."""
    rain = S.trailing_sums(A.hourly(spark, d), [], "mm", [5]).select("t", "sum_5")
    part = F.floor(F.col("t") / (24 * 10))
    return M.ranking_metrics(D.separable_score(_labels(spark, d), rain, 500.0, part))


@query(
    f"WITH RECURSIVE {LABELS}, pos AS MATERIALIZED (SELECT t, node_id FROM lab WHERE y = 1), gm AS MATERIALIZED (SELECT a.node_id AS i, b.node_id AS j, count(*)::DOUBLE AS c FROM pos a JOIN pos b USING (t) GROUP BY 1, 2), "
    "pw AS (SELECT 0 AS k, node_id, count(*)::DOUBLE AS v FROM pos GROUP BY node_id UNION ALL SELECT k + 1, j, sum(c * v) FROM pw JOIN gm ON i = pw.node_id WHERE k < 30 GROUP BY k, j), "
    "nm AS (SELECT k, sqrt(sum(v * v)) AS n FROM pw GROUP BY k), z AS (SELECT (SELECT count(*) FROM pos)::DOUBLE AS n, (SELECT count(*) FROM lab)::DOUBLE AS cells, (SELECT n FROM nm WHERE k = 30) / (SELECT n FROM nm WHERE k = 29) AS l1) "
    "SELECT round(1 - (n - l1) / (n - n * n / cells), 6) AS r2 FROM z"
)
def rank_one_label_share(spark, d):
    return rounded(spark.createDataFrame([(D.rank_one_share(_labels(spark, d)),)], "r2 double"), 6, "r2")


@query(
    f"WITH {LABELS}, s AS (SELECT avg(y) AS rate, max(s) AS most FROM lab, (SELECT max(v) AS s FROM (SELECT avg(y) AS v FROM lab GROUP BY t))) "
    "SELECT 'rate below one tenth' AS criterion, rate < 0.1 AS passed FROM s UNION ALL SELECT 'some hour floods', most > 0 FROM s"
)
def label_checks(spark, d):
    labels = _labels(spark, d)
    stats = labels.agg(F.avg("y").alias("rate")).join(F.broadcast(D.flooded_share(labels)), on=F.lit(True))
    return D.checks(stats, {"rate below one tenth": F.col("rate") < 0.1, "some hour floods": F.col("most") > 0})


@query("SELECT round(avg(ln(1 + rain)), 6) AS mean, round(stddev_pop(ln(1 + rain)), 6) AS std, count(*) AS n FROM node_hours")
def fitted_scaler(spark, d):
    out = X.fit_scaler(A.node_hours(spark, d), {"rain": True})
    return rounded(out.select("rain.*"), 6, "mean", "std")


@query(
    "WITH s AS (SELECT *, sum(rain) OVER (PARTITION BY node_id ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3 FROM node_hours), "
    "f AS (SELECT avg(ln(1 + rain)) AS m1, stddev_pop(ln(1 + rain)) AS d1, avg(ln(1 + s3)) AS m2, stddev_pop(ln(1 + s3)) AS d2 FROM s) "
    "SELECT node_id, t, round((ln(1 + rain) - m1) / d1, 5) AS rain, round((ln(1 + s3) - m2) / d2, 5) AS sum_3 FROM s, f"
)
def model_features(spark, d):
    rain = A.node_hours(spark, d)
    static = rain.select("node_id").distinct()
    columns = {"rain": True, "sum_3": True}
    scaler = X.fit_scaler(S.trailing_sums(rain, ["node_id"], "rain", [3]), columns)
    out = X.node_features(static, rain, "node_id", [3], scaler, columns)
    return rounded(out.select("node_id", "t", "rain", "sum_3"), 5, "rain", "sum_3")


@query(
    "SELECT node_id, t, round((0.3 + 0.5 * least(rain / 500, 1.0)) * greatest(rain - 5, 0.0) * 1000 / 1000, 3) AS runoff, round(1 / (1 + exp(-(rain / 1000 - 0.15) / 0.05)), 8) AS p, "
    "round(0.9 * 20 / (20 + rain), 8) AS stratiform FROM node_hours"
)
def runoff_and_probability(spark, d):
    rain = F.col("rain")
    return A.node_hours(spark, d).select(
        "node_id", "t", F.round(X.runoff_m3(rain, F.least(rain / 500, F.lit(1.0)), 5.0, F.lit(1000.0), 0.3, 0.8), 3).alias("runoff"),
        F.round(X.flood_probability(rain / 1000, 0.15, 0.05), 8).alias("p"), F.round(X.stratiform_share(rain, 0.9, 20.0), 8).alias("stratiform"),
    )


@query()
def leaky_stores(spark, d):
    """The store of every node after each of its hours."""
    rows = A.node_hours(spark, d).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("t", "rain"))).alias("r"))
    path = X.store_step(F.transform("r", lambda x: x["rain"]), F.lit(60.0), 400.0)
    return rows.select("node_id", F.inline(F.arrays_zip(F.col("r.t").alias("t"), path.alias("s")))).select("node_id", "t", "s.store", "s.spill")


@query(
    "WITH u AS (SELECT doc_id, y, source, ('0x' || substr(md5(concat_ws('|', doc_id, '5')), 1, 8))::BIGINT / 4294967296.0 AS u FROM scores) "
    "SELECT doc_id, y, source FROM u QUALIFY row_number() OVER (PARTITION BY source, y ORDER BY u, doc_id) <= 3"
)
def balanced_training_sample(spark, d):
    return K.balanced_sample(A.scores(spark, d).select("doc_id", "y", "source"), ["source"], "y", 3, ["doc_id"], 5)


@query(
    "WITH u AS (SELECT t, ('0x' || substr(md5(concat_ws('|', t, '9')), 1, 8))::BIGINT / 4294967296.0 AS u, CASE WHEN mm > 1000 THEN 3.0 ELSE 1.0 END AS w FROM hourly) "
    "SELECT t, (SELECT count(*) FROM (SELECT unnest(range(12)) AS k) WHERE u >= (SELECT sum(exp(-w) * pow(w, i) / factorial(i::INTEGER)) FROM (SELECT unnest(range(12)) AS i) WHERE i <= k)) AS copies FROM u WHERE copies > 0"
)
def oversampled_hours(spark, d):
    w = F.when(F.col("mm") > 1000, 3.0).otherwise(1.0)
    drawn = K.weighted_sample(A.hourly(spark, d), w, 9)
    return drawn.groupBy("t").agg(F.count("*").alias("copies"))


@query()
def platt_fit(spark, d):
    return spark.createDataFrame([(*K.fit_platt(A.scores(spark, d)), K.fit_temperature(A.scores(spark, d)))], "slope double, intercept double, temperature double")


def _supervised(spark, d):
    rows = S.trailing_sums(A.node_hours(spark, d), ["node_id"], "rain", [3, 24])
    nxt = rows.select("node_id", (F.col("t") - 1).alias("t"), (F.col("rain") > 60).cast("int").alias("y"))
    return rows.join(nxt, ["node_id", "t"]).withColumn("held", F.col("t") % 5 == 0)


@query()
def logistic_baseline(spark, d):
    """Held-out ranking of a balanced logistic model of the next hour's rain."""
    rows, names = _supervised(spark, d), ["rain", "sum_3", "sum_24"]
    model = K.fit_logistic(rows.where("not held"), names, "y")
    return M.ranking_metrics(K.probability(model, rows.where("held"), names))


@query()
def boosted_baseline(spark, d):
    """The same by boosted trees that stop early."""
    rows, names = _supervised(spark, d), ["rain", "sum_3", "sum_24"]
    model = K.fit_trees(rows.where("not held").withColumn("check", F.col("t") % 7 == 0), names, "y", "check", rounds=8, depth=3)
    return M.ranking_metrics(K.probability(model, rows.where("held"), names))
