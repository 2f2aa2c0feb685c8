"""Grouped reports, backtests, areal skill and calibrated baselines against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.operators import learn as K
from pluvion.operators import metrics as M
from pluvion.operators import records as C
from pluvion.operators import reports as R


def plain_ranking(rows):
    """Average precision and ROC-AUC of [(y, p)] by counting over distinct scores and pairs."""
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        return None, None
    ap = sum(sum(q == s for q in pos) * sum(q >= s for q in pos) / sum(q >= s for _, q in rows) for s in set(pos)) / len(pos)
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    return ap, auc


def test_groups_ranked_together(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(rng.random() < 0.3), round(float(rng.random()), 3)) for _ in range(600)]
    rows += [(g, int(rng.random() < 0.4), round(float(rng.random()), 1)) for g in ("a", "b", None) for _ in range(40)]
    rows += [("no flood", 0, 0.5), ("only floods", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, p double").repartition(5)
    seen = {r.g: r for r in M.ranking_metrics(df, ["g"]).collect()}
    assert len(seen) == 6
    for g, r in seen.items():
        own = [(y, p) for k, y, p in rows if k == g]
        ap, auc = plain_ranking(own)
        assert (r.positives, r.rows) == (sum(y for y, _ in own), len(own))
        assert (r.average_precision, r.roc_auc) == ((None, None) if ap is None else (pytest.approx(ap), pytest.approx(auc)))
    assert M.ranking_metrics(df.where("g = 'none'"), ["g"]).count() == 0


def test_reports_of_groups_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(rng.random() < 0.4), float(round(rng.random(), 2))) for g in ("x", "y", None) for _ in range(50)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    every = {r.g: r.asDict() for r in R.reports(df, 0.5, ["g"]).collect()}
    for g in ("x", "y", None):
        one = C.evaluation_report(df.where(F.col("g").eqNullSafe(F.lit(g))), 0.5).first().asDict()
        assert {k: v for k, v in every[g].items() if k != "g"} == {k: v if v is None else pytest.approx(v) for k, v in one.items()}
    named = {r.g: r for r in C.reports_by_row(df, "g", ["y", "absent"], 0.5).collect()}
    assert set(named) == {"y", "absent"} and named["y"].tp == every["y"]["tp"]
    assert (named["absent"].tp, named["absent"].f2, named["absent"].average_precision) == (0, 0.0, None)


def test_backtest_views_thresholds_and_rain(spark):
    scores, mean = [], {}
    rng = np.random.default_rng(5)
    for name, lead, members in (("exact", 0, 1), ("forecast", 24, 3)):
        for t in range(13):
            for node in range(4):
                y, ps = int(rng.random() < 0.3), [float(round(rng.random(), 2)) for _ in range(members)]
                scores += [(name, lead, m, t, node, y, p) for m, p in enumerate(ps)]
                mean[name, t, node] = (y, round(sum(ps) / members, 6))
    df = spark.createDataFrame(scores, "row_name string, lead_h int, member int, t long, node_id long, y int, p double")
    limits = {"exact": 0.5, "forecast": 0.4}
    thresholds = spark.createDataFrame(list(limits.items()), "row_name string, threshold double")
    rain = spark.createDataFrame([("forecast", 24, t, float(t % 3), float(t % 4)) for t in range(13)], "row_name string, lead_h int, t long, forecast double, observed double")
    got = {(r.row_name, r.scored): r for r in R.backtest_report(df, thresholds, rain, blocks=(6,), start=1).collect()}
    assert len(got) == 6
    for (name, view), r in got.items():
        cells = {}
        for (row, t, node), (y, p) in mean.items():
            if row == name:
                key = {"node hours": (t, node), "any node": t, "6 h windows": (node, (t - 1) // 6)}[view]
                a, b = cells.get(key, (0, 0.0))
                cells[key] = (max(a, y), max(b, p))
        own = list(cells.values())
        assert r.tp == sum(y and p >= limits[name] for y, p in own) and r.fp == sum(not y and p >= limits[name] for y, p in own)
        assert r.tp + r.fp + r.fn + r.tn == len(own) and r.threshold == limits[name] and r.n_members == {"exact": 1, "forecast": 3}[name]
        ap, auc = plain_ranking(own)
        assert r.average_precision == (None if ap is None else pytest.approx(ap)) and r.roc_auc == (None if auc is None else pytest.approx(auc))
        assert (r.mae is None) == (name == "exact")
    assert got["forecast", "any node"].observed_total == sum(t % 4 for t in range(13))
    assert R.backtest_report(df.limit(0), thresholds, rain).count() == 0
    with pytest.raises(Exception, match="no threshold for exact"):
        R.backtest_report(df, thresholds.where("row_name = 'forecast'"), rain).collect()


def test_areal_rows(spark):
    members = spark.createDataFrame([(m, 0, n, 0.1 * m + 0.2 * n) for m in (3, 5) for n in (0, 1)], "member int, t int, node_id int, p double")
    exact = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1)], "t int, node_id int, p double")
    got = {(r.row_name, r.node_id): r.p for r in R.areal_rows(exact, members, exact.withColumn("p", F.lit(0.5))).collect()}
    assert got == {
        ("exact", 0): 0.9, ("exact", 1): 0.1, ("ensemble", 0): 0.4, ("ensemble", 1): 0.6, ("one member", 0): 0.3, ("one member", 1): 0.5,
        ("uniform", 0): 0.5, ("uniform", 1): 0.5,
    }
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "t int, node_id int, y int")
    skill = {r.row_name: r.average_precision for r in R.areal_skill(exact, members, exact.withColumn("p", F.lit(0.5)), labels, 0.5).collect()}
    assert skill == {"exact": 1.0, "ensemble": 0.5, "one member": 0.5, "uniform": 0.5}
    assert {r.member: r.roc_auc for r in R.member_rankings(members, labels).collect()} == {3: 0.0, 5: 0.0}


def test_baseline_chooses_on_validation_only(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        x = float(rng.normal())
        part = ("train", "validation", "test")[i % 3]
        rows.append((part, int(rng.random() < 1 / (1 + np.exp(3 - 2 * x))), x))
    df = spark.createDataFrame(rows, "part string, y int, x double")
    fit = lambda train: K.fit_logistic(train, ["x"], "y")
    got = {(r.part, r.calibrated): r for r in R.baseline_report(df, "part", ["x"], fit).collect()}
    assert set(got) == {(p, c) for p in ("validation", "test") for c in (True, False)}
    for part in ("validation", "test"):  # a rising map keeps the ranking; weights of balanced classes are undone
        a, b = got[part, True], got[part, False]
        assert a.average_precision == pytest.approx(b.average_precision) and a.slope > 0 and b.slope is None and b.threshold == 0.5
    assert got["validation", True].log_loss < got["validation", False].log_loss and got["test", True].brier < got["test", False].brier
    # flipping the labels of the test part changes no choice
    other = R.baseline_report(df.withColumn("y", F.when(F.col("part") == "test", 1 - F.col("y")).otherwise(F.col("y"))), "part", ["x"], fit)
    same = {(r.part, r.calibrated): r for r in other.collect()}
    assert (same["test", True].threshold, same["test", True].slope) == (got["test", True].threshold, pytest.approx(got["test", True].slope))
    model, own = fit(df.where("part = 'train'")), df.where("part = 'validation'")
    z = M.platt(M.logit(F.col("p")), got["test", True].slope, got["test", True].intercept)
    scored = [(r.y, r.q) for r in K.probability(model, own, ["x"]).select("y", z.alias("q")).collect()]

    def f2(at):
        tp, fp, fn = (sum(1 for y, q in scored if (q >= at) == a and y == b) for a, b in ((True, 1), (True, 0), (False, 1)))
        return 5 * tp / (5 * tp + 4 * fn + fp)

    assert got["validation", True].f2 == pytest.approx(max(f2(q) for _, q in scored))
    with pytest.raises(ValueError):
        R.baseline_report(df.where("part <> 'validation'"), "part", ["x"], fit)
    with pytest.raises(ValueError):
        R.baseline_report(df.where("y = 0"), "part", ["x"], fit)
