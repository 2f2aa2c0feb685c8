"""Reports of many rows at once: every score of every group of a long table in one pass, backtests, skill, baselines.

Scores of an ensemble are rounded to six places, so that equal members tie whatever the order of their sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learn as K
from . import metrics as M
from .components import cut

KEYS = ("row_name", "lead_h")


def side_by_side(parts: Sequence[DataFrame], groups: Sequence[str] = ()) -> DataFrame:
    """Tables with one row a group as one table; a null group meets itself. Without groups each has one row."""
    out = parts[0]
    for part in parts[1:]:
        if not groups:
            out = out.join(F.broadcast(part), on=F.lit(True))  # one row each
            continue
        other = part.select(*[F.col(g).alias(f"_other_{g}") for g in groups], *[c for c in part.columns if c not in groups])
        on = F.lit(True)
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"_other_{g}"))
        out = out.join(other, on).drop(*[f"_other_{g}" for g in groups])
    return out


def reports(df: DataFrame, threshold: float | Column, groups: Sequence[str] = (), bins: int = 10, undefined: float | None = 0.0) -> DataFrame:
    """(groups, counts and scores at the threshold, average precision, ROC-AUC, Brier, log loss, ece, mce) of df(groups, y, p).

    The threshold may be a column of df. Groups are ranked together by range, so a group of any size is spread over tasks.
    Ranking scores are null for a group of one class; 0/0 at the threshold is `undefined`. A group without rows has none here.
    """
    return side_by_side(
        [
            M.confusion(df, threshold, groups, undefined), M.ranking_metrics(df, groups), M.brier_and_log_loss(df, groups),
            M.calibration_errors(M.filled_bins(df, bins, groups), groups),
        ],
        groups,
    )


def scored_views(scores: DataFrame, keys: Sequence[str], blocks: Sequence[int] = (6,), start: int = 0) -> DataFrame:
    """(keys, threshold, scored, y, p) of scores(keys, threshold, t, node_id, y, p): what a forecast is judged by.

    scored: `node hours` as they are; `any node`, an hour's highest label and score; `b h windows`, a node's highest ones
    in the warning windows of b hours that follow one another from `start`.
    """
    highest = (F.max("y").alias("y"), F.max("p").alias("p"))
    columns = [*keys, "threshold"]
    out = scores.select(*columns, F.lit("node hours").alias("scored"), "y", "p")
    some = scores.groupBy(*columns, "t").agg(*highest)
    out = out.unionByName(some.select(*columns, F.lit("any node").alias("scored"), "y", "p"))
    for b in blocks:
        window = F.floor((F.col("t") - start) / b).alias("window")
        per = scores.groupBy(*columns, "node_id", window).agg(*highest)
        out = out.unionByName(per.select(*columns, F.lit(f"{b} h windows").alias("scored"), "y", "p"))
    return out


def backtest_report(
    scores: DataFrame, thresholds: DataFrame, rain: DataFrame, blocks: Sequence[int] = (6,), start: int = 0, wet: float = 1.0, bins: int = 10
) -> DataFrame:
    """One row for each row_name, lead_h and view: members, threshold, all scores of the report, skill of the driving rain.

    scores(row_name, lead_h, member, t, node_id, y, p): a row's members are averaged; a replayed field has one member.
    thresholds(row_name, threshold): each row is judged at its own, and a row without one is an error when read.
    rain(row_name, lead_h, t, forecast, observed): the areal rain that drove the row; a row without any has null skill.
    Scores without a case to judge are null. Empty scores give an empty report. Lays the averaged scores down when called.
    """
    mean = scores.groupBy(*KEYS, "t", "node_id").agg(F.max("y").alias("y"), F.round(F.avg("p"), 6).alias("p"), F.count("*").alias("n_members"))
    lacking = F.raise_error(F.concat(F.lit("no threshold for "), F.col("row_name"))).cast("double")
    served = mean.join(thresholds.select("row_name", F.col("threshold").alias("at")), "row_name", "left")
    served = cut(served.withColumn("threshold", F.coalesce("at", lacking)).drop("at"))
    facts = served.groupBy(*KEYS).agg(F.max("n_members").alias("n_members"), F.max("threshold").alias("threshold"))
    report = reports(cut(scored_views(served, KEYS, blocks, start)), F.col("threshold"), [*KEYS, "scored"], bins, None)
    return report.join(facts, list(KEYS)).join(M.rain_skill(rain, KEYS, wet), list(KEYS), "left")


def areal_rows(exact: DataFrame, members: DataFrame, uniform: DataFrame) -> DataFrame:
    """(row_name, t, node_id, p): the exact field, the members' mean, the first member alone, and uniform rain."""
    p = F.round("p", 6).alias("p")
    first = members.agg(F.min("member").alias("first"))
    alone = members.join(F.broadcast(first), F.col("member") == F.col("first"))
    rows = {
        "exact": exact.select("t", "node_id", p), "ensemble": members.groupBy("t", "node_id").agg(F.round(F.avg("p"), 6).alias("p")),
        "one member": alone.select("t", "node_id", p), "uniform": uniform.select("t", "node_id", p),
    }
    out = None
    for name, df in rows.items():
        named = df.select(F.lit(name).alias("row_name"), "t", "node_id", "p")
        out = named if out is None else out.unionByName(named)
    return out


def areal_skill(exact: DataFrame, members: DataFrame, uniform: DataFrame, labels: DataFrame, threshold: float, bins: int = 10) -> DataFrame:
    """(row_name, all scores of the report): what is lost when the exact rain field is not known.

    exact and uniform(t, node_id, p); members(member, t, node_id, p); labels(t, node_id, y) decide which node-hours count.
    """
    rows = areal_rows(exact, members, uniform).join(labels.select("t", "node_id", "y"), ["t", "node_id"])
    return reports(cut(rows.select("row_name", "y", "p")), threshold, ["row_name"], bins, None)


def member_rankings(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(member, average_precision, roc_auc, positives, rows) of every member by itself, all ranked in one pass."""
    rows = members.select("member", "t", "node_id", F.round("p", 6).alias("p")).join(labels.select("t", "node_id", "y"), ["t", "node_id"])
    return M.ranking_metrics(rows.select("member", "y", "p"), ["member"])


def baseline_report(
    rows: DataFrame, part: str, features: Sequence[str], fit: Callable[[DataFrame], object], metric: str = "f2", grid: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9),
    bins: int = 10,
) -> DataFrame:
    """(part, calibrated, threshold, slope, intercept, all scores) of a model of rows(part, y, features).

    fit gets the rows of part `train`. Platt's slope and intercept and the best threshold by `metric` are chosen on part
    `validation`; validation and `test` are judged at it. Rows with calibrated false are the model's own probabilities,
    judged at 0.5. Without train or validation rows, or without a positive one in train, there is no baseline: an error.
    """
    seen = rows.where(F.col(part) == "train").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive")).first()
    if seen["n"] == 0 or seen["positive"] == 0:
        raise ValueError("no baseline: no positive training row")
    model = fit(rows.where(F.col(part) == "train"))
    own = cut(K.probability(model, rows.where(F.col(part).isin("validation", "test")), features).select(part, "y", "p"))
    checked = own.where(F.col(part) == "validation")
    if checked.isEmpty():
        raise ValueError("no baseline: no validation row")
    slope, intercept = K.fit_platt(checked)
    calibrated = own.withColumn("p", M.platt(M.logit(F.col("p")), slope, intercept))
    threshold = M.best_threshold(calibrated.where(F.col(part) == "validation"), metric, grid).first()["threshold"]
    both = calibrated.select(part, F.lit(True).alias("calibrated"), F.lit(threshold).alias("threshold"), "y", "p")
    both = both.unionByName(own.select(part, F.lit(False).alias("calibrated"), F.lit(0.5).alias("threshold"), "y", "p"))
    out = reports(cut(both), F.col("threshold"), [part, "calibrated", "threshold"], bins, None)
    return out.withColumns({"slope": F.when(F.col("calibrated"), slope), "intercept": F.when(F.col("calibrated"), intercept)})
