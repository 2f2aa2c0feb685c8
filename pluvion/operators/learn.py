"""Sampling and models of node-hours, on spark.ml; every random choice is a hash that SQL can compute too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import logit


def md5_fraction(*parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_copies(u: Column, weight: Column, most: int = 12) -> Column:
    """How often a uniform u draws a row of this weight with replacement: the Poisson quantile."""
    term, cumulative, out = F.exp(-weight), F.exp(-weight), F.lit(0)
    for k in range(1, most + 1):
        out = out + F.when(u >= cumulative, 1).otherwise(0)
        term = term * weight / k
        cumulative = cumulative + term
    return out


def weighted_sample(windows: DataFrame, weight: Column, seed: int) -> DataFrame:
    """windows(t, ...) drawn with replacement, each repeated as often as its draw says."""
    n = poisson_copies(md5_fraction(F.col("t"), F.lit(seed)), weight)
    return windows.withColumn("copies", n).where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_i")


def balanced_sample(df: DataFrame, group: Sequence[str], label: str, quota: int, id_cols: Sequence[str], seed: int) -> DataFrame:
    """At most `quota` rows per group and label, those of the least hash; the limit is the sample's own."""
    order = Window.partitionBy(*group, label).orderBy("_u", *id_cols)
    drawn = df.withColumn("_u", md5_fraction(*[F.col(c) for c in id_cols], F.lit(seed)))
    return drawn.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= quota).drop("_u", "_k")


def class_balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """df with weight: each class weighs half in sum."""
    counts = df.agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    joined = df.join(F.broadcast(counts), on=F.lit(True))
    w = F.when(F.col(label) == 1, F.col("_n") / (2 * F.col("_p"))).otherwise(F.col("_n") / (2 * (F.col("_n") - F.col("_p"))))
    return joined.withColumn("weight", w).drop("_n", "_p")


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def probability(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with p, the model's probability of class 1."""
    out = model.transform(assembled(df, features))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, l2: float = 1e-4):
    rows = assembled(class_balanced_weight(df, label), features)
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=l2, maxIter=100).fit(rows)


def fit_trees(df: DataFrame, features: Sequence[str], label: str, validation: str, rounds: int = 20, depth: int = 4):
    """Boosted trees that stop early on the rows where `validation` is true."""
    rows = assembled(class_balanced_weight(df, label), features)
    return GBTClassifier(
        labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, validationIndicatorCol=validation, seed=1
    ).fit(rows)


def fit_platt(df: DataFrame, p: str = "p", label: str = "y", with_intercept: bool = True) -> tuple[float, float]:
    """(slope, intercept) of least log loss on logits, slope in [0.05, 20], intercept in [-20, 20]; (1, 0) if one class."""
    kinds = df.agg(F.min(label), F.max(label)).first()
    if kinds[0] == kinds[1]:
        return 1.0, 0.0
    rows = assembled(df.withColumn("_z", logit(F.col(p))), ["_z"])
    fit = LogisticRegression(
        labelCol=label, maxIter=200, tol=1e-9, standardization=False, fitIntercept=with_intercept,
        lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.05]), upperBoundsOnCoefficients=Matrices.dense(1, 1, [20.0]),
    )
    if with_intercept:
        fit = fit.setLowerBoundsOnIntercepts(Vectors.dense(-20.0)).setUpperBoundsOnIntercepts(Vectors.dense(20.0))
    model = fit.fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def fit_temperature(df: DataFrame, p: str = "p", label: str = "y") -> float:
    """T of sigmoid(z / T)."""
    return 1.0 / fit_platt(df, p, label, with_intercept=False)[0]
