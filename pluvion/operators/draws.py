"""Exact weighted draws with replacement, and running totals of a table in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored
from .learn import md5_fraction


def running_totals(df: DataFrame, order: str, weight: Column) -> DataFrame:
    """df with upto and total, sums of whole, non-negative weights by `order`: upto includes the row.

    Rows are dealt by range and written; sums run inside a range behind the sums of the ranges before it, a row a range.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    laid = df.select(row.alias("row"), F.col(f"`{order}`").alias("at"), F.coalesce(weight, F.lit(0)).cast("long").alias("w"))
    laid = stored(laid.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    sums = laid.groupBy("part").agg(F.sum("w").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("total"))
    inside = F.sum("w").over(Window.partitionBy("part").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, 0))
    met = laid.withColumn("inside", inside).join(F.broadcast(before), "part")
    return met.select("row.*", (F.col("before") + F.col("inside")).alias("upto"), "w", "total")


def exact_draws(df: DataFrame, order: str, weight: Column, n: int, seed: int, buckets: int = 256) -> DataFrame:
    """df's drawn rows with copies, how often each was drawn: exactly n draws with replacement, by whole weights.

    Draw k falls on a place below the total weight; the row whose stretch of the running weights holds the place is drawn.
    Stretches and places meet in `buckets` cuts of the total, so a row of any weight is met piecewise, and no task sees all
    draws. Rows of weight 0 or null are never drawn; a total of 0 with n above 0 is an error.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    summed = stored(running_totals(df, order, weight))
    top = summed.agg(F.max("total")).first()[0] or 0
    if n and not top:
        raise ValueError("exact_draws: no row has a weight")
    width = max(1, -(-top // buckets))
    lo, hi = F.col("upto") - F.col("w"), F.col("upto")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    spread = F.sequence(F.floor(lo / width), F.floor((hi - 1) / width))
    stretches = summed.where("w > 0").select(row.alias("row"), lo.alias("lo"), hi.alias("hi"), F.explode(spread).alias("cut"))
    place = F.least(F.floor(md5_fraction(F.col("id"), F.lit(seed)) * F.lit(float(top))), F.lit(top - 1)).cast("long")
    draws = df.sparkSession.range(n).select(place.alias("place")).groupBy("place").agg(F.count("*").alias("draws"))
    draws = draws.withColumn("cut", F.floor(F.col("place") / width))
    met = stretches.join(draws, "cut").where("place >= lo and place < hi")
    return met.groupBy("row", "lo").agg(F.sum("draws").alias("copies")).select("row.*", "copies")
