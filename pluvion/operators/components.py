"""Connected components of an edge table, and the cut of lineage that loops need."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """As stored, but the files go at the end of the block."""
    table = stored(df)
    try:
        yield table
    finally:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go the shuffle files of plans that are done: Spark deletes them once the driver has collected its garbage."""
    spark._jvm.System.gc()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stop changing. Each step takes the minimum
    of a node's neighbours (summed map-side) and joins it back, so a node with many edges is a skewed join, which
    adaptive execution splits. Null ends and loops are left out of the links; a node that has only loops is its own
    component. Raises if max_rounds do not suffice.
    """
    pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    loops = pairs.where("src = dst").select(F.col("src").alias("node"))
    links = cut(
        pairs.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    known = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).unionByName(loops)
    return (
        known.unionByName(roots.distinct().select("node", F.col("node").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
