"""Sharding by jump consistent hashing, in DataFrame functions only.

The law is `key`: the key and the number of shards decide, and one more shard takes rows only into itself. The walk of
the hash needs 64-bit products that wrap; they are exact decimals taken modulo 2^64, so ANSI overflow checks stay on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import table

#: Fixed values of the published jump consistent hash: the generator's multiplier, and 2^64.
MULTIPLIER = 2862933555777941757
WRAP = 18446744073709551616

#: Rows that one task numbers at once, about, and the least number of slices of a shard.
SLICE_ROWS = 200_000
SLICES = 64


def jump_walk(key: Column, shards: int) -> Column:
    """struct(b, before): the last two buckets below `shards` that the walk of the key visits.

    Each step moves at least one bucket ahead, so `shards` steps always suffice; settled rows skip the rest.
    """
    wide = F.lit(str(WRAP)).cast("decimal(20,0)")
    unsigned = F.pmod(F.coalesce(key, F.lit(0)).cast("decimal(20,0)"), wide).cast("decimal(20,0)")
    bucket = F.lit(-1).cast("long")
    start = F.struct(bucket.alias("before"), bucket.alias("b"), F.lit(0).cast("long").alias("j"), unsigned.alias("k"))

    def step(acc: Column) -> Column:
        k = ((acc["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % wide).cast("decimal(20,0)")
        high = F.floor(k / F.lit(8589934592).cast("decimal(10,0)")).cast("double")
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        return F.struct(acc["b"].alias("before"), acc["j"].alias("b"), j.alias("j"), k.alias("k"))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start, lambda acc, _: F.when(acc["j"] >= shards, acc).otherwise(step(acc))
    )
    return F.struct(walked["b"].alias("b"), walked["before"].alias("before"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs with shard (0 to shards-1), slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    Columns of docs named shard, slot or grown_shard are replaced, all others stay whatever their names. Null keys count
    as 0. Only the key is read of a row, so nulls, empty or long texts play no part. Rows are numbered in hashed slices of
    each shard, whose counts give each slice its first slot, so no task holds a whole shard, even if its rows are all
    alike. Rows that repeat, and ties, take slots in any order. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot", "grown_shard")
    walk = jump_walk(F.col(f"`{key}`").cast("long"), shards + 1)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), walk.alias("walk"))
    keyed = keyed.select(
        "row",
        F.when(F.col("walk.b") == shards, F.col("walk.before")).otherwise(F.col("walk.b")).cast("int").alias("shard"),
        F.col("walk.b").cast("int").alias("grown_shard"),
    )
    return number_slots(keyed, docs.count(), shards).select("row.*", "shard", "slot", "grown_shard")


def number_slots(keyed: DataFrame, rows: int, shards: int) -> DataFrame:
    """keyed(row, shard, ...) with slot.

    The slice comes from the row's place in the input, so rows that are all alike spread as well; it is written with the
    row, so that the counts and the numbers agree when a task runs again.
    """
    slices = max(SLICES, -(-rows // (shards * SLICE_ROWS)))
    spread = F.xxhash64(F.monotonically_increasing_id())
    keyed = stored(keyed.withColumn("slice", F.pmod(spread, F.lit(slices)).cast("int")).withColumn("spread", spread))
    sizes = keyed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    first = sizes.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("spread"))
    return (
        keyed.withColumn("place", place)
        .join(first, ["shard", "slice"])
        .withColumn("slot", F.col("first") + F.col("place") - 1)
        .drop("first", "place", "slice", "spread")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hash of doc_id."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard_documents(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op10_sharding": op10_sharding}
