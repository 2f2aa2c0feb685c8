"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. Block i of a source whose share of the weights is w may run from slot floor(i / w) and must
run before slot ceil((i + 1) / w); earliest deadline first over these windows keeps every source within one block of its
share at every slot. Shares are exact fractions, so nothing adds up over time. The plan has one row a block, and blocks
grow with the table, so the plan is bounded; rows join their block's slot and never pass through one place.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import number_slots

#: Rows of a block at least, and blocks of all sources together, about: larger tables get larger blocks.
BLOCK_ROWS, BLOCKS = 64, 1 << 18


def pfair(weights: list, blocks: list[int]) -> list[tuple[int, int, int]]:
    """(source, block, slot) of all blocks: earliest deadline first among the released ones, ties to the lower source.

    weights are taken as exact fractions of their sum. A source that has run out leaves its slots to blocks that are
    released by then, else they stay empty; no block leaves its window.
    """
    exact = [Fraction(w) for w in weights]
    common = lcm(*[x.denominator for x in exact]) if exact else 1
    parts = [int(x * common) for x in exact]
    if parts and min(parts) <= 0:
        raise ValueError("weights must be positive")
    total = sum(parts)
    waiting = [(0, s) for s in range(len(parts)) if blocks[s] > 0]  # by release
    heapq.heapify(waiting)
    done, ready, out, t = [0] * len(parts), [], [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // parts[s]), s))
        deadline, s = heapq.heappop(ready)
        if t >= deadline:
            raise ArithmeticError("a block missed its deadline")
        out.append((s, done[s], t))
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (max(t + 1, done[s] * total // parts[s]), s))
        t += 1
    return out


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block: int | None = None) -> DataFrame:
    """docs with mix_slot, mix_pos and mix_block; (mix_slot, mix_pos) orders all rows as mixed.

    weights: target weight of each source (null is a source of its own); a source it lacks is an error. Without weights a
    source weighs its number of rows to the given power. Rows of a source are dealt to blocks in a hashed order, of which
    ties (repeated rows, null ids) take any; the last block of a source may be short. Every row keeps a place. block: rows
    of a block, by default BLOCK_ROWS or as many as make BLOCKS blocks. Only source is read of a row, so nulls, empty or
    long texts play no part. Columns of docs with the three names are replaced, all others stay whatever their names. An
    empty table gives an empty result. The driver holds one row a source and the plan.
    """
    docs = docs.drop("mix_slot", "mix_pos", "mix_block")
    counts = docs.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()
    if not counts:
        none = F.lit(None).cast("long")
        return docs.select("*", none.alias("mix_slot"), none.alias("mix_pos"), none.alias("mix_block"))
    given = [weights[r["source"]] if weights else r["n"] ** power for r in counts]
    block = block or max(BLOCK_ROWS, -(-sum(r["n"] for r in counts) // BLOCKS))
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r["source"]) for i, r in enumerate(counts)], "shard int, source string")
    plan = spark.createDataFrame(pfair(given, [-(-r["n"] // block) for r in counts]), "shard int, mix_block long, mix_slot long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("source").alias("own")).join(F.broadcast(names), F.col("own").eqNullSafe(F.col("source")))
    placed = number_slots(keyed.select("row", "shard"), max(r["n"] for r in counts), 1)
    placed = placed.withColumn("mix_block", F.floor(F.col("slot") / block))
    # the plan has about BLOCKS rows at most, and one a source more
    return placed.join(F.broadcast(plan), ["shard", "mix_block"]).select("row.*", "mix_slot", (F.col("slot") % block).alias("mix_pos"), "mix_block")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs, in mixed order within and across partitions."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    mixed = mix(docs.select(F.struct(*keep).alias("kept"), F.col("source")), **options)
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_pos").select("kept.*")


def with_place(mixed: DataFrame, name: str = "mix_place") -> DataFrame:
    """mixed, as in_mixed_order gave it or written by Spark and read again, with a long that grows along the mix.

    Partitions were written in order, each to files numbered by its number, and rows keep their order in a file; so a
    row's place is known from its file's name and its index there, however a scan deals the files out. Null for files
    with other names.
    """
    try:
        mixed.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:  # not a scan of files
        return mixed.withColumn(name, F.monotonically_increasing_id())
    numbers = [F.try_element_at(F.regexp_extract_all("_metadata.file_name", F.lit(p)), F.lit(1)).cast("long") for p in (r"^part-(\d+)-", r"-c(\d+)\.")]
    place = numbers[0] * F.lit(1 << 43) + numbers[1] * F.lit(1 << 33) + F.col("_metadata.row_index")
    return mixed.withColumn(name, place)


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix where a source weighs the square root of its rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_pos")


QUERIES = {"op5_pfair_mixing": op5_pfair_mixing}
