"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.components import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, more: str) -> StructType:
    """df's schema with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def valid_vector(c: Column) -> Column:
    """True if a vector is not null, not zero, and holds neither null nor non-finite components."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def grouped_pairs(left_n: np.ndarray, right_n: np.ndarray, left_at: np.ndarray, right_at: np.ndarray, most: int = 1 << 20):
    """Yield (left rows, right rows) of the product within each group, a bounded number of pairs at a time.

    left_n, right_n: rows of each group on either side; left_at, right_at: where these begin.
    """
    pairs = left_n.astype(np.int64) * right_n
    for g in np.flatnonzero(pairs > most):
        step = max(1, most // int(right_n[g]))
        right = np.arange(right_at[g], right_at[g] + right_n[g])
        for s in range(0, int(left_n[g]), step):
            left = np.arange(left_at[g] + s, left_at[g] + min(s + step, left_n[g]))
            yield np.repeat(left, len(right)), np.tile(right, len(left))
    small = np.flatnonzero((pairs > 0) & (pairs <= most))
    cut = np.searchsorted(np.cumsum(pairs[small]), np.arange(most, pairs[small].sum() + most, most))
    for part in np.split(small, np.unique(np.minimum(cut, len(small)))):
        if not len(part):
            continue
        n = pairs[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(right_n[part], n)
        yield np.repeat(left_at[part], n) + k // wide, np.repeat(right_at[part], n) + k % wide


def whole_groups(batches, keys: list[str]):
    """Regroup sorted record batches into tables that never split a run of equal keys."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        last = t.num_rows - 1
        cols = [t[k].to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[last] for c in cols])
        begin = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = t.slice(begin)
        if begin:
            yield t.slice(0, begin)
    if rest is not None and rest.num_rows:
        yield rest


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the column `name`: each row's place, from 0, in the order of the columns `order` (nulls first).

    Rows are dealt by range, sorted and written with their place inside their partition; the counts of the partitions give
    each its first place. Rows that are equal in `order` take places in any order and spread over partitions too.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order)
    placed = stored(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + inside).drop("_part", "_at", "_first")
