"""Digests of ordered content: trees of sha256 over canonical rows, the same however a table is partitioned.

A row's text joins its values by `|`: doubles as decimals of fixed digits (so -0 is 0), null as an empty place. Rows of a
bucket are hashed in order, the digests of `fan` buckets in order make one of the next level, and the last level's, in
order, the result. No task holds more than a bucket or a node's children; the top has (span / bucket / fan) digests a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import indexed, indexed_edges


def canonical(df: DataFrame, columns: Sequence[str], digits: int = 6) -> Column:
    """A row's text over columns in the given order."""
    kinds = dict(df.dtypes)
    parts = [F.col(f"`{c}`").cast(f"decimal(30,{digits})") if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in columns]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def ordered_digest(rows: DataFrame, keys: Sequence[str], bucket: int, fan: int) -> DataFrame:
    """(keys, rows, digest) of rows(keys, at, line): the lines by (at, line), cut into buckets of `at`."""
    level = rows.groupBy(*keys, F.floor(F.col("at") / bucket).alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kids"), F.count("*").alias("rows")
    )
    level = level.select(*keys, "at", "rows", F.sha2(F.array_join("kids.line", "\n"), 256).alias("line"))
    for up in (F.floor(F.col("at") / fan), F.lit(0).cast("long")):
        level = level.groupBy(*keys, up.alias("at")).agg(
            F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kids"), F.sum("rows").alias("rows")
        )
        level = level.select(*keys, "at", "rows", F.sha2(F.array_join("kids.line", ""), 256).alias("line"))
    return level.select(*keys, "rows", F.col("line").alias("digest"))


def series_fingerprint(record: DataFrame, keys: Sequence[str], value: str, source: str | None = None, bucket: int = 24, fan: int = 64) -> DataFrame:
    """(keys, rows, fingerprint): 16 hex digits over a series' steps t, its values to six decimals and its source counts.

    Equal content gives equal fingerprints whatever the order or partitions of the rows; another value, step or count of a
    source another one. Repeated rows count. An empty table has no rows and so no fingerprint.
    """
    lines = record.select(*keys, F.col("t").cast("long").alias("at"), canonical(record, ["t", value]).alias("line"))
    base = ordered_digest(lines, keys, bucket, fan)
    if source is None:
        return base.select(*keys, "rows", F.substring("digest", 1, 16).alias("fingerprint"))
    kinds = record.groupBy(*keys, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat_ws("=", "s", F.col("n").cast("string")))).alias("kinds"))
    both = F.sha2(F.concat("digest", F.array_join("kinds", ",")), 256)
    joined = base.join(kinds, list(keys)) if keys else base.join(F.broadcast(kinds), on=F.lit(True))
    return joined.select(*keys, "rows", F.substring(both, 1, 16).alias("fingerprint"))


def graph_signatures(
    nodes: DataFrame, edges: DataFrame, node_attributes: Sequence[str], edge_attributes: Sequence[str], bucket: int = 1024, fan: int = 64
) -> DataFrame:
    """One row (nodes, edges, topology, attributes): 16 hex digits each.

    topology covers node ids, in the order of their text, and the edges as pairs of their places; attributes covers the
    topology and the named columns, names sorted, doubles to six decimals. So a changed value moves attributes only, and a
    node or edge more or less moves both.
    """
    placed = indexed(nodes)
    ends = indexed_edges(edges, placed)
    ids = placed.select(F.col("idx").alias("at"), F.col("node_id").cast("string").alias("line"))
    pairs = ends.select(F.col("src").alias("at"), F.concat_ws("|", F.lpad(F.col("src").cast("string"), 12, "0"), F.lpad(F.col("dst").cast("string"), 12, "0")).alias("line"))
    of_nodes = placed.select(F.col("idx").alias("at"), canonical(placed, sorted(node_attributes)).alias("line"))
    of_edges = ends.select(
        F.col("src").alias("at"),
        F.concat_ws("|", F.lpad(F.col("src").cast("string"), 12, "0"), F.lpad(F.col("dst").cast("string"), 12, "0"), canonical(ends, sorted(edge_attributes))).alias("line"),
    )
    kinds = (("ids", ids), ("pairs", pairs), ("node values", of_nodes), ("edge values", of_edges))
    parts = None
    for kind, rows in kinds:
        part = rows.withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    found = ordered_digest(parts, ["kind"], bucket, fan)  # at most four rows
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    names = ",".join([*sorted(node_attributes), "/", *sorted(edge_attributes)])
    one = found.agg(
        F.coalesce(of("ids", "rows"), F.lit(0)).alias("nodes"), F.coalesce(of("pairs", "rows"), F.lit(0)).alias("edges"),
        *[F.coalesce(of(k, "digest"), F.lit("")).alias(k) for k, _ in kinds],
    )
    topology = F.sha2(F.concat("ids", "pairs"), 256)
    attributes = F.sha2(F.concat(topology, F.lit(names), F.col("node values"), F.col("edge values")), 256)
    return one.select("nodes", "edges", F.substring(topology, 1, 16).alias("topology"), F.substring(attributes, 1, 16).alias("attributes"))
