"""Committed datasets: files first, then a manifest of their sizes and sha256 digests; a reader takes nothing else.

A dataset is a folder `build=<name>` with `rows/` and `manifest/`. The manifest is written last and in one row a file, so a
build without it was never committed, and readers refuse it. Files are digested by a binary scan, one task a file or more;
`most_rows` bounds the rows of a file, and so what a scan holds at once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised when columns or their meaning change; a reader refuses another version.
VERSION = 1


class NotCommitted(ValueError):
    """The build has no manifest, another version, or does not hold what its manifest says."""


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, bytes, sha256) of the Parquet files under path/rows, by their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/rows")
    return files.select(
        F.regexp_extract("path", r"/split=([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
    )


def commit(rows: DataFrame, path: str, build: str, statistics: DataFrame | None = None, most_rows: int = 1_000_000) -> DataFrame:
    """Writes rows(split, ...) and then their manifest; returns the manifest (split, file, bytes, sha256, rows, statistics).

    Phase one writes the rows and reads every file's size and digest back; phase two writes the manifest. statistics(split,
    ...) goes along as JSON, one text a split. A build that exists is never overwritten. split must not be null.
    """
    spark, base = rows.sparkSession, f"{path}/build={build}"
    if not rows.where("split is null").isEmpty():
        raise ValueError("split must not be null")
    rows.write.option("maxRecordsPerFile", most_rows).partitionBy("split").parquet(f"{base}/rows")
    saved = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    counts = saved.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("split").cast("string").alias("split")).agg(F.count("*").alias("rows"))
    manifest = scanned(spark, base).join(counts, ["split", "file"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    said = F.lit(None).cast("string").alias("statistics")
    if statistics is not None:
        kept = statistics.select(F.col("split").cast("string").alias("split"), F.to_json(F.struct(*[c for c in statistics.columns if c != "split"])).alias("statistics"))
        manifest = manifest.join(kept, "split", "left")
    else:
        manifest = manifest.select("*", said)
    kinds = json.dumps([[f.name, f.dataType.simpleString()] for f in rows.schema.fields])
    manifest = manifest.select("split", "file", "bytes", "sha256", "rows", "statistics", F.lit(kinds).alias("columns"), F.lit(VERSION).alias("version"))
    manifest.coalesce(1).write.parquet(f"{base}/manifest")
    return spark.read.parquet(f"{base}/manifest")


def manifest_of(spark: SparkSession, path: str, build: str) -> DataFrame:
    try:
        found = spark.read.parquet(f"{path}/build={build}/manifest")
    except AnalysisException as missing:
        raise NotCommitted(f"build {build} was not committed") from missing
    if other := [r["version"] for r in found.select("version").distinct().limit(9).collect() if r["version"] != VERSION]:
        raise NotCommitted(f"build {build} has version {other}, not {VERSION}")
    return found


def verify(spark: SparkSession, path: str, build: str) -> DataFrame:
    """The files that differ from the manifest: (split, file, why), why being `missing`, `not listed`, `size` or `content`."""
    listed = manifest_of(spark, path, build).select("split", "file", "bytes", "sha256")
    there = scanned(spark, f"{path}/build={build}").select("split", "file", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    why = (
        F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "not listed")
        .when(F.col("bytes") != F.col("b"), "size").when(F.col("sha256") != F.col("s"), "content")
    )
    return listed.join(there, ["split", "file"], "full").select("split", "file", why.alias("why")).where("why is not null")


def read(spark: SparkSession, path: str, build: str, required: Sequence[str] = (), series: Sequence[str] = (), step: str | None = None) -> DataFrame:
    """The rows of a committed build, verified file by file before any is returned.

    Lacking columns of `required` are an error. With `step`, that column must rise by one inside each group of `series` and
    split: a hole or a repeated step is an error.
    """
    bad = verify(spark, path, build).limit(5).collect()
    if bad:
        raise NotCommitted("; ".join(f"{r['split']}/{r['file']}: {r['why']}" for r in bad))
    kinds = json.loads(manifest_of(spark, path, build).select("columns").first()["columns"])
    if lacking := sorted(set(required) - {name for name, _ in kinds}):
        raise NotCommitted(f"build {build} lacks {lacking}")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds)
    rows = spark.read.schema(schema).parquet(f"{path}/build={build}/rows")
    if step is not None:
        groups = rows.groupBy("split", *series).agg((F.max(step) - F.min(step) + 1 - F.count(step)).alias("holes"), (F.count(step) - F.count_distinct(step)).alias("twice"))
        if not groups.where("holes <> 0 or twice <> 0").isEmpty():
            raise NotCommitted(f"build {build}: {step} is not contiguous in each of {['split', *series]}")
    return rows
