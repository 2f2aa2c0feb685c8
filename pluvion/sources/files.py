"""Scans and sinks of the file formats around rain records and street graphs."""

from __future__ import annotations

import csv
import gzip
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import dedup, hour_ending

WEATHER = ["timestamp", "precipitation_mm", "is_imputed", "source"]
#: Other names of a report file's columns.
REPORT_ALIASES = {
    "time": "timestamp", "datetime": "timestamp", "date_time": "timestamp", "reported_at": "timestamp", "latitude": "lat", "longitude": "lon",
    "lng": "lon", "long": "lon", "radius": "radius_m", "extent_m": "radius_m", "notes": "description", "comment": "description",
}
REPORT_COLUMNS = ["timestamp", "lat", "lon", "radius_m", "severity", "description"]


def parse_time(c: Column, zone: str) -> Column:
    """A timestamp from ISO text: with an offset as it says, else in the zone's clock; null if invalid."""
    has_offset = c.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
    naive = F.to_utc_timestamp(c.try_cast("timestamp_ntz").cast("timestamp"), zone)
    return F.when(has_offset, c.try_cast("timestamp")).otherwise(naive)


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "y", "t"), F.lit(False))


def read_weather(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """(t, ts, mm, is_imputed, source, is_forecast) of weather CSV files; steps that a file lacks stay absent.

    A missing column, or no parseable stamp, is an error. Of repeated stamps the last row stays.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnsRenamed({"time": "timestamp", "precipitation": "precipitation_mm"})
    if lacking := [c for c in WEATHER if c not in raw.columns]:
        raise ValueError(f"weather file lacks {lacking}")
    forecast = as_bool(F.col("is_forecast")) if "is_forecast" in raw.columns else F.lit(False)
    rows = raw.select(
        parse_time(F.col("timestamp"), zone).alias("ts"), F.col("precipitation_mm").try_cast("double").alias("mm"), as_bool(F.col("is_imputed")).alias("is_imputed"),
        "source", forecast.alias("is_forecast"), F.monotonically_increasing_id().alias("_order"),
    ).where("ts is not null")
    if rows.isEmpty():
        raise ValueError("no parseable stamp")
    return dedup(rows, ["ts"], ["_order"]).drop("_order").withColumn("t", hour_ending(F.col("ts")))


def write_weather(df: DataFrame, path: str) -> None:
    """ISO stamps with offset, columns in fixed order; the committer makes the folder whole or absent."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("timestamp")
    df.select(stamp, F.col("mm").alias("precipitation_mm"), "is_imputed", "source").sortWithinPartitions("timestamp").write.csv(path, header=True)


def read_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of landed JSON payloads {hourly: {time: [..], precipitation: [..]}}.

    Arrays of unequal length reject the payload; values that are no numbers are null; of repeated stamps the last stays.
    """
    schema = "hourly struct<time: array<string>, precipitation: array<string>>"
    raw = spark.read.text(path, wholetext=True).select("value", F.from_json("value", schema).alias("j"))
    ok = F.coalesce(F.size("j.hourly.time") == F.size("j.hourly.precipitation"), F.lit(False)) & (F.size("j.hourly.time") > 0)
    rows = raw.where(ok).select(F.monotonically_increasing_id().alias("_order"), F.posexplode(F.arrays_zip("j.hourly.time", "j.hourly.precipitation")))
    typed = rows.select(
        F.col("col.time").try_cast("timestamp").alias("ts"), F.col("col.precipitation").try_cast("double").alias("mm"), "_order", "pos"
    ).where("ts is not null")
    return dedup(typed, ["ts"], ["_order", "pos"]).drop("_order", "pos"), raw.where(~ok).select("value")


def mark_forecast(rows: DataFrame, now) -> DataFrame:
    """Live payload rows: source forecast, is_forecast after the current full hour."""
    return rows.select("ts", "mm", F.lit("forecast").alias("source"), (F.col("ts") > F.date_trunc("hour", F.lit(now))).alias("is_forecast"))


def leads_long(wide: DataFrame, leads: dict[str, int], most_missing: float = 0.5) -> DataFrame:
    """(lead_h, t, forecast, is_imputed) of lead columns; nulls are 0 and imputed; a column with too many is left out."""
    rates = wide.agg(*[F.avg(F.isnull(c).cast("double")).alias(c) for c in leads]).first()
    kept = {c: h for c, h in leads.items() if rates[c] is not None and rates[c] <= most_missing}
    if not kept:
        raise ValueError("no lead column is available")
    pairs = F.array(*[F.struct(F.lit(h).alias("lead_h"), F.col(c).cast("double").alias("v")) for c, h in kept.items()])
    return wide.select("t", F.inline(pairs)).select("lead_h", "t", F.coalesce("v", F.lit(0.0)).alias("forecast"), F.isnull("v").alias("is_imputed"))


def _report_rows(batches):
    """The rows of whole CSV files, with the line of the file that each begins on."""
    for batch in batches:
        for text in batch["value"]:
            rows = csv.reader(io.StringIO(text.removeprefix("\ufeff")))
            names = [REPORT_ALIASES.get(c.strip().lower(), c.strip().lower()) for c in next(rows, [])]
            if lacking := [c for c in ("timestamp", "lat", "lon") if c not in names]:
                raise ValueError(f"report file lacks {lacking}")
            out, line = [], rows.line_num + 1
            for row in rows:
                if row:
                    cells = dict(zip(names, row))
                    out.append([line, *[cells.get(c) for c in REPORT_COLUMNS]])
                line = rows.line_num + 1
            yield pd.DataFrame(out, columns=["line", *REPORT_COLUMNS])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All-string rows of flood report CSV files with `line`, where each begins in its file (the header is line 1).

    Each file is read as one value, as lines can only be counted from its start; files run side by side.
    """
    schema = "line long, " + ", ".join(f"{c} string" for c in REPORT_COLUMNS)
    return spark.read.text(path, wholetext=True).mapInPandas(_report_rows, schema)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML: attributes as a map of key to text; of parallel edges the shorter stays whole.

    An undirected graph gives both directions. A node without x or y is an error.
    """
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    names = {r[0]: r[1] for r in keys.collect() if r[0]}  # declared once a file
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None

    def attributes() -> Column:
        each = F.transform("data", lambda d: F.struct((F.coalesce(label[d["_key"]], d["_key"]) if label is not None else d["_key"]).alias("k"), d["_VALUE"].alias("v")))
        return F.map_from_entries(F.coalesce(each, F.array().cast("array<struct<k:string,v:string>>")))

    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    nodes = nodes.select(F.coalesce(F.col("_id").try_cast("long").cast("string"), F.col("_id")).alias("node_id"), attributes().alias("attributes"))
    nodes = nodes.withColumn("lon", F.col("attributes")["x"].try_cast("double")).withColumn("lat", F.col("attributes")["y"].try_cast("double"))
    if not nodes.where("lon is null or lat is null").isEmpty():
        raise ValueError("a node lacks x or y")
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    edges = edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), attributes().alias("attributes"))
    edges = edges.withColumn("length", F.col("attributes")["length"].try_cast("double"))
    graph = spark.read.format("xml").option("rowTag", "graph").schema("_edgedefault string").load(path).first()
    if graph is not None and graph[0] == "undirected":
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "attributes", "length"))
    rank = F.struct(F.coalesce("length", F.lit(math.inf)), F.xxhash64(F.to_json("attributes")))
    return nodes, edges.groupBy("u", "v").agg(F.min_by(F.struct("attributes", "length"), rank).alias("e")).select("u", "v", "e.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    if nodes.isEmpty():
        raise ValueError("the graph is empty")
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def read_waterways(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, points, tags): one row per line or polygon ring of a GeoJSON FeatureCollection.

    Multi-part geometries give one row a part; points and bad JSON give none.
    """
    point = "array<double>"
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    f = raw.select(F.posexplode("j.features").alias("feature", "f")).select(
        "feature", F.col("f.properties").alias("tags"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c")
    )
    depth = {"LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
    parts = None
    for kind, d in depth.items():
        parsed = F.from_json("c", "array<" * d + point + ">" * d)
        rows = f.where(F.col("type") == kind).select("feature", "tags", parsed.alias("p"))
        for _ in range(d - 1):
            rows = rows.select("feature", "tags", F.explode("p").alias("p"))
        rows = rows.select("feature", F.lit("polygon" if "Polygon" in kind else "line").alias("kind"), F.col("p").alias("points"), "tags")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def without_excluded_water(waterways: DataFrame, excluded: list[str]) -> DataFrame:
    """Features whose `water` tag, parts between ;, has none of the excluded values."""
    values = F.transform(F.split(F.lower(F.coalesce(F.col("tags")["water"], F.lit(""))), ";"), F.trim)
    return waterways.where(~F.arrays_overlap(values, F.array(*[F.lit(x) for x in excluded])))


def segments_of(waterways: DataFrame) -> DataFrame:
    """(feature, kind, x1, y1, x2, y2) of neighbouring points."""
    n = F.size("points")
    each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    rows = waterways.where(n > 1).select("feature", "kind", F.explode(each).alias("s"))
    return rows.select("feature", "kind", *[F.col(f"s.{p}")[k].alias(f"{'xy'[k]}{i}") for i, p in ((1, "a"), (2, "b")) for k in (0, 1)])


def flat_text(values: Column) -> Column:
    """A list as text: its distinct values between ;."""
    return F.array_join(F.array_distinct(values), ";")


def _tile_rows(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            raw = gzip.decompress(content) if path.endswith(".gz") else bytes(content)
            n = math.isqrt(len(raw) // 2)
            if n not in (1201, 3601) or 2 * n * n != len(raw):
                raise ValueError(f"{path} is no elevation tile")
            grid = np.frombuffer(raw, dtype=">i2").reshape(n, n).astype(np.int16)
            tile = path.rsplit("/", 1)[-1].split(".")[0]
            for s in range(0, n, 64):
                part = grid[s : s + 64]
                r, c = np.indices(part.shape)
                elev = part.ravel().astype(float)
                yield pd.DataFrame({"tile": tile, "row": (r.ravel() + s).astype(np.int64), "col": c.ravel().astype(np.int64), "elev": np.where(elev == -32768, np.nan, elev)})


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile, row, col, elev) of .hgt files, gzipped or not; voids are null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_tile_rows, "tile string, row long, col long, elev double")
    return rows.withColumn("elev", F.when(~F.isnan("elev"), F.col("elev")))


def elevation_points(batches: DataFrame) -> DataFrame:
    """(point, elev) of batches(points, elevation) of equal length; a wrong length is an error; off range is null."""
    ok = F.when(F.size("points") == F.size("elevation"), F.arrays_zip("points", "elevation")).otherwise(F.raise_error(F.lit("a batch has a wrong length")))
    rows = batches.select(F.explode(ok).alias("z")).select(F.col("z.points").alias("point"), F.col("z.elevation").alias("elev"))
    return rows.withColumn("elev", F.when(F.col("elev").between(-500, 9000), F.col("elev")))


def write_collection(features: DataFrame, path: str, metadata: dict) -> None:
    """A folder with one GeoJSON feature a line and a one-line metadata file."""
    features.select(F.col("feature").alias("value")).write.text(f"{path}/features")
    pairs = [F.lit(x) for kv in metadata.items() for x in map(str, kv)]
    features.sparkSession.range(1).select(F.to_json(F.create_map(*pairs)).alias("value")).write.text(f"{path}/metadata")


def write_table_csv(table: DataFrame, path: str) -> None:
    stamps = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx") for c, k in table.dtypes if k.startswith("timestamp")}
    table.withColumns(stamps).write.csv(path, header=True)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One JSON object a row; what is not finite is null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes]
    rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def commit_splits(rows: DataFrame, path: str, build: str) -> DataFrame:
    """Writes rows(split, ...) under a build of its own, then its manifest; readers take only builds with a manifest."""
    rows.write.partitionBy("split").parquet(f"{path}/build={build}/rows")
    saved = rows.sparkSession.read.parquet(f"{path}/build={build}/rows")
    manifest = saved.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[c for c in saved.columns if c != "split"]).cast("decimal(38,0)")).cast("string").alias("digest"))
    manifest = manifest.withColumn("build", F.lit(build))
    manifest.write.parquet(f"{path}/build={build}/manifest")
    return manifest


def read_split(spark: SparkSession, path: str, build: str, split: str, required: list[str]) -> DataFrame:
    """Rows of a committed split; an unfinished build, an absent column or another row count is an error."""
    manifest = spark.read.parquet(f"{path}/build={build}/manifest").where(F.col("split") == split).first()
    rows = spark.read.parquet(f"{path}/build={build}/rows").where(F.col("split") == split)
    if manifest is None or (lacking := [c for c in required if c not in rows.columns]):
        raise ValueError("no such split" if manifest is None else f"the split lacks {lacking}")
    if rows.count() != manifest["rows"]:
        raise ValueError("the split does not match its manifest")
    return rows
