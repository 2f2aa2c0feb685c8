"""The given tables in the roles that the operators need, in Spark and, under the same name, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, local_xy
from ..operators.series import epoch_day, hour_ending

#: Fixed values of the adapters: the origin and spread of coordinates, and the score's middle and width.
LON0, LAT0, SPREAD, ELEVATION, RELIEF = 77.67, 12.93, 0.02, 880.0, 30.0
SCORE_MIDDLE, SCORE_WIDTH = 2000.0, 1500.0
NODES = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour(ts: Column) -> Column:
    return hour_ending(ts).cast("long").alias("t")


T = "(datediff('day', DATE '1970-01-01', ts::DATE)*24 + hour(ts) + CASE WHEN ts > date_trunc('hour', ts) THEN 1 ELSE 0 END)::BIGINT"
DAY = "datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT"

SQL = {
    "events_t": f"SELECT event_id, user_id, event_type, value, {T} AS t FROM events",
    "hourly": "SELECT t, round(sum(value), 4) AS mm FROM events_t GROUP BY t",
    "wet": "SELECT t, round(sum(value), 4) AS mm FROM events_t WHERE value > 200 GROUP BY t",
    "daily": f"SELECT {DAY} AS t, round(sum(o_totalprice), 2) AS mm FROM orders GROUP BY 1",
    "node_hours": f"SELECT t, user_id % {NODES} AS node_id, round(sum(value), 4) AS rain FROM events_t GROUP BY 1, 2",
    "scores": (
        "SELECT doc_id, toxic AS y, round(1 / (1 + exp(-(n_chars - 2000.0) / 1500.0)), 6) AS p, n_chars, source "
        "FROM labels JOIN documents USING (doc_id)"
    ),
    "nodes": (
        "SELECT vec_id AS node_id, round(77.67 + 0.02 * embedding[1]::DOUBLE, 9) AS lon, "
        "round(12.93 + 0.02 * embedding[2]::DOUBLE, 9) AS lat, round(880 + 30 * embedding[3]::DOUBLE, 6) AS elevation FROM embeddings"
    ),
    "nodes_xy": (
        "SELECT *, radians(lon - 77.67) * 6371008.8 * cos(radians(12.93)) AS x, radians(lat - 12.93) * 6371008.8 AS y FROM nodes"
    ),
    "links": (
        "SELECT node_id AS u, (node_id + 1) % n AS v FROM nodes, (SELECT count(*) AS n FROM nodes) "
        "UNION ALL SELECT node_id, (7 * node_id + 3) % n FROM nodes, (SELECT count(*) AS n FROM nodes)"
    ),
    "edges": (
        "SELECT u, v, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) "
        "* cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS length "
        "FROM links JOIN nodes a ON u = a.node_id JOIN nodes b ON v = b.node_id"
    ),
    "members": (
        "SELECT member, t, node_id, least(round(rain / 500, 6) * (0.7 + 0.6 * "
        "(('0x' || substr(md5(concat_ws('|', member, node_id)), 1, 8))::BIGINT / 4294967296.0)), 1.0) AS p, rain, rain / 1000 AS depth "
        "FROM node_hours, (SELECT unnest(range(8))::INTEGER AS member)"
    ),
}


def with_views(query: str) -> str:
    """query behind the views that it names, and those that these name; its counts are BIGINT, not HUGEINT."""
    query = query.replace("count_if(", "count(*) FILTER (WHERE ")
    order = list(SQL)
    need: set[str] = set()

    def add(text: str) -> None:
        for name in order:
            if name not in need and name in text.replace(",", " ").replace(")", " ").replace("(", " ").split():
                need.add(name)
                add(SQL[name])

    add(query)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in order if n in need)
    if not views:
        return query
    rest = query.removeprefix("WITH RECURSIVE ") if query.startswith("WITH RECURSIVE ") else query.removeprefix("WITH ")
    head = "WITH RECURSIVE " if query.startswith("WITH RECURSIVE ") else "WITH "
    return f"{head}{views}{', ' if rest != query else ' '}{rest}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", _hour(F.col("ts")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("t").agg(F.round(F.sum("value"), 4).alias("mm"))


def wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly series with dry gaps."""
    return events(spark, sf_dir).where("value > 200").groupBy("t").agg(F.round(F.sum("value"), 4).alias("mm"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of several years in steps of a day."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(epoch_day(F.col("o_orderdate")).alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("mm"))


def node_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events(spark, sf_dir).groupBy("t", (F.col("user_id") % NODES).alias("node_id"))
    return per.agg(F.round(F.sum("value"), 4).alias("rain"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-valued labels with a probability."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    p = F.round(1 / (1 + F.exp(-(F.col("n_chars") - SCORE_MIDDLE) / SCORE_WIDTH)), 6)
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return labelled.join(docs, "doc_id").select("doc_id", "y", p.alias("p"), "n_chars", "source")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.round(LON0 + SPREAD * e(1), 9).alias("lon"), F.round(LAT0 + SPREAD * e(2), 9).alias("lat"),
        F.round(ELEVATION + RELIEF * e(3), 6).alias("elevation"),
    )


def nodes_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = local_xy(F.col("lon"), F.col("lat"), LON0, LAT0)
    return nodes(spark, sf_dir).withColumn("x", x).withColumn("y", y)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = nodes(spark, sf_dir)
    n = points.count()
    i = F.col("node_id")
    links = points.select(i.alias("u"), ((i + 1) % n).alias("v")).union(points.select(i, (7 * i + 3) % n))
    a = points.select(F.col("node_id").alias("u"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = points.select(F.col("node_id").alias("v"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    length = F.round(haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 3)
    return links.join(a, "u").join(b, "v").select("u", "v", length.alias("length"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight members of a prediction of node-hours."""
    rows = node_hours(spark, sf_dir).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(7))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("member").cast("string"), F.col("node_id").cast("string"))), 1, 8), 16, 10)
    p = F.least(F.round(F.col("rain") / 500, 6) * (0.7 + 0.6 * (draw.cast("double") / 4294967296.0)), F.lit(1.0))
    return rows.select("member", "t", "node_id", p.alias("p"), "rain", (F.col("rain") / 1000).alias("depth"))
