"""Queries of scenarios, provenance and map tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import graph as G
from ..operators import results as R
from ..operators import scenarios as C
from ..operators import series as S
from . import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


@query(
    "WITH seg AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM edges WHERE u <> v) "
    "SELECT a, b, round((x.elevation + y.elevation) / 2, 4) AS elevation FROM seg JOIN nodes x ON a = x.node_id JOIN nodes y ON b = y.node_id"
)
def street_means(spark, d):
    out = R.street_values(G.undirected_segments(A.edges(spark, d)), A.nodes(spark, d), "elevation")
    return out.select("a", "b", F.round("elevation", 4).alias("elevation"))


@query(
    "WITH h AS (SELECT t, avg(CASE WHEN rain > 300 THEN 1.0 ELSE 0.0 END) AS share, sum(rain) AS mm FROM node_hours GROUP BY t) "
    "SELECT round(max(share), 8) AS peak_share, arg_min(t, (-share, t)) AS peak_t, round(sum(mm), 3) AS rain FROM h WHERE t BETWEEN (SELECT min(t) + 24 FROM h) AND (SELECT min(t) + 240 FROM h)"
)
def event_peak(spark, d):
    rows = A.node_hours(spark, d)
    per = rows.groupBy("t").agg(F.avg((F.col("rain") > 300).cast("double")).alias("share"), F.sum("rain").alias("mm"))
    t0 = rows.agg(F.min("t")).first()[0]
    return per.where(F.col("t").between(t0 + 24, t0 + 240)).agg(
        F.round(F.max("share"), 8).alias("peak_share"), F.min_by("t", F.struct(-F.col("share"), F.col("t"))).alias("peak_t"), F.round(F.sum("mm"), 3).alias("rain")
    )


@query(
    "SELECT round(max(abs(rain - floor(rain))) FILTER (WHERE t % 17 <> 0), 6) AS max_difference, count_if(t % 17 = 0) AS unmatched, count_if(t % 17 <> 0 AND (rain > 300) <> (floor(rain) > 300)) AS label_mismatches, "
    "max(abs(rain - floor(rain))) FILTER (WHERE t % 17 <> 0) <= 1.5 AS same FROM node_hours"
)
def reproduced_rain(spark, d):
    a = A.node_hours(spark, d).withColumn("y", (F.col("rain") > 300).cast("int"))
    b = A.node_hours(spark, d).where("t % 17 <> 0").withColumn("rain", F.floor("rain").cast("double")).withColumn("y", (F.col("rain") > 300).cast("int"))
    return D.reproduction(a, b, "rain", 1.5).withColumn("max_difference", F.round("max_difference", 6))


@query("SELECT t, CASE WHEN t % 13 = 0 OR mm < 700 THEN 0.0 ELSE mm END AS mm, t >= (SELECT min(t) + 100 FROM hourly) AS is_target FROM hourly")
def custom_scenario(spark, d):
    rows = A.hourly(spark, d).withColumn("mm", F.when(F.col("t") % 13 == 0, None).when(F.col("mm") < 700, -F.col("mm")).otherwise(F.col("mm")))
    first = rows.agg(F.min("t")).first()[0]
    return C.custom_scenario(rows.withColumn("order", F.col("t")), first + 100)


@query(
    "WITH h AS (SELECT *, t > (SELECT min(t) + 200 FROM hourly) AS f FROM hourly), z AS (SELECT min(t) AS t0 FROM h WHERE f) "
    "SELECT t, mm, t >= t0 AS is_target FROM h, z WHERE t BETWEEN t0 - 72 AND t0 + 47"
)
def forecast_scenario(spark, d):
    rows = A.hourly(spark, d)
    first = rows.agg(F.min("t")).first()[0]
    return C.forecast_scenario(rows.withColumn("is_forecast", F.col("t") > first + 200), 48, 72).select("t", "mm", "is_target")


@query("WITH z AS (SELECT min(t) + 100 AS t0 FROM hourly) SELECT round(sum(mm), 3) AS total FROM hourly, z WHERE t >= t0 AND t < t0 + 24")
def scenario_total(spark, d):
    rows = A.hourly(spark, d)
    first = rows.agg(F.min("t")).first()[0]
    return C.scenario_total(rows.withColumn("is_target", F.col("t") >= first + 100), 24).select(F.round("total", 3).alias("total"))


@query()
def replayed_event(spark, d):
    """The rain event of the wettest hour, moved back to its start, behind two days of history."""
    wet = A.wet(spark, d).withColumn("is_imputed", F.lit(False)).withColumn("source", F.lit("gauge"))
    record = S.fill_gaps(wet, [], "mm").select("t", "mm")
    start = record.agg(F.min_by("t", F.struct(-F.col("mm"), F.col("t")))).first()[0]
    return C.replay(record, start, 24, 48, 0.0, 2)


@query(
    "SELECT t, CASE WHEN NOT (t % 4 = 0) AND mm < 700 THEN 'dry lead-in' WHEN t % 7 = 0 THEN 'forecast' ELSE 'observed' END AS category FROM hourly"
)
def hour_categories(spark, d):
    rows = A.hourly(spark, d)
    source = F.when(F.col("mm") < 700, "missing").otherwise("gauge")
    return rows.select("t", C.hour_category(F.lit("replay"), source, F.col("t") % 7 == 0, F.col("t") % 4 == 0).alias("category"))


@query(
    "WITH a AS (SELECT round(sum(mm), 2) AS total, count(*) AS steps, max(t) AS last_t, NULL::BIGINT AS nodes FROM hourly), b AS (SELECT round(sum(mm), 2) AS total, count(*) AS steps, max(t) AS last_t, (SELECT count(*) FROM nodes) AS nodes FROM wet) "
    "SELECT concat_ws(', ', CASE WHEN a.total IS DISTINCT FROM b.total THEN 'total' END, CASE WHEN a.steps IS DISTINCT FROM b.steps THEN 'steps' END, CASE WHEN a.last_t IS DISTINCT FROM b.last_t THEN 'last_t' END, CASE WHEN a.nodes IS DISTINCT FROM b.nodes THEN 'nodes' END) AS reasons FROM a, b"
)
def stale_inputs(spark, d):
    """Which of the stored inputs differ from those of now; the two records end alike or not as the data have it."""
    facts = (F.round(F.sum("mm"), 2).alias("total"), F.count("*").alias("steps"), F.max("t").alias("last_t"))
    before = A.hourly(spark, d).agg(*facts).withColumn("nodes", F.lit(None).cast("long"))
    now = A.wet(spark, d).agg(*facts).join(F.broadcast(A.nodes(spark, d).agg(F.count("*").alias("nodes"))), on=F.lit(True))
    return D.stale_reasons(before, now, ["total", "steps", "last_t", "nodes"]).select(F.concat_ws(", ", "reasons").alias("reasons"))


@query()
def prediction_features(spark, d):
    """A GeoJSON feature of every node with its hourly values."""
    mean = R.ensemble(A.members(spark, d))
    points = A.nodes(spark, d).join(R.members_at_risk(A.members(spark, d), 0.9), "node_id")
    return R.feature_json(points, ["elevation", "share"], mean.select("t", "node_id", "p"))
