"""Streaming queries over the events table: everything that is there now, by the available-now trigger, into Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_dir
from ..streaming import readings as L
from . import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name one file
    return rows.select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mm"), "event_id")


def landed(out: DataFrame) -> DataFrame:
    """out run to its end into the shared folder, and read back."""
    spark = out.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def _hour(ts):
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return (day * 24 + F.hour(ts)).cast("long")


LAST = "l AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)"
CLOCK = "(datediff('day', DATE '1970-01-01', ts::DATE)*24 + hour(ts))::BIGINT"


@query(
    f"WITH {LAST} SELECT user_id AS station, {CLOCK} + 1 AS hour_end, round(sum(value), 4) AS mm FROM events, l WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2"
)
def stream_hourly_totals(spark, d):
    """Hours that the watermark has closed; the later ones are still open."""
    out = L.hourly_totals(L.readings(source(spark, d)))
    return landed(out).select("station", _hour(F.col("hour_end")).alias("hour_end"), F.round("mm", 4).alias("mm"))


@query(
    f"WITH {LAST}, x AS (SELECT user_id, value, {CLOCK} + 1 + unnest(range(6)) AS h FROM events) SELECT user_id AS station, h AS hour_end, round(sum(value), 4) AS mm FROM x, l "
    "WHERE TIMESTAMP '1970-01-01' + to_hours(h) <= mark GROUP BY 1, 2"
)
def stream_sliding_totals(spark, d):
    out = L.sliding_totals(L.readings(source(spark, d)), 6)
    return landed(out).select("station", _hour(F.col("hour_end")).alias("hour_end"), F.round("mm", 4).alias("mm"))


@query()
def stream_rain_sessions(spark, d):
    """Closed sessions of wet readings per station."""
    return landed(L.rain_sessions(L.readings(source(spark, d)), 200.0, 2))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS stations FROM (SELECT DISTINCT user_id, ts FROM events)")
def stream_first_arrivals(spark, d):
    out = landed(L.first_arrivals(L.readings(source(spark, d))).select("station", "ts"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("station").alias("stations"))


@query()
def stream_leaky_stores(spark, d):
    """The stateful store of each station after each reading."""
    return landed(L.leaky_store(L.readings(source(spark, d)), 60.0, 400.0))


@query("SELECT event_id, user_id AS node_id, round(value / 300, 6) AS p, elevation FROM events JOIN nodes ON node_id = user_id WHERE value / 300 >= 0.9")
def stream_alerts(spark, d):
    rows = source(spark, d).select("event_id", F.col("station").alias("node_id"), (F.col("mm") / 300).alias("p"))
    out = L.alerts(rows, A.nodes(spark, d).select("node_id", "elevation"), 0.9)
    return landed(out).select("event_id", "node_id", F.round("p", 6).alias("p"), "elevation")


LEAD = 3
FORECAST = f"fc AS (SELECT event_id, user_id AS station, date_trunc('hour', ts) + INTERVAL {LEAD} HOUR AS valid, value * 1.1 AS forecast FROM events WHERE event_type = 'signup')"
VALID = "(datediff('day', DATE '1970-01-01', valid::DATE)*24 + hour(valid))::BIGINT"


@query(
    f"WITH {LAST}, {FORECAST}, m AS (SELECT fc.event_id, fc.station, valid, forecast, value AS observed FROM fc JOIN events e ON e.user_id = fc.station AND e.ts >= valid AND e.ts < valid + INTERVAL 1 HOUR), "
    f"u AS (SELECT event_id, station, valid, forecast, NULL::DOUBLE AS observed FROM fc, l WHERE valid + INTERVAL 1 HOUR <= mark AND event_id NOT IN (SELECT event_id FROM m)) "
    f"SELECT station, {VALID} AS valid_hour, {LEAD}::INTEGER AS lead_h, round(forecast, 4) AS forecast, round(observed, 4) AS observed FROM (SELECT * FROM m UNION ALL SELECT * FROM u)"
)
def stream_settled_forecasts(spark, d):
    """Forecasts made by one kind of event, met by the readings of the hour they are for; unmet ones once that has closed."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    made = rows.where("event_type = 'signup'").select(
        F.col("user_id").alias("station"), (F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.expr(f"interval {LEAD} hours")).alias("valid_ts"),
        F.lit(LEAD).alias("lead_h"), (F.col("value") * 1.1).alias("forecast"),
    )
    out = landed(L.settled_forecasts(made, source(spark, d).select("station", "ts", "mm")))
    return out.select("station", _hour(F.col("valid_ts")).alias("valid_hour"), "lead_h", F.round("forecast", 4).alias("forecast"), F.round("observed", 4).alias("observed"))


@query(
    "SELECT event_id, CASE WHEN ts < (SELECT max(ts) - INTERVAL 5 DAY FROM events) THEN round(value, 4) ELSE floor(value) END AS mm, "
    "CASE WHEN ts < (SELECT max(ts) - INTERVAL 5 DAY FROM events) THEN 0 ELSE 1 END AS rank, strftime(ts, '%Y-%m') AS part FROM events"
)
def stream_restated_readings(spark, d):
    """Readings after several triggers: provisional ones first, then the archive's, which ends five days before the last."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = A.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", L.part_of(F.col("ts")).alias("part"))
    last = rows.agg((F.max("ts") - F.expr("interval 5 days")).alias("last"))
    provisional = rows.select("event_id", F.floor("value").cast("double").alias("mm"), F.lit(1).alias("rank"), "part")
    archive = rows.join(F.broadcast(last), on=F.col("ts") < F.col("last")).select("event_id", F.round("value", 4).alias("mm"), F.lit(0).alias("rank"), "part")
    for turn, piece in enumerate((provisional, archive)):  # a trigger takes one file; the first files are the provisional ones
        piece.repartition(2, "event_id").write.mode("append").option("compression", "none").parquet(f"{at}/landing/turn={turn}")
    stream = spark.readStream.schema("event_id long, mm double, rank int, part string").option("maxFilesPerTrigger", 1).parquet(f"{at}/landing/*")
    write = L.restate(f"{at}/restated", ["event_id"], "rank")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return L.read_restated(spark, f"{at}/restated").select("event_id", "mm", "rank", "part")
