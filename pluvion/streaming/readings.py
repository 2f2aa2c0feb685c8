"""Streams of rain readings (station, ts, mm). ts must be a TIMESTAMP; cast TIMESTAMP_NTZ first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def readings(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings with a watermark; what comes later than it is dropped by the operators that follow."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def first_arrivals(stream: DataFrame) -> DataFrame:
    """One row for each station and stamp: the first that arrives (batch dedup keeps the last)."""
    return stream.dropDuplicatesWithinWatermark(["station", "ts"])


def hourly_totals(stream: DataFrame) -> DataFrame:
    """(station, hour_end, mm): tumbling hours, named by their end."""
    w = F.window("ts", "1 hour")
    return stream.groupBy("station", w.alias("w")).agg(F.sum("mm").alias("mm")).select("station", F.col("w.end").alias("hour_end"), "mm")


def sliding_totals(stream: DataFrame, hours: int) -> DataFrame:
    """(station, hour_end, mm) of the last `hours` hours, every hour."""
    w = F.window("ts", f"{hours} hours", "1 hour")
    return stream.groupBy("station", w.alias("w")).agg(F.sum("mm").alias("mm")).select("station", F.col("w.end").alias("hour_end"), "mm")


def rain_sessions(stream: DataFrame, wet: float, max_dry_hours: int) -> DataFrame:
    """(station, start, last, total) of rain events; a session ends max_dry_hours + 1 hours after its last wet stamp."""
    gap = max_dry_hours + 1
    s = F.session_window("ts", f"{gap} hours")
    got = stream.where(F.col("mm") > wet).groupBy("station", s.alias("s")).agg(F.sum("mm").alias("total"))
    return got.select("station", F.col("s.start").alias("start"), (F.col("s.end") - F.expr(f"interval {gap} hours")).alias("last"), "total")


def leaky_store(stream: DataFrame, capacity: float, cap: float) -> DataFrame:
    """(station, ts, store, spill): a store per station that takes mm, leaks up to capacity and spills above cap.

    Rows of a trigger are taken in order of ts; state is one number a station and leaves a day of event time after
    its last reading.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        store = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        stores, spills = [], []
        for mm in rows["mm"]:
            full = store + float(mm)
            left = full - min(full, capacity)
            store = min(left, cap)
            stores.append(store), spills.append(left - store)
        state.update((store,))
        last = int(pd.Timestamp(rows["ts"].iloc[-1]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame({"station": [key[0]] * len(rows), "ts": rows["ts"].values, "store": stores, "spill": spills})

    kind = stream.schema["station"].dataType.simpleString()
    return stream.select("station", "ts", "mm").groupBy("station").applyInPandasWithState(
        step, f"station {kind}, ts timestamp, store double, spill double", "store double", "append", GroupStateTimeout.EventTimeTimeout
    )


def alerts(predictions: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Predictions at or above the threshold with their nodes' static columns (stream-static join)."""
    return predictions.where(F.col("p") >= threshold).join(nodes, "node_id")


def restate(path: str, keys: list[str], rank: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: of stored rows and the batch, the row of the lowest rank for each key, by partition `part`.

    Only the partitions that the batch touches are read and written again, each as a version of its own; a reader takes the
    newest version of each partition (read_restated). A batch that runs twice reads what was there before it and writes the
    same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, before = batch, read_restated(batch.sparkSession, path, before=batch_id)
        if before is not None:
            parts = batch.select("part").distinct()
            rows = before.join(parts, "part", "left_semi").unionByName(batch)
        cols = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(rank)).alias("_r")).select(*keys, "_r.*")
        versioned = best.withColumn("version", F.lit(batch_id))
        versioned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(path)

    return write


def read_restated(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of each partition that restate wrote (older than a batch, if one is given); None if there is none."""
    try:
        rows = spark.read.parquet(path).withColumn("part", F.col("part").cast("string"))
    except AnalysisException:
        return None
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("part").agg(F.max("version").alias("version"))
    found = rows.join(newest, ["part", "version"], "left_semi").drop("version")
    return None if found.isEmpty() else found


def match_forecasts(forecasts: DataFrame, observations: DataFrame, within: str = "3 hours") -> DataFrame:
    """Forecast rows (station, valid_ts, lead_h, forecast) with the observation of their hour, arriving within a bound."""
    f = forecasts.withWatermark("valid_ts", within).alias("f")
    o = observations.withWatermark("ts", within).alias("o")
    return f.join(
        o,
        (F.col("f.station") == F.col("o.station"))
        & (F.col("o.ts") >= F.col("f.valid_ts"))
        & (F.col("o.ts") < F.col("f.valid_ts") + F.expr("interval 1 hour")),
    ).select(F.col("f.station"), "valid_ts", "lead_h", "forecast", F.col("o.mm").alias("observed"))


def settled_forecasts(forecasts: DataFrame, observations: DataFrame, late: str = "2 hours") -> DataFrame:
    """Forecasts (station, valid_ts, lead_h, forecast) with each observation of their hour, or none once it has closed.

    Both streams carry a watermark, and the bound on the observation's stamp lets Spark drop what can meet nothing any more:
    a forecast leaves the state, unmatched with a null, when the watermark has passed its hour. Rows later than the
    watermark are dropped.
    """
    f = forecasts.withWatermark("valid_ts", late).alias("f")
    o = observations.withWatermark("ts", late).alias("o")
    on = (
        (F.col("f.station") == F.col("o.station"))
        & (F.col("o.ts") >= F.col("f.valid_ts"))
        & (F.col("o.ts") < F.col("f.valid_ts") + F.expr("interval 1 hour"))
    )
    return f.join(o, on, "left").select(F.col("f.station"), "valid_ts", "lead_h", "forecast", "ts", F.col("o.mm").alias("observed"))


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, into a table in memory; for tests and small looks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def part_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
