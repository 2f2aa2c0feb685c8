"""Registered queries on the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import series
from .plans import adapters, composed_queries, graph_queries, report_queries, scenario_queries, score_queries, series_queries, stream_queries, whole_queries

MODULES = (series_queries, graph_queries, score_queries, scenario_queries, stream_queries, composed_queries, whole_queries, report_queries)


def queries() -> dict:
    return {"rain_events": flagship} | {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {"rain_events": FLAGSHIP_SQL} | {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to hours, gaps filled, rain events and their totals, the wettest ten first."""
    rows = adapters.wet(spark, sf_dir).withColumn("is_imputed", F.lit(False)).withColumn("source", F.lit("gauge"))
    filled = series.fill_gaps(rows, [], "mm")
    events = series.event_totals(series.rain_events(filled, [], "mm", 0.0, 2), [], "mm")
    return events.withColumn("total", F.round("total", 4)).orderBy(F.desc("total"), "event_id").limit(10)


FLAGSHIP_SQL = adapters.with_views(
    f"WITH {series_queries.EVENTS}, {series_queries.TOTALS} SELECT * FROM tot ORDER BY total DESC, event_id LIMIT 10"
)
