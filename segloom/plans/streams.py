"""Queries that run streams over files of given rows to their end, and read what the streams have added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import messages, sinks
from . import datasets as D
from .shared import scratch_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(events: DataFrame, kind, **more) -> DataFrame:
    """A message of JSON for each event, a line each."""
    fields = {"type": kind, "stage": F.col("event_type"), "task_id": F.col("user_id").cast("string"), "progress": F.col("event_id") % 100} | more
    return events.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


def _drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    sinks.append_once(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return sinks.read_appended(spark, f"{path}/table").drop("batch")


@query("SELECT 'progress' AS type, event_type AS stage, CAST(user_id AS VARCHAR) AS task_id, CAST(event_id % 100 AS INTEGER) AS progress FROM events WHERE event_id % 10 <> 3")
def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of JSON, one in ten broken off: what is no message is left out."""
    path, events = scratch_path(spark), D.read(spark, sf, "events")
    whole = _lines(events.where("event_id % 10 <> 3"), F.lit("progress"))
    whole.union(events.where("event_id % 10 = 3").select(F.lit('{"type":"progress","stage"'))).write.text(f"{path}/in")
    return _drained(spark, messages.parse_messages(spark.readStream.text(f"{path}/in")), path).select("type", "stage", "task_id", "progress")


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id % 100 ELSE floor(100 * (event_id % 12) / CAST(12 AS DOUBLE)) END AS INTEGER) AS progress FROM events WHERE event_id % 3 <> 2")
def progress_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Percentages from lines of both forms in a stream; other lines are left out."""
    path, id_ = scratch_path(spark), F.col("event_id")
    percent = F.concat(F.lit("[PROGRESS] "), (id_ % 100).cast("string"))
    share = F.concat((id_ % 12).cast("string"), F.lit("/12"))
    line = F.when(id_ % 3 == 0, percent).when(id_ % 3 == 1, share).otherwise("loading model")
    D.read(spark, sf, "events").select(F.to_json(F.struct("event_id", line.alias("value"))).alias("value")).write.text(f"{path}/in")
    parsed = spark.readStream.text(f"{path}/in").select(F.from_json("value", "event_id BIGINT, value STRING").alias("x")).select("x.*")
    return _drained(spark, messages.progress_of(parsed), path).select("event_id", "progress")
