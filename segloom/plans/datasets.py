"""Segments, hypotheses, frames, lines and stage logs derived from the given tables, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import STAGES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as segments one after the other."""
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), text.alias("text"),
        (200 + 10 * F.length(text)).cast("bigint").alias("dur"), ((F.col("turn") * 137) % 600).alias("gap"),
    )
    before = W.partitionBy("session_id").orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start_ms", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)).cast("bigint"))
    return placed.select("session_id", "seg_idx", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg`` moved a little, without some rows, and with one row per session far behind its end."""
    rows = seg(spark, sf_dir)
    shift = (F.col("seg_idx") * 53) % 400 - 200
    moved = rows.where("seg_idx % 7 <> 3").select("session_id", "seg_idx", "text", F.greatest(F.col("start_ms") + shift, F.lit(0)).alias("start_ms"), F.greatest(F.col("end_ms") + shift, F.lit(50)).alias("end_ms"))
    extra = rows.groupBy("session_id").agg((F.max("seg_idx") + 1000).alias("seg_idx"), F.lit("extra").alias("text"), (F.max("end_ms") + 10_000).alias("start_ms"), (F.max("end_ms") + 10_500).alias("end_ms"))
    return moved.unionByName(extra)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames: blank now and then, and sometimes a letter longer."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").withColumn("ms", F.floor(us / 1000))
    first = rows.agg(F.min("ms").alias("first_ms"))
    text = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit("s"))).otherwise(F.col("event_type"))
    return rows.join(F.broadcast(first)).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"), (F.col("ms") - F.col("first_ms")).cast("bigint").alias("ts_ms"), text.alias("text"), (F.col("value") / 500).alias("confidence"),
    )


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a user's day as lines of one frame; confidences often tie."""
    rows = frame(spark, sf_dir)
    order = W.partitionBy("session_id", "day").orderBy("ts_ms", "frame_idx")
    numbered = rows.withColumn("day", F.floor(F.col("ts_ms") / 86_400_000).cast("bigint"))
    return numbered.select("session_id", F.col("day").alias("frame_idx"), F.row_number().over(order).cast("bigint").alias("line_idx"), "text", (F.floor(F.col("confidence") * 50) / 50).alias("confidence"))


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as status changes of an order's stages, in the order ``seq``."""
    names = F.array(*[F.lit(n) for n, _ in STAGES])
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "succeeded").otherwise("running")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.get(names, (F.col("l_partkey") % len(STAGES)).cast("int")).alias("name"), (F.col("l_linenumber") + 10 * F.col("l_suppkey")).cast("bigint").alias("seq"),
        status.alias("status"), F.col("l_quantity").cast("int").alias("progress"),
    )


def dim_stage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, label) for i, (n, label) in enumerate(STAGES)], "ord int, name string, label string")


SEG_SQL = """seg AS (
  SELECT session_id, seg_idx, speaker, text, start_ms, start_ms + dur AS end_ms FROM (
    SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY session_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM (
      SELECT conv_id AS session_id, turn AS seg_idx, role AS speaker, coalesce(text, '') AS text, CAST(200 + 10 * length(coalesce(text, '')) AS BIGINT) AS dur, (turn * 137) % 600 AS gap FROM conversations)))"""
HYP_SQL = (
    SEG_SQL
    + """, hyp AS (
  SELECT session_id, seg_idx, text, greatest(start_ms + (seg_idx * 53) % 400 - 200, 0) AS start_ms, greatest(end_ms + (seg_idx * 53) % 400 - 200, 50) AS end_ms FROM seg WHERE seg_idx % 7 <> 3
  UNION ALL SELECT session_id, max(seg_idx) + 1000, 'extra', max(end_ms) + 10000, max(end_ms) + 10500 FROM seg GROUP BY session_id)"""
)
FRAME_SQL = """frame AS (
  SELECT user_id AS session_id, event_id AS frame_idx, ms - min(ms) OVER () AS ts_ms,
         CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 4 = 0 THEN event_type || 's' ELSE event_type END AS text, value / 500 AS confidence
  FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events))"""
LINE_SQL = (
    FRAME_SQL
    + """, line AS (
  SELECT session_id, day AS frame_idx, row_number() OVER (PARTITION BY session_id, day ORDER BY ts_ms, frame_idx) AS line_idx, text, floor(confidence * 50) / 50 AS confidence
  FROM (SELECT *, CAST(floor(ts_ms / 86400000) AS BIGINT) AS day FROM frame))"""
)
DIM_STAGE_SQL = "dim_stage AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{label}')" for i, (n, label) in enumerate(STAGES)) + ") AS t(ord, name, label))"
STAGE_LOG_SQL = (
    DIM_STAGE_SQL
    + f""", stage_log AS (
  SELECT l_orderkey AS task_id, (SELECT name FROM dim_stage WHERE ord = l_partkey % {len(STAGES)}) AS name, CAST(l_linenumber + 10 * l_suppkey AS BIGINT) AS seq,
         CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'running' END AS status, CAST(l_quantity AS INTEGER) AS progress
  FROM lineitem)"""
)
