"""Queries that write rows of the tables as databases, folders, versions and streams, and read them again."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, plugs, versions
from ..sources import databases, named_files
from ..sources import transcripts as T
from ..streaming import sinks
from . import datasets as D
from . import runner, timeline
from .runner import Stage, StageFailed
from .shared import scratch_path
from .stages import STAGES

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEG = f"WITH {D.SEG_SQL} "
#: The schedule's SQL over the segments that have text.
ORACLE_SCHEDULE = timeline.ORACLES["drift_schedule"].replace("AS k FROM seg)", "AS k FROM seg WHERE trim(text) <> '')")


@query("SELECT o_orderkey, o_clerk, o_totalprice FROM (SELECT o_orderkey, o_custkey AS o_clerk, o_totalprice FROM orders) WHERE o_totalprice > 150000 AND o_orderkey % 2 = 1")
def database_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in SQLite files, scanned in four partitions at least; one filter goes to SQLite, one only Spark knows."""
    path = scratch_path(spark)
    orders = D.read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("o_clerk"), "o_totalprice")
    databases.write_sqlite(orders, path, "orders")
    return databases.read_sqlite(spark, path, "orders", 4).where("o_totalprice > 150000 AND o_orderkey % 2 = 1")


@query(SEG + "SELECT session_id, 'subtitles/' || session_id || '.srt' AS name, CAST(count(*) AS BIGINT) AS cues, CAST(sum(length(text)) AS BIGINT) AS chars FROM seg GROUP BY session_id")
def subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    """A subtitle file for each session under the session's own name, read back cue by cue."""
    path = scratch_path(spark)
    T.write_subtitles(D.seg(spark, sf).withColumn("part", F.lit(0)), path)
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.srt$", 1).alias("id"))
    cues = read.select("id", F.explode(F.regexp_extract_all(F.concat("value", F.lit("\n")), F.lit(r"(?s)\d+\n[\d:,]+ --> [\d:,]+\n(.*?)\n(?=\n\d+\n[\d:,]+ -->|\n\z)"), F.lit(1))).alias("text"))
    counted = cues.groupBy("id").agg(F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars"))
    return counted.select(F.col("id").cast("bigint").alias("session_id"), F.concat(F.lit("subtitles/"), "id", F.lit(".srt")).alias("name"), "cues", "chars")


DOCUMENT_SQL = SEG + """SELECT label, session_id, k AS seg_idx, trim(text) AS text, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seg_idx) - 1 AS k, 'l' || session_id % 3 AS label FROM seg) WHERE session_id % 5 <> 4"""


def _documents(spark: SparkSession, sf: str) -> str:
    """Each session's document as pretty JSON in a nested folder of its label; one in five broken off."""
    path = scratch_path(spark)
    whole = F.to_json(F.struct("result", "session_id"), {"pretty": "true"})
    broken = F.when(F.col("session_id") % 5 == 4, F.substring(whole, F.lit(1), F.length(whole) - 10)).otherwise(whole)
    id_, label = F.col("session_id").cast("string"), F.concat(F.lit("l"), (F.col("session_id") % 3).cast("string"))
    name = F.when(F.col("session_id") % 2 == 0, F.concat_ws("/", F.lit("runs"), id_, label, F.lit("metadata/asr.json"))).otherwise(F.concat_ws("/", F.lit("runs"), id_, label, F.lit("asr.json")))
    named_files.write_named_files(T.documents_of(D.seg(spark, sf)).select(name.alias("name"), broken.alias("value")), path)
    return path


@query(DOCUMENT_SQL)
def document_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of nested folders, labels by folder, those that aren't JSON left out."""
    read = T.read_transcripts(spark, _documents(spark, sf), recursive=True, pattern="*.json").where("corrupt IS NULL")
    rows = T.segments_of(read.withColumn("id", F.concat_ws(" ", "label", F.regexp_extract("path", r"/runs/(\d+)/", 1))), session="id")
    return rows.select(F.split("session_id", " ")[0].alias("label"), F.split("session_id", " ")[1].cast("bigint").alias("session_id"), F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", "start_ms", "end_ms")


@query(SEG + "SELECT 'l' || session_id % 3 AS label, count(DISTINCT session_id) FILTER (session_id % 5 <> 4) AS whole, count(DISTINCT session_id) FILTER (session_id % 5 = 4) AS corrupt FROM seg WHERE session_id % 2 = 1 GROUP BY 1")
def one_level(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that lie in a label's folder itself, by a glob of one level, with the broken ones counted."""
    read = T.read_transcripts(spark, f"{_documents(spark, sf)}/runs/*/l*/*.json")
    return read.groupBy("label").agg(F.count("result").alias("whole"), F.count("corrupt").alias("corrupt"))


@query("SELECT 'u' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY lpad(CAST(event_id AS VARCHAR), 9, '0')) - 1 AS frame_idx, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 5 / CAST(30 AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS ts_ms, CAST(length(event_type) AS BIGINT) AS length FROM events WHERE event_id % 20 = 0")
def frame_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of frames in folders by session, in order of name, with the time of each; other files are no frames."""
    path, number = scratch_path(spark), F.col("event_id").cast("string")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/frame"), F.lpad(number, 9, "0"))
    events = D.read(spark, sf, "events").where("event_id % 20 = 0")
    frames = events.select(F.concat(name, F.lit(".jpg")).alias("name"), F.col("event_type").alias("value"))
    others = events.where("event_id % 60 = 0").select(F.concat(name, F.lit(".txt")).alias("name"), F.lit("no frame").alias("value"))
    named_files.write_named_files(frames.union(others), path)
    found = T.frames_of(spark, path, step=5, fps=30.0)
    return found.select(F.regexp_extract("session_id", r"([^/]+)$", 1).alias("session_id"), F.col("frame_idx").cast("bigint").alias("frame_idx"), "ts_ms", "length")


@query("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN 'subtitle' ELSE 'dub' END AS pipeline, c_name AS title FROM customer")
def session_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions' information, a file in each session's folder, with its default."""
    path, key = scratch_path(spark), F.col("c_custkey")
    info = F.to_json(F.struct(F.when(key % 2 == 0, "subtitle").alias("pipeline"), F.col("c_name").alias("title")), {"pretty": "true"})
    named_files.write_named_files(D.read(spark, sf, "customer").select(F.concat(F.lit("s"), key.cast("string"), F.lit("/info.json")).alias("name"), info.alias("value")), path)
    read = T.session_info(spark, path, "pipeline STRING, title STRING")
    return read.select(F.regexp_extract("path", r"/s(\d+)/info\.json$", 1).cast("bigint").alias("session_id"), "pipeline", "title")


@query(SEG + "SELECT session_id, seg_idx, text AS src, CASE WHEN length(text) % 10 = 7 THEN text ELSE '[' || text || ']' END AS dst, length(text) % 10 = 7 AS fell_back FROM seg")
def translated_or_source(spark: SparkSession, sf: str) -> DataFrame:
    """A translator that refuses some texts: these alone fall back to their source."""
    return plugs.translate(D.seg(spark, sf), plugs.backend("bracketer", refuses=7))


@query(f"WITH {D.DIM_STAGE_SQL} SELECT o_orderkey AS task_id, o_orderpriority AS url, s.ord, s.name, 'pending' AS status FROM orders CROSS JOIN dim_stage s WHERE s.name NOT IN ('ocr', 'ocr_fix') AND o_orderkey % 3 <> 0")
def versioned_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks with their stages, made together in two versions; a third that fails between both tables leaves the second."""
    path = scratch_path(spark)
    tasks = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("url"))
    specs = control.stages_of(D.dim_stage(spark), "dub")
    made, rows = control.created(tasks.where("task_id % 3 = 1"), specs)
    versions.write_tables(spark, path, {"tasks": made, "stages": rows})
    both = versions.read_tables(spark, path)
    more, more_rows = control.created(tasks.where("task_id % 3 = 2"), specs)
    versions.write_tables(spark, path, {"tasks": both["tasks"].unionByName(more), "stages": both["stages"].unionByName(more_rows)})
    read = versions.read_tables(spark, path)
    return read["tasks"].select("task_id", "url").join(read["stages"], "task_id").select("task_id", "url", "ord", "name", "status")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def appended_once(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a stream added to a table, with its batches done again: no row is added twice."""
    path, table = scratch_path(spark), D.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    sinks.append_once(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    sinks.replace_batch(table, 0, f"{path}/table")
    return sinks.read_appended(spark, f"{path}/table").drop("batch")


@query(ORACLE_SCHEDULE)
def staged_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Stages from the registry, run from segments to a schedule: one fails at first, and the next run goes on with it."""
    path, asr = scratch_path(spark), D.seg(spark, sf)
    bracketed = lambda rows: rows.withColumn("d", F.concat(F.lit("["), "text", F.lit("]")))
    timed = lambda rows: rows.select("session_id", "seg_idx", F.col("start_time").alias("start_ms"), F.col("end_time").alias("end_ms"), (F.col("end_time") - F.col("start_time") + (F.col("seg_idx") * 211) % 700 - 300).alias("dur_ms"))
    broken = Stage("translate", ("asr_fix",), lambda t: t["asr_fix"].withColumn("text", F.raise_error(F.lit("no model")).cast("string")))
    chain = [
        Stage("asr_fix", ("asr",), lambda t: STAGES["asr_fix"](t["asr"])), Stage("translate", ("asr_fix",), lambda t: STAGES["translate"](bracketed(t["asr_fix"]), "d", "en", "fr")),
        Stage("merge_audio", ("translate",), lambda t: STAGES["merge_audio"](timed(t["translate"]))),
    ]
    with contextlib.suppress(StageFailed):
        runner.run(spark, path, [chain[0], broken, chain[2]], {"asr": asr}, {"asr": "1"})
    outcomes = runner.run(spark, path, chain, {"asr": asr}, {"asr": "1"})
    if list(outcomes.values()) != ["fresh", "made", "made"]:
        raise AssertionError(f"stages were {outcomes}")
    return versions.read_tables(spark, path)["merge_audio"]
