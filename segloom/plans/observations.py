"""Queries over observations of frames, recognisers' outputs, boxes, and task control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import control, decoding, islands, metrics
from . import datasets as D

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEG, FRAME = f"WITH {D.SEG_SQL} ", f"WITH {D.FRAME_SQL} "
BOX_SQL = FRAME.rstrip() + ", l AS (SELECT session_id, CAST(floor(ts_ms / 86400000) AS BIGINT) AS frame_idx, frame_idx AS line_idx, text, confidence, frame_idx * 37 % 900 AS x, frame_idx * 53 % 720 AS y FROM frame)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a user's day as lines of one frame, with boxes of 100 by 30."""
    key = F.col("frame_idx")
    x, y = (key * 37 % 900).cast("double"), (key * 53 % 720).cast("double")
    box = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (100, 0), (100, 30), (0, 30))])
    return D.frame(spark, sf).select("session_id", F.floor(F.col("ts_ms") / 86_400_000).cast("bigint").alias("frame_idx"), key.alias("line_idx"), "text", "confidence", box.alias("box"))


@query(BOX_SQL + " SELECT session_id, frame_idx, line_idx, CAST(x AS DOUBLE) AS x_min, x + CAST(100 AS DOUBLE) AS x_max, CAST(y AS DOUBLE) AS y_min, y + CAST(30 AS DOUBLE) AS y_max FROM l WHERE y + 15 BETWEEN 620 AND 700 AND confidence > CAST(0.3 AS DOUBLE)")
def subtitle_lines(spark: SparkSession, sf: str) -> DataFrame:
    return islands.in_band(islands.sure_lines(_boxes(spark, sf))).select("session_id", "frame_idx", "line_idx", "x_min", "x_max", "y_min", "y_max")


@query(BOX_SQL + " SELECT session_id, frame_idx, line_idx, CAST(row_number() OVER (PARTITION BY session_id, frame_idx ORDER BY floor((y + 15) / CAST(20 AS DOUBLE)), x, line_idx) AS INTEGER) AS place FROM l")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return islands.reading_order(_boxes(spark, sf)).select("session_id", "frame_idx", "line_idx", "place")


@query(BOX_SQL + " SELECT session_id, CAST(count(*) AS BIGINT) AS n, string_agg(text, '' ORDER BY frame_idx, text) AS text FROM l GROUP BY session_id")
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as JSON by session, and what a reader finds in it."""
    from ..sources.transcripts import result_json as emit

    kind = "text STRING, segments ARRAY<STRUCT<text:STRING,confidence:DOUBLE,box:ARRAY<ARRAY<DOUBLE>>>>"
    read = emit(_boxes(spark, sf)).select("session_id", F.from_json("value", kind).alias("d"))
    return read.select("session_id", F.size("d.segments").cast("bigint").alias("n"), "d.text")


@query("""WITH v AS (SELECT vec_id, embedding, unnest(range(16)) AS step FROM embeddings), b AS (SELECT vec_id, step, list_position(r, list_max(r)) - 1 AS c, list_max(r) AS s FROM (SELECT vec_id, step, embedding[step * 4 + 1 : step * 4 + 4] AS r FROM v)),
k AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY step) AS p FROM b), f AS (SELECT * FROM k WHERE c > 0 AND c IS DISTINCT FROM p)
SELECT e.vec_id, coalesce(string_agg(['', 'a', 'b', 'c'][f.c + 1], '' ORDER BY step), '') AS text, round(coalesce(sum(CAST(f.s AS DOUBLE)) / count(f.s), 0), 6) AS confidence FROM embeddings e LEFT JOIN f USING (vec_id) GROUP BY e.vec_id""")
def best_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as scores of four classes in sixteen steps."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4))
    found = D.read(spark, sf, "embeddings").select("vec_id", decoding.best_path(steps, F.array(*map(F.lit, ["", "a", "b", "c"]))).alias("d"))
    return found.select("vec_id", "d.text", F.round("d.confidence", 6).alias("confidence"))


@query("""WITH t AS (SELECT user_id AS session_id, event_id AS pos, CASE WHEN event_id % 4 = 1 THEN 50364 + event_id % 1000 WHEN event_id % 9 = 2 THEN 50300 ELSE event_id % 26 END AS token FROM events),
m AS (SELECT *, sum(CASE WHEN token >= 50364 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS k FROM t), s AS (SELECT session_id, k, (token - 50364) * 20 AS ms FROM m WHERE token >= 50364),
x AS (SELECT session_id, greatest(k, 1) AS k, trim(string_agg(CASE WHEN token = 25 THEN ' ' ELSE chr(97 + CAST(token AS INTEGER)) END, '' ORDER BY pos)) AS text FROM m WHERE token < 50257 AND token <> 24 GROUP BY ALL)
SELECT x.session_id, CAST(x.k AS BIGINT) AS seg_idx, text, CAST(coalesce(b.ms, 0) AS BIGINT) AS start_ms, CAST(coalesce(e.ms, b.ms + 500, 0) AS BIGINT) AS end_ms FROM x LEFT JOIN s b ON b.session_id = x.session_id AND b.k = x.k LEFT JOIN s e ON e.session_id = x.session_id AND e.k = x.k + 1 WHERE text <> ''""")
def token_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tokens: letters, a space, one without a piece, special tokens and timestamps."""
    key = F.col("event_id")
    token = F.when(key % 4 == 1, key % 1000 + decoding.TIME_BEGIN).when(key % 9 == 2, 50_300).otherwise(key % 26)
    tokens = D.read(spark, sf, "events").select(F.col("user_id").alias("session_id"), key.alias("pos"), token.cast("bigint").alias("token"))
    number = F.col("id")
    piece = F.when(number == 24, "=").otherwise(F.base64(F.when(number == 25, " ").otherwise(F.char(number + 97)).cast("binary")))
    return decoding.timed_tokens(tokens, spark.range(26).select(number.alias("token"), piece.alias("piece")))


@query(FRAME.rstrip() + ", run AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) = text THEN 0 ELSE 1 END AS new FROM frame WHERE text <> '')) SELECT session_id, first(frame_idx ORDER BY ts_ms, frame_idx) AS seg_idx, any_value(text) AS text, min(ts_ms) AS start_ms, max(ts_ms) + 1000 AS end_ms, count(*) AS n_merged FROM run GROUP BY session_id, run")
def consecutive_texts(spark: SparkSession, sf: str) -> DataFrame:
    return islands.consecutive(D.frame(spark, sf).select("session_id", F.col("frame_idx").alias("seg_idx"), "text", F.col("ts_ms").alias("time_ms")), 1000)


@query(SEG + "SELECT session_id, seg_idx, CAST(floor(start_ms / CAST(1000 AS DOUBLE) * 5 + 0.5) AS BIGINT) + 1 AS frame_no, CASE WHEN (CAST(floor(start_ms / CAST(1000 AS DOUBLE) * 5 + 0.5) AS BIGINT) + 1) % 3 = 0 AND CAST(floor(start_ms / CAST(1000 AS DOUBLE) * 5 + 0.5) AS BIGINT) + 1 <= 300 THEN 'frame_' || lpad(CAST(CAST(floor(start_ms / CAST(1000 AS DOUBLE) * 5 + 0.5) AS BIGINT) + 1 AS VARCHAR), 5, '0') || '.jpg' END AS path FROM seg")
def snapped_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every third of 300 frames is there."""
    rows = D.seg(spark, sf).select("session_id", "seg_idx", (F.col("start_ms") / 1000).alias("seconds"))
    # the frames that rows could ask for, below a bound for each session
    number = F.floor(F.col("seconds") * 5 + 0.5).cast("bigint") + 1
    there = rows.select("session_id", number.alias("frame_no")).where((F.col("frame_no") % 3 == 0) & (F.col("frame_no") <= 300)).distinct()
    frames = there.withColumn("path", F.concat(F.lit("frame_"), C.ordinal(F.col("frame_no"), 5), F.lit(".jpg")))
    return islands.snapped(rows, frames, "seconds").select("session_id", "seg_idx", "frame_no", "path")


@query(SEG + "SELECT session_id, seg_idx, CASE WHEN seg_idx * 300 % 1300 > 500 AND start_ms + seg_idx * 300 % 1300 - 80 < end_ms THEN start_ms + seg_idx * 300 % 1300 - 80 ELSE start_ms END AS start_ms, end_ms FROM seg")
def lead_in(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.seg(spark, sf).withColumn("removed_ms", F.col("seg_idx") * 300 % 1300)
    return islands.shift_lead_in(rows).select("session_id", "seg_idx", "start_ms", "end_ms")


@query(FRAME.rstrip() + """, m AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) = text THEN 0 ELSE 1 END AS new FROM frame)),
p AS (SELECT session_id, CAST(run AS BIGINT) AS seg_idx, any_value(text) AS text, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM m GROUP BY session_id, run HAVING count(*) >= 2),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY start_ms, seg_idx) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY session_id ORDER BY start_ms, seg_idx) = text AND start_ms - lag(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, seg_idx) < 50000000 THEN 0 ELSE 1 END AS new FROM p WHERE text <> ''))
SELECT session_id, min(seg_idx) AS run, any_value(text) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged FROM r GROUP BY session_id, r.run""")
def bridged_runs(spark: SparkSession, sf: str) -> DataFrame:
    return islands.bridge_runs(islands.stable_runs(D.frame(spark, sf), 50.0), 50_000_000)


@query("SELECT l_orderkey AS session_id, count(*) AS n_frames, CAST(floor(sum(l_quantity) + 0.5) AS BIGINT) AS det_ms, CAST(floor(sum(l_linenumber) + 0.5) AS BIGINT) AS post_ms, CAST(floor(avg(l_quantity + l_linenumber) + 0.5) AS BIGINT) AS mean_ms FROM lineitem GROUP BY 1")
def frame_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_quantity").alias("det"), F.col("l_linenumber").alias("post"))
    return metrics.stage_times(rows, ["det", "post"])


@query(SEG + "SELECT session_id, sum(end_ms - start_ms) / CAST(1000 AS DOUBLE) AS scheduled_s FROM seg GROUP BY session_id")
def scheduled_time(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.scheduled_seconds(D.seg(spark, sf))


@query(SEG.rstrip() + ", i AS (SELECT *, seg_idx % 5 = 0 OR trim(text) = '' OR seg_idx % 7 = 3 AS skipped, seg_idx % 4 = 1 AS failed, seg_idx < 6 AS finished FROM seg) SELECT session_id, count(*) FILTER (NOT skipped AND finished AND NOT failed) AS generated, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND failed AND finished) AS errors, CAST(floor(100 * count(*) FILTER (skipped OR finished) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS percent FROM i GROUP BY session_id")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("seg_idx")
    items = D.seg(spark, sf).select("session_id", "text", (key % 5 == 0).alias("exists"), F.when(key % 7 != 3, "ref.wav").alias("reference"), (key % 4 == 1).alias("failed"), (key < 6).alias("finished"))
    return metrics.progress_counts(items)


@query("SELECT event_type, user_id, round(avg(value / 500), 3) AS confidence FROM events GROUP BY ALL")
def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.group_confidence(D.read(spark, sf, "events").select("event_type", "user_id", (F.col("value") / 500).alias("confidence")), ["event_type", "user_id"])


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS scaled, max(abs(value)) OVER w AS peak FROM events WINDOW w AS (PARTITION BY event_type)")
def normalised_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.normalised(D.read(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return rows.select("event_id", F.round("scaled", 6).alias("scaled"), "peak")


@query("SELECT p_brand AS label, count(*) AS n, CASE WHEN c.n_name IS NULL THEN NULL ELSE c.n_nationkey / CAST(100 AS DOUBLE) END AS cer, CASE WHEN c.n_name IS NULL THEN 'N/A' ELSE printf('%.2f%%', CAST(c.n_nationkey AS DOUBLE)) END AS shown FROM part LEFT JOIN nation c ON p_brand = 'Brand#' || c.n_nationkey AND c.n_nationkey % 3 <> 0 GROUP BY ALL")
def error_table(spark: SparkSession, sf: str) -> DataFrame:
    scores = D.read(spark, sf, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))
    key = F.col("n_nationkey")
    known = D.read(spark, sf, "nation").where(key % 3 != 0).select(F.concat(F.lit("Brand#"), key.cast("string")).alias("label"), (key / 100).alias("cer"))
    return metrics.error_report(scores, known, "label").select("label", "n", "cer", "shown")


@query(f"WITH {D.DIM_STAGE_SQL} SELECT o_orderkey AS task_id, d.ord, d.name, d.label, 'pending' AS status FROM orders CROSS JOIN dim_stage d WHERE d.name NOT IN ('ocr', 'ocr_fix')")
def created_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of new tasks in the mode that reads speech."""
    tasks = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("url"))
    made, rows = control.created(tasks, control.stages_of(D.dim_stage(spark), "dub"))
    return rows.join(made.select("task_id"), "task_id", "left_semi").select("task_id", "ord", "name", "label", "status")


@query(f"""WITH {D.DIM_STAGE_SQL} SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'subtitle ocr' ELSE 'dub asr' END AS mode, ord, name FROM orders, dim_stage
WHERE CASE WHEN o_orderkey % 2 = 0 THEN name IN ('download', 'ocr', 'ocr_fix', 'translate', 'merge_video') ELSE name NOT IN ('ocr', 'ocr_fix', 'translate') END""")
def mode_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of each task by its mode."""
    dim = D.dim_stage(spark)
    modes = {"subtitle ocr": control.stages_of(dim, "subtitle", "ocr"), "dub asr": control.stages_of(dim, "dub", translate=False)}
    tasks = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderkey") % 2 == 0, "subtitle ocr").otherwise("dub asr").alias("mode"))
    return control.stages_by_mode(tasks, modes).select("task_id", "mode", "ord", "name")


@query(f"WITH {D.STAGE_LOG_SQL}, w AS (SELECT task_id, name, seq, CASE WHEN progress % 7 <> 0 THEN progress END AS progress FROM stage_log) SELECT task_id, name, seq, coalesce(progress, 0) AS progress, CASE WHEN seq % 5 <> 0 THEN seq * 1000 END AS duration_ms, 0 AS off FROM w")
def stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Stage rows with how long they took, null where they haven't ended; ``off`` is 1 if the clock's text has another form."""
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss")
    begin = F.lit(1_700_000_000)
    log = D.stage_log(spark, sf).select("task_id", "name", "seq", F.when(F.col("progress") % 7 != 0, F.col("progress")).alias("progress"), stamp(begin).alias("started_at"), F.when(F.col("seq") % 5 != 0, stamp(begin + F.col("seq"))).alias("completed_at"))
    return control.with_durations(log).select("task_id", "name", "seq", "progress", "duration_ms", (~C.now_iso().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).cast("int").alias("off"))


@query(FRAME + """, t AS (SELECT session_id, frame_idx, CASE WHEN frame_idx % 3 = 0 THEN '字幕' WHEN frame_idx % 3 = 1 THEN '字' ELSE text END AS piece FROM frame WHERE text <> '')
SELECT session_id, count(*) AS pieces, count(*) FILTER (frame_idx % 3 <> 2) AS cjk, CAST(sum(CASE WHEN frame_idx % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS tokens FROM t GROUP BY session_id""")
def split_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of one session as an array, those of several CJK characters taken apart."""
    third = F.col("frame_idx") % 3
    rows = D.frame(spark, sf).where("text <> ''").withColumn("piece", F.when(third == 0, "字幕").when(third == 1, "字").otherwise(F.col("text")))
    pieces = rows.select("piece").union(rows.where("piece = '字幕'").select(F.lit("幕"))).distinct()
    vocabulary = pieces.select("piece", F.xxhash64("piece").alias("token"))
    tokens = decoding.by_character(rows.select("session_id", F.col("frame_idx").alias("pos"), F.xxhash64("piece").alias("token")), vocabulary)
    counts = rows.groupBy("session_id").agg(F.count("*").alias("pieces"), F.count_if(C.is_cjk(F.col("piece"))).alias("cjk"))
    return counts.join(tokens, "session_id").select("session_id", "pieces", "cjk", F.size("tokens").cast("long").alias("tokens"))


@query("WITH t AS (SELECT o_orderkey AS task_id, o_custkey % 50 AS video, o_orderdate AS created_at FROM orders WHERE o_custkey % 4 <> 0), k AS (SELECT video, arg_max(task_id, (created_at, task_id)) AS known FROM t GROUP BY video) SELECT 'v' || n_nationkey AS video_id, k.known AS known_task FROM nation LEFT JOIN k ON k.video = n_nationkey")
def known_videos(spark: SparkSession, sf: str) -> DataFrame:
    video = lambda c: F.concat(F.lit("v"), c.cast("string")).alias("video_id")
    orders = D.read(spark, sf, "orders").where("o_custkey % 4 <> 0")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), video(F.col("o_custkey") % 50), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"))
    return control.known_tasks(D.read(spark, sf, "nation").select(video(F.col("n_nationkey"))), tasks)


LATEST_SQL = f"WITH {D.STAGE_LOG_SQL}, latest AS (SELECT * FROM stage_log QUALIFY row_number() OVER (PARTITION BY task_id, name ORDER BY seq DESC, status DESC, progress DESC) = 1)"


@query(LATEST_SQL + " SELECT task_id, name, CASE WHEN name = 'merge_video' AND task_id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN name = 'merge_video' AND task_id % 3 = 0 THEN 0 ELSE progress END AS progress FROM latest")
def switched_mode(spark: SparkSession, sf: str) -> DataFrame:
    stored = control.latest(D.stage_log(spark, sf), ["task_id", "name"])
    return control.with_mode(stored, stored.where("task_id % 3 = 0")).select("task_id", "name", "status", "progress")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'old' END AS status FROM customer")
def patched_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Patches laid over stored rows; those without a value change nothing and don't reach the log."""
    key = F.col("c_custkey")
    rows = D.read(spark, sf, "customer").select(key.alias("id"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("status"))
    patches = control.changes(rows, ["id"])
    log = rows.select("id", F.lit("old").alias("status"), F.lit(0).alias("seq")).union(patches.select("id", "status", F.lit(1)))
    return control.latest(log, ["id"]).select("id", "status")


@query("WITH d AS (SELECT c_nationkey AS host, c_mktsegment AS vendor, c_name AS name, CASE WHEN c_custkey % 97 = 0 THEN 'new' ELSE 'v1' END AS driver FROM customer) SELECT host, count(*) FILTER (driver = 'new') = 0 AS valid FROM d GROUP BY host")
def driver_caches(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "customer").select(F.col("c_nationkey").alias("host"), F.col("c_mktsegment").alias("vendor"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 97 == 0, "new").otherwise("v1").alias("driver"))
    return control.cache_state(rows, rows.withColumn("driver", F.lit("v1")))


@query(LATEST_SQL + " SELECT task_id, count(*) AS n, max(CASE WHEN name = 'tts' THEN status END) AS tts FROM latest GROUP BY task_id")
def status_maps(spark: SparkSession, sf: str) -> DataFrame:
    stored = control.latest(D.stage_log(spark, sf), ["task_id", "name"])
    maps = stored.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "status"))).alias("m"))
    return maps.select("task_id", F.size("m").cast("bigint").alias("n"), F.col("m")["tts"].alias("tts"))
