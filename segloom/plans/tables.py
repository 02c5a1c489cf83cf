"""Queries over tasks, URLs, texts and benchmark rows, each with the same in DuckDB SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import control, folds, intervals, metrics
from . import datasets as D

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LATEST_SQL = f"WITH {D.STAGE_LOG_SQL}, latest AS (SELECT * FROM stage_log QUALIFY row_number() OVER (PARTITION BY task_id, name ORDER BY seq DESC, status DESC, progress DESC) = 1)"
STATUS_SQL = LATEST_SQL + ", status AS (SELECT t.task_id, d.ord, d.name, d.label, coalesce(l.status, 'pending') AS status, coalesce(l.progress, 0) AS progress FROM (SELECT DISTINCT task_id FROM stage_log) t CROSS JOIN dim_stage d LEFT JOIN latest l ON l.task_id = t.task_id AND l.name = d.name)"


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return control.latest(D.stage_log(spark, sf), ["task_id", "name"])


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return control.stage_status(_latest(spark, sf), D.dim_stage(spark), D.stage_log(spark, sf))


@query(LATEST_SQL + " SELECT * FROM latest")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(spark, sf)


@query(STATUS_SQL + " SELECT * FROM status")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


@query(STATUS_SQL + " SELECT task_id, count(*) FILTER (status = 'succeeded') AS done, count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM status GROUP BY task_id")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return control.status_summary(_status(spark, sf))


@query(f"WITH {D.STAGE_LOG_SQL} SELECT t.task_id, d.name, d.ord, d.label FROM (SELECT DISTINCT task_id FROM stage_log) t CROSS JOIN dim_stage d WHERE NOT EXISTS (SELECT 1 FROM stage_log l WHERE l.task_id = t.task_id AND l.name = d.name)")
def new_stages(spark: SparkSession, sf: str) -> DataFrame:
    log = D.stage_log(spark, sf)
    return control.missing_stages(log, D.dim_stage(spark), log)


@query(STATUS_SQL + " SELECT task_id, min(ord) FILTER (status <> 'succeeded') AS resume_ord FROM status GROUP BY task_id")
def resume_point(spark: SparkSession, sf: str) -> DataFrame:
    return control.resume_points(_status(spark, sf))


@query(STATUS_SQL + ", r AS (SELECT task_id, min(ord) FILTER (status <> 'succeeded') AS o FROM status GROUP BY task_id) SELECT s.task_id, s.ord, s.name, s.label, CASE WHEN s.ord >= r.o THEN 'pending' ELSE s.status END AS status, s.progress FROM status s JOIN r USING (task_id)")
def reset_stages(spark: SparkSession, sf: str) -> DataFrame:
    status = _status(spark, sf)
    return control.reset_from(status, control.resume_points(status))


@query("SELECT o_orderkey AS task_id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    tasks = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    gone = D.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return control.delete_tasks(tasks, D.stage_log(spark, sf), gone)[0].select(F.col("id").alias("task_id"), "status")


@query(f"WITH {D.STAGE_LOG_SQL} SELECT task_id, name, count(*) AS n FROM stage_log WHERE task_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL")
def delete_cascade_stages(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the stages of deleted tasks: nothing."""
    tasks = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    gone = D.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return control.delete_tasks(tasks, D.stage_log(spark, sf), gone)[1].groupBy("task_id", "name").agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE CAST(page_id AS VARCHAR) = '12' OR contains(url, '12') ORDER BY url DESC, page_id DESC LIMIT 1")
def newest_task(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "url", F.col("url").alias("created_at"), F.col("page_id").alias("seq"))
    return control.newest(pages, "12").select(F.col("seq").alias("page_id"), "url")


@query("""WITH i AS (SELECT l_orderkey AS session_id, max(l_shipdate) AS newest_input FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS session_id, min(o_orderdate) + INTERVAL 60 DAY AS oldest_output FROM orders GROUP BY 1)
SELECT i.session_id, newest_input, oldest_output FROM i JOIN o USING (session_id) WHERE newest_input > oldest_output""")
def mtime_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    inputs = D.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("mtime"))
    outputs = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("mtime"))
    return control.stale_outputs(inputs, outputs)


GPU_SQL = "records AS (SELECT c_nationkey AS vendor, c_mktsegment AS name, c_custkey AS prio, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS vram, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS driver FROM customer)"


@query(f"WITH {GPU_SQL} SELECT vendor, name, arg_min(vram, prio) FILTER (vram IS NOT NULL) AS vram, arg_min(driver, prio) FILTER (driver IS NOT NULL) AS driver FROM records GROUP BY vendor, name")
def gpu_merge(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    records = D.read(spark, sf, "customer").select(F.col("c_nationkey").alias("vendor"), F.col("c_mktsegment").alias("name"), key.alias("prio"), F.when(key % 3 != 0, F.col("c_acctbal")).alias("vram"), F.when(key % 4 != 0, F.col("c_name")).alias("driver"))
    return control.merge_records(records, ["vendor", "name"])


@query(f"""WITH {D.SEG_SQL}, files AS (SELECT session_id, seg_idx, length(text) * 500 AS bytes, session_id || '/' || seg_idx AS path FROM seg WHERE length(text) * 500 >= 38400),
first AS (SELECT session_id, arg_min(path, seg_idx) AS path FROM files GROUP BY session_id)
SELECT s.session_id, s.seg_idx, coalesce(f.path, o.path) AS reference FROM seg s LEFT JOIN files f USING (session_id, seg_idx) LEFT JOIN first o ON o.session_id = s.session_id""")
def ref_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.seg(spark, sf)
    files = rows.select("session_id", "seg_idx", (F.length("text") * 500).alias("bytes"), F.concat_ws("/", "session_id", "seg_idx").alias("path"))
    return control.with_fallback(rows.select("session_id", "seg_idx"), files)


@query("SELECT n_name AS source, r_name AS params FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey")
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = D.read(spark, sf, "nation"), D.read(spark, sf, "region")
    done = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("params"))
    return control.grid(nation.select(F.col("n_name").alias("source")), region.select(F.col("r_name").alias("params")), done)


@query("""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '(^|\\.)example\\.com$') AS is_site,
CASE WHEN page_id % 3 = 0 THEN lpad(CAST(page_id AS VARCHAR), 11, 'x') WHEN page_id % 3 = 1 THEN 'BV' || lpad(CAST(page_id AS VARCHAR), 10, '1') END AS video_id FROM pages""")
def video_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    watch = F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), F.lpad(key, 11, "x"))
    bv = F.concat(F.lit("https://www.bilibili.com/video/BV"), F.lpad(key, 10, "1"), F.lit("?p=1"))
    url = F.when(F.col("page_id") % 3 == 0, watch).when(F.col("page_id") % 3 == 1, bv).otherwise(F.col("url"))
    return D.read(spark, sf, "pages").select("page_id", C.host(F.col("url")).alias("host"), C.is_site(F.col("url"), "example.com").alias("is_site"), C.video_id(url).alias("video_id"))


@query(r"SELECT page_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(url, '[^0-9A-Za-z_一-鿿.-]', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 120), ''), 'untitled') AS name FROM pages")
def sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "pages").select("page_id", C.sanitize(F.col("url"), "untitled").alias("name"))


SCORE_EXTRA = "师父，{一百20个}「好」～~\u3000[完]"


@query(rf"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(replace('师父，' || text || '{SCORE_EXTRA}', '师父', '师傅'), '[\s\x{{00A0}}\x{{3000}}\x{{FEFF}}]+', '', 'g'), '[。，！？、；：“”"''「」【】《》（）.,!?;:()\[\]{{}}‘’…—～~-]', '', 'g'), '[0-9零一二两三四五六七八九十百千万亿]+', '#', 'g') AS text FROM benchmark""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "benchmark").select("item_id", C.normalize_for_score(F.concat(F.lit("师父，"), "text", F.lit(SCORE_EXTRA))).alias("text"))


@query(f"WITH {D.SEG_SQL} SELECT session_id, seg_idx, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start_fmt, CASE WHEN end_ms < 1000 THEN end_ms || 'ms' WHEN end_ms < 60000 THEN (end_ms // 1000) || 's' ELSE (end_ms // 60000) || 'm' || (end_ms // 1000 % 60) || 's' END AS end_short FROM seg")
def srt_time(spark: SparkSession, sf: str) -> DataFrame:
    return D.seg(spark, sf).select("session_id", "seg_idx", C.srt_time(F.col("start_ms")).alias("start_fmt"), C.short_duration(F.col("end_ms")).alias("end_short"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts (ref) and documents (hyp) of one number."""
    docs = D.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("hyp"))
    return D.read(spark, sf, "benchmark").join(docs, F.col("item_id") == F.col("doc_id")).select("item_id", F.coalesce("text", F.lit("")).alias("ref"), "hyp")


@query()
def cer_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance over whole texts; DuckDB's counts bytes and takes too long on them, so a test has brute force."""
    ref, hyp = F.col("ref"), F.col("hyp")
    return _pairs(spark, sf).select("item_id", C.char_error_rate(ref, hyp).alias("cer"), C.char_error_rate(ref, hyp, True).alias("cer_longest"))


@query("""WITH i AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS ref FROM benchmark), p AS (SELECT a.item_id, a.ref, b.ref AS hyp FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, levenshtein(ref, hyp) / CAST(greatest(length(ref), 1) AS DOUBLE) AS cer, levenshtein(ref, hyp) / CAST(greatest(length(ref), length(hyp), 1) AS DOUBLE) AS cer_longest FROM p""")
def cer_ascii(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item against the next, in whole, the characters that both engines count alike."""
    items = D.read(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("ref"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("hyp"))
    ref, hyp = F.col("ref"), F.col("hyp")
    return items.join(after, "item_id").select("item_id", C.char_error_rate(ref, hyp).alias("cer"), C.char_error_rate(ref, hyp, True).alias("cer_longest"))


@query()
def wer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return folds.error_counts(_pairs(spark, sf))


@query("""WITH r AS (SELECT p_brand AS engine, count(*) AS n, sum(p_retailprice) AS total_s, sum(p_retailprice) / sum(CAST(p_size AS DOUBLE)) AS rtf FROM part GROUP BY p_brand) SELECT *, (SELECT arg_min(total_s, engine) FROM r) / total_s AS speed_up FROM r""")
def rtf_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "part").select(F.col("p_brand").alias("engine"), F.col("p_retailprice").alias("total_time_s"), F.col("p_size").cast("double").alias("output_duration_s"))
    return metrics.real_time_factors(rows, ["engine"])


@query("WITH c AS (SELECT event_type AS status, count(*) AS n, avg(value) AS mean_s FROM events GROUP BY 1) SELECT *, 100 * CAST(n AS DOUBLE) / (SELECT count(*) FROM events) AS percent FROM c")
def trial_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcomes(D.read(spark, sf, "events").select(F.col("event_type").alias("status"), F.col("value").alias("seconds")))


@query(f"""WITH {D.HYP_SQL}, near AS (SELECT g.session_id, g.seg_idx, h.text AS orig, abs(g.start_ms - h.start_ms) AS dist FROM seg g JOIN hyp h ON g.session_id = h.session_id AND abs(g.start_ms - h.start_ms) <= 4000
QUALIFY row_number() OVER (PARTITION BY g.session_id, g.seg_idx ORDER BY abs(g.start_ms - h.start_ms), h.seg_idx) = 1),
m AS (SELECT s.session_id, s.text AS truth, n.orig, CASE WHEN s.seg_idx % 2 = 0 THEN s.text ELSE n.orig END AS fixed, n.dist FROM seg s LEFT JOIN near n USING (session_id, seg_idx))
SELECT session_id, count(*) FILTER (orig = truth) AS exact_orig, count(*) FILTER (fixed = truth) AS exact_fixed, count(*) FILTER (orig <> truth AND fixed = truth) AS fixed_correct, count(*) FILTER (orig = truth AND coalesce(fixed <> truth, true)) AS fixed_wrong,
count(*) FILTER (orig <> truth AND coalesce(fixed <> truth, true)) AS same_wrong, count(*) FILTER (orig IS NULL) AS unmatched, avg(dist) AS avg_dist FROM m GROUP BY session_id""")
def alignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    near = intervals.nearest_start(D.seg(spark, sf), D.hyp(spark, sf))
    fixed = F.when(F.col("seg_idx") % 2 == 0, F.col("text")).otherwise(F.col("near_text"))
    return metrics.alignment_counts(near.select("session_id", F.col("text").alias("truth"), F.col("near_text").alias("orig"), fixed.alias("fixed"), "dist"))
