"""Queries over sources, sinks and scalar functions: rows of the tables in the layouts of tools and files, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import control
from ..sources import named_files as N
from ..sources import transcripts as T
from . import datasets as D
from . import stages
from .shared import scratch_path as _scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEG = f"WITH {D.SEG_SQL} "


@query(SEG + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seg_idx) - 1 AS seg_idx, trim(text) AS text, start_ms, end_ms FROM seg")
def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Segments written as documents of JSON, one each session, and read as segments again."""
    path = _scratch(spark)
    T.write_documents(D.seg(spark, sf), path)
    schema = "session_id BIGINT, result STRUCT<text:STRING,segments:ARRAY<STRUCT<text:STRING,start:DOUBLE,`end`:DOUBLE>>>, transcription ARRAY<STRUCT<text:STRING,offsets:STRUCT<`from`:BIGINT,`to`:BIGINT>>>"
    read = T.segments_of(spark.read.schema(schema).json(path), session="session_id")
    return read.select("session_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", "start_ms", "end_ms")


@query(SEG + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seg_idx) - 1 AS seg_idx, trim(text) AS text, start_ms, end_ms FROM seg")
def raw_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """The other layout, of a recogniser's raw output."""
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "text")))
    raw = F.transform(rows, lambda s: F.struct(s["text"].alias("text"), F.struct(s["start_ms"].alias("from"), s["end_ms"].alias("to")).alias("offsets")))
    docs = D.seg(spark, sf).groupBy("session_id").agg(raw.alias("transcription"))
    none = F.lit(None).cast("struct<text:string,segments:array<struct<text:string,start:double,`end`:double>>>")
    read = T.segments_of(docs.withColumn("result", none), session="session_id")
    return read.select("session_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", "start_ms", "end_ms")


STAMP = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


#: Stands for a line break in formats of one line a text.
BREAK = "\u240a"


@query(SEG + "SELECT trim(text) AS text, start_ms, end_ms FROM seg")
def log_segments(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda c: F.replace(C.srt_time(F.col(c)), F.lit(","), F.lit("."))
    rows = D.seg(spark, sf)
    lines = rows.select(F.concat(F.lit("["), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("]   "), F.translate("text", "\n", BREAK)).alias("value"))
    return T.parse_log(lines.union(rows.select(F.lit("whisper: no segment")))).withColumn("text", F.translate("text", BREAK, "\n"))


@query("SELECT p_partkey AS run, p_retailprice AS total_ms FROM part WHERE p_size % 2 = 0")
def timing_lines(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    line = F.when(even, F.concat(F.lit("print_timings:    total time = "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" ms"))).otherwise("print_timings: load")
    rows = D.read(spark, sf, "part").select(F.col("p_partkey").alias("run"), T.timing_ms(line, "total time").alias("total_ms"))
    return rows.where("total_ms IS NOT NULL")


@query("SELECT o_custkey AS run_id, coalesce(min_by(substring(line, 9), o_orderkey) FILTER (line LIKE 'OUTPUT: %'), string_agg(line, chr(10) ORDER BY o_orderkey)) AS output FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'OUTPUT: ' ELSE '' END || o_orderpriority AS line FROM orders) GROUP BY 1")
def marked_outputs(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "OUTPUT: ").otherwise(""), "o_orderpriority")
    return T.marked_output(D.read(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("line_no"), line.alias("value")), "OUTPUT: ")


@query("SELECT p_name AS name, p_brand AS driver, p_size / 1024 AS memory_gb, CASE WHEN p_size > 25 THEN 25 / CAST(p_size AS DOUBLE) * 100 ELSE 100.0 END AS used_percent, CAST(p_partkey % 100 AS DOUBLE) AS utilisation FROM part WHERE p_partkey % 7 <> 0")
def gpu_table(spark: SparkSession, sf: str) -> DataFrame:
    p = D.read(spark, sf, "part")
    text = lambda c: F.col(c).cast("string")
    whole = F.concat_ws(", ", "p_name", "p_brand", text("p_size"), F.least("p_size", F.lit(25)).cast("string"), (F.col("p_partkey") % 100).cast("string"))
    rows = T.gpu_rows(p.select(F.when(F.col("p_partkey") % 7 == 0, F.concat_ws(", ", "p_name", "p_brand")).otherwise(whole).alias("value")))
    return rows


@query("SELECT CAST(p_partkey AS INTEGER) AS gpu, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_size + CAST(0.5 AS DOUBLE) END AS temperature, p_size % 100 AS memory_percent, CAST(p_partkey % 100 AS INTEGER) AS gpu_percent FROM part")
def monitor_table(spark: SparkSession, sf: str) -> DataFrame:
    p = D.read(spark, sf, "part")
    heat = F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5°C")))
    line = F.concat_ws("  ", F.col("p_partkey").cast("string"), F.lit("0x744c"), heat, F.lit("12.0W 40%"), F.concat((F.col("p_size") % 100).cast("string"), F.lit("%")), F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("%")))
    return T.monitor_rows(p.select(line.alias("value")).union(p.select(F.lit("=== header ===")).limit(1)))


@query("SELECT p_name AS name, CASE p_size % 4 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'amd' WHEN 2 THEN 'intel' ELSE 'unknown' END AS vendor, p_size + 1.0 AS local_gb, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 2 AS DOUBLE) ELSE 0.0 END AS shared_gb, CASE WHEN p_size % 2 = 0 THEN 'shared' ELSE 'dedicated' END AS memory FROM part")
def device_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the outputs JSON, half text."""
    p, gb, size = D.read(spark, sf, "part"), 1 << 30, F.col("p_size").cast("bigint")
    ids = F.element_at(F.array(*[F.lit(x) for x in (0x10DE, 0x1002, 0x8086, 0x9999)]), (F.col("p_size") % 4 + 1).cast("int")).cast("bigint")
    heaps = F.array(F.struct((size + 1) * gb, F.lit(True)), F.struct(F.when(F.col("p_size") % 2 == 0, (size + 2) * gb).otherwise(0), F.lit(False))).cast("array<struct<size:bigint,local:boolean>>")
    as_json = F.to_json(F.struct(F.col("p_name").alias("deviceName"), ids.alias("vendorID"), heaps.alias("heaps")))
    listed = F.transform(heaps, lambda h, i: F.concat(F.lit("memoryHeaps["), i.cast("string"), F.lit("]:\n size = "), h["size"].cast("string"), F.when(h["local"], "\n MEMORY_HEAP_DEVICE_LOCAL_BIT\n").otherwise("\n None\n")))
    as_text = F.concat(F.lit("VkPhysicalDeviceProperties:\n vendorID = 0x"), F.lower(F.hex(ids)), F.lit("\n deviceName = "), "p_name", F.lit("\n"), F.array_join(listed, ""))
    return T.devices(p.select(F.when(F.col("p_partkey") % 2 == 0, as_json).otherwise(as_text).alias("value")))


@query("SELECT DISTINCT trim(unnest(string_split(p_name, ' '))) AS family FROM part WHERE p_name <> ''")
def font_list(spark: SparkSession, sf: str) -> DataFrame:
    return T.font_families(D.read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("value")))


@query("WITH f AS (SELECT DISTINCT n_name AS family FROM nation), c AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' X' END AS family FROM nation) SELECT c.family, f.family IS NOT NULL AS available, CASE WHEN f.family IS NULL THEN (SELECT min(family) FROM f) END AS suggestion FROM c LEFT JOIN f USING (family)")
def font_check(spark: SparkSession, sf: str) -> DataFrame:
    nation = D.read(spark, sf, "nation")
    wanted = nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" X"))).alias("family")).distinct()
    return T.font_report(wanted, T.font_families(nation.select(F.col("n_name").alias("value"))))


@query("SELECT 's' || n_nationkey || CASE WHEN n_nationkey % 3 = 2 THEN '.json' ELSE '' END AS path, 's' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '/metadata/asr.json' WHEN 1 THEN '/asr.json' ELSE '.json' END AS file FROM nation")
def transcript_paths(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    base = D.read(spark, sf, "nation").select(F.concat(F.lit("s"), key.cast("string")).alias("base"), (key % 3).alias("kind"))
    name = lambda end: F.concat("base", F.lit(end))
    wanted = base.select(F.when(F.col("kind") == 2, name(".json")).otherwise(F.col("base")).alias("path"))
    both = base.where("kind = 0").select(name("/asr.json").alias("path"))
    listed = base.select(F.when(F.col("kind") == 0, name("/metadata/asr.json")).when(F.col("kind") == 1, name("/asr.json")).otherwise(name(".json")).alias("path")).union(both)
    return T.resolved_paths(wanted, listed)


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 0")
def required_files(spark: SparkSession, sf: str) -> DataFrame:
    names = D.read(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return T.missing_files(names.select("name"), names.where("n_regionkey <> 0").select("name"))


@query("SELECT CAST(p_partkey AS INTEGER) AS token, replace(p_name, ' ', '▁') AS piece FROM part")
def vocabulary_file(spark: SparkSession, sf: str) -> DataFrame:
    """A piece and its token a line, in as many files as there are partitions."""
    path, piece = _scratch(spark), F.replace("p_name", F.lit(" "), F.lit("▁"))
    D.read(spark, sf, "part").select(F.concat_ws(" ", piece, F.col("p_partkey").cast("string")).alias("value")).write.text(path)
    return T.vocabulary_lines(spark, path)


@query("SELECT p_brand AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS token, p_name AS piece FROM part")
def vocabulary_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary for each brand, as a JSON array of its pieces in order in a file of its own."""
    path = _scratch(spark)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    lists = D.read(spark, sf, "part").groupBy("p_brand").agg(F.to_json(pieces).alias("value"))
    N.write_named_files(lists.select(F.concat("p_brand", F.lit(".json")).alias("name"), "value"), path)
    return T.vocabulary(spark, path).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), "token", "piece").withColumn("name", F.url_decode("name"))


@query(SEG + f"SELECT session_id, string_agg(k || chr(10) || {STAMP.format('start_ms').replace('.%03d', ',%03d')} || ' --> ' || {STAMP.format('end_ms').replace('.%03d', ',%03d')} || chr(10) || text || chr(10), chr(10) ORDER BY k) AS value FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, seg_idx) AS k FROM seg) GROUP BY session_id")
def subtitle_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.subtitle_files(D.seg(spark, sf).withColumn("part", F.lit(0)))


@query(SEG + "SELECT 'file ''' || session_id || '/' || lpad(CAST(seg_idx AS VARCHAR), CAST(greatest(4, length(CAST(seg_idx AS VARCHAR))) AS INTEGER), '0') || '.wav''' AS value FROM seg")
def concat_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.col("session_id").cast("string"), F.lit("/"), C.ordinal(F.col("seg_idx")), F.lit(".wav"))
    return T.concat_manifest(D.seg(spark, sf).select("session_id", "seg_idx", path.alias("path")))


@query("SELECT rpad(n_name, CAST(greatest(12, length(n_name)) AS INTEGER), ' ') || ' ' || lpad(CAST(n_nationkey AS VARCHAR), 6, ' ') AS value FROM nation UNION ALL SELECT rpad(n_name, CAST(greatest(12, length(n_name)) AS INTEGER), ' ') || ' ' || lpad(CAST(n_nationkey AS VARCHAR), 6, ' ') FROM nation")
def appended_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report in fixed columns, added twice to one log, and the log."""
    from ..operators.metrics import fixed_width

    path = _scratch(spark)
    lines = fixed_width(D.read(spark, sf, "nation"), {"n_name": 12, "n_nationkey": 6})
    T.append_log(lines, path)
    T.append_log(lines, path)
    return spark.read.text(path)


@query("SELECT n_nationkey AS engine, n_regionkey AS total FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 2 = 1")
def saved_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results that replace others, then results that are added."""
    path = _scratch(spark)
    rows = D.read(spark, sf, "nation").select(F.col("n_nationkey").alias("engine"), F.col("n_regionkey").alias("total"))
    T.save_results(rows, path)
    T.save_results(rows.where("engine % 2 = 0"), path)
    T.save_results(rows.where("engine % 2 = 1"), path, append=True)
    return spark.read.schema(rows.schema).json(path)


@query("""WITH o AS (SELECT json_object('key', o_orderkey, 'priority', o_orderpriority) AS j FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT json_object('key', o_orderkey, 'price', o_totalprice, 'clerk', json_object('id', o_custkey)) FROM orders WHERE o_orderkey % 2 = 1),
k AS (SELECT j, unnest(json_keys(j)) AS name FROM o) SELECT name, count(*) AS n, CASE WHEN name IN ('key') THEN 'integer' WHEN name = 'price' THEN 'number' WHEN name = 'clerk' THEN 'object' ELSE 'string' END AS type, count(*) = (SELECT count(*) FROM orders) AS required FROM k GROUP BY name""")
def schema_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON Schema's properties that documents of two kinds really have."""
    key, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    one = F.to_json(F.struct(key.alias("key"), F.col("o_orderpriority").alias("priority")))
    two = F.to_json(F.struct(key.alias("key"), F.col("o_totalprice").alias("price"), F.struct(F.col("o_custkey").alias("id")).alias("clerk")))
    return T.schema_properties(D.read(spark, sf, "orders").select(F.when(even, one).otherwise(two).alias("value")))


@query("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN 'subtitle' ELSE 'dub' END AS pipeline, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS title FROM customer")
def session_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions' information written as JSON, read with its default, and patched."""
    path, key = _scratch(spark), F.col("c_custkey")
    rows = D.read(spark, sf, "customer").select(key.alias("session_id"), F.when(key % 2 == 0, "subtitle").alias("pipeline"), F.col("c_name").alias("title"))
    rows.write.json(path)
    stored = spark.read.schema(rows.schema).json(path).withColumn("pipeline", F.coalesce("pipeline", F.lit("dub")))
    return T.patched(stored, rows.where("session_id % 3 = 0").select("session_id", F.upper("title").alias("title")), "session_id")


@query("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'vulkan' END AS runtime, 'pytorch' AS tts, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'http://env' END AS base FROM customer")
def settled_config(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    config = D.read(spark, sf, "customer").select(key.alias("session_id"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("asr_runtime"), F.when(key % 3 == 0, F.col("c_name")).alias("translate_base"))
    settled = control.settled(config, {"translate_base": "http://env"}, {"asr_runtime": "vulkan", "tts_runtime": "pytorch", "translate_base": "http://default"})
    snap = control.snapshot(settled, {"asr": ["runtime"], "tts": ["runtime"], "translate": ["base"]})
    return snap.select("session_id", F.col("last_run.asr.runtime").alias("runtime"), F.col("last_run.tts.runtime").alias("tts"), F.col("last_run.translate.base").alias("base"))


TOKENS_SQL = SEG.rstrip() + ", t AS (SELECT session_id, seg_idx, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS w FROM seg)"


@query(TOKENS_SQL + " SELECT session_id, seg_idx, trim(w) AS word, CAST(CASE WHEN k % 4 = 1 THEN 0 ELSE 100 * k END AS BIGINT) AS start, CAST(100 * k + 80 AS BIGINT) AS \"end\", (k % 10) / CAST(10 AS DOUBLE) AS probability FROM t WHERE k % 5 <> 2 AND k % 7 <> 3 AND trim(w) <> '' AND NOT starts_with(trim(w), '[')")
def token_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of tokens: some without a place, some marked as special."""
    number = lambda i: (i + 1).cast("bigint")

    def token(w, i):
        at = F.struct(F.when(number(i) % 4 != 1, number(i) * 100).alias("from"), (number(i) * 100 + 80).alias("to"))
        return F.struct(F.concat(F.when(number(i) % 7 == 3, "[_").otherwise(" "), w).alias("text"), F.when(number(i) % 5 != 2, at).alias("offsets"), (number(i) % 10 / F.lit(10.0)).alias("p"))

    rows = D.seg(spark, sf).select("session_id", "seg_idx", F.explode(T.words_of(F.transform(F.split("text", " ", -1), token))).alias("w"))
    return rows.select("session_id", "seg_idx", "w.*")


@query(SEG + "SELECT session_id, seg_idx, speaker AS word, start_ms / CAST(1000 AS DOUBLE) AS start FROM seg")
def renamed_words(spark: SparkSession, sf: str) -> DataFrame:
    word = F.struct(F.col("speaker").alias("word"), F.lit(None).cast("string").alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.lit(0.5).alias("probability"))
    rows = T.renamed_words(D.seg(spark, sf).select("session_id", "seg_idx", F.array(word).alias("words")))
    return rows.select("session_id", "seg_idx", F.col("words")[0]["text"].alias("word"), F.col("words")[0]["start"].alias("start"))


@query(SEG + """SELECT session_id, seg_idx, text AS src, CASE WHEN seg_idx % 3 = 0 THEN text WHEN seg_idx % 3 = 1 THEN text ELSE 'a，b' END AS dst, 'en' AS src_lang, 'fr' AS dst_lang, start_ms AS start_time, end_ms AS end_time, '1' AS speaker FROM seg""")
def translation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Translations: an empty one, one that is still in the source's script, and one with a dash."""
    third = F.col("seg_idx") % 3
    dst = F.when(third == 0, "").when(third == 1, "译文还是中文").otherwise("a——b")
    return stages.translation(D.seg(spark, sf).withColumn("d", dst), "d", "en", "fr")


@query(SEG + "SELECT session_id, seg_idx, trim(text) AS src, trim(text) AS dst, CAST(floor(start_ms / CAST(7 AS DOUBLE) + 0.5) AS BIGINT) AS start_time, CAST(floor(end_ms / CAST(7 AS DOUBLE) + 0.5) AS BIGINT) AS end_time FROM seg WHERE trim(text) <> ''")
def untranslated_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.seg(spark, sf).withColumns({"start_ms": F.col("start_ms") / 7, "end_ms": F.col("end_ms") / 7})
    return stages.untranslated(rows)


@query("SELECT page_id, coalesce(nullif(substring(trim(url), 1, 20), ''), '(unknown)') AS title, coalesce(nullif(substring(trim(html), 1, 500), ''), '(none)') AS description, CASE WHEN page_id % 2 = 0 THEN '(unknown)' ELSE substring(trim(url), 1, 200) END AS uploader FROM pages")
def cut_metadata(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.read(spark, sf, "pages")
    uploader = F.when(F.col("page_id") % 2 == 0, "  ").otherwise(F.col("url"))
    return pages.select("page_id", C.cut_or(F.col("url"), 20, "(unknown)").alias("title"), C.cut_or(F.col("html"), 500, "(none)").alias("description"), C.cut_or(uploader, 200, "(unknown)").alias("uploader"))


@query(SEG + "SELECT session_id, string_agg(seg_idx || ' -> ' || text, chr(10) ORDER BY seg_idx) AS lines FROM seg GROUP BY session_id")
def paired_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", F.col("seg_idx").cast("string").alias("src"), F.col("text").alias("dst"))))
    return D.seg(spark, sf).groupBy("session_id").agg(C.pair_lines(rows).alias("lines"))


@query("SELECT p_partkey, p_name AS device, p_brand AS label, 'sc_t' || p_size || '_r' || p_partkey AS params FROM part")
def labels_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    p = D.read(spark, sf, "part")
    path = F.concat(F.lit("/runs/results-ggml-"), F.col("p_brand"), F.lit("/"))
    return p.select("p_partkey", C.device_name(F.concat("p_name", F.lit(" (RADV PHOENIX)"))).alias("device"), C.run_label(path).alias("label"), C.parameter_label("sc", {"t": F.col("p_size"), "r": F.col("p_partkey")}).alias("params"))


@query("""SELECT p_partkey, pow(CAST(10 AS DOUBLE), p_size / CAST(20 AS DOUBLE)) AS linear, least(greatest(p_size, 10), 40) AS clamped, CAST(least(99, greatest(0, floor((p_size % 3 * 2 + p_size % 2 + 0.5) / CAST(6 AS DOUBLE) * 100))) AS INTEGER) AS progress,
CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE printf('%.1f GB', CAST(p_size AS DOUBLE)) END AS memory, (p_retailprice - p_size) / CAST(greatest(p_retailprice, 0.0001) AS DOUBLE) * 100 AS improvement,
CASE WHEN p_size % 7 = 0 THEN 0 ELSE length(p_name) END AS name_length, len(string_split(p_name, ' ')) AS words, contains(p_name, p_type) AND p_name <> p_type AND p_type <> '' OR contains(p_type, p_name) AND p_name <> p_type AND p_name <> '' AS is_part,
CASE WHEN p_size % 2 = 0 THEN p_name END AS lenient, p_size < 30 AND p_size + 5 > 20 AS overlaps, CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0.0 END AS cjk, p_brand AS piece, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS BIGINT) * 1000 ELSE 0 END AS waited FROM part""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    answer = F.concat(F.lit("so: "), F.to_json(F.struct(name.alias("a"))), F.when(size % 2 == 0, " ok").otherwise("}} no {"))
    lenient = F.get_json_object(C.lenient_json(answer), "$.a")
    begin, end = F.lit("2024-05-01T10:00:00"), F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-05-01 10:00:00")) + F.when(size % 4 == 0, size).otherwise(-size)), "yyyy-MM-dd'T'HH:mm:ss")
    return D.read(spark, sf, "part").select(
        "p_partkey", C.db_to_linear(size.cast("double")).alias("linear"), C.clamp(size, F.lit(10), F.lit(40)).alias("clamped"), C.separation_progress(size % 3, size % 2, F.lit(0.5), 3, 2).alias("progress"),
        C.gigabytes(F.when(size % 5 != 0, size.cast("bigint") * (1 << 30))).alias("memory"), C.improvement(F.col("p_retailprice"), size).alias("improvement"), C.safe_size(F.when(size % 7 != 0, name)).alias("name_length"),
        C.safe_size(F.split(name, " "), True).cast("bigint").alias("words"), C.is_part_of(name, kind).alias("is_part"), F.when(size % 2 == 0, lenient).alias("lenient"), C.spans_overlap(size, size + 5, F.lit(20), F.lit(30)).alias("overlaps"),
        C.cjk_ratio(F.when(size % 3 == 0, "字a").otherwise("ab")).alias("cjk"), C.decode_piece(F.base64(F.col("p_brand").cast("binary"))).alias("piece"), C.ms_between(begin, end).alias("waited"),
    )


@query(SEG + "SELECT session_id, CAST(floor(seg_idx / CAST(4 AS DOUBLE)) AS BIGINT) AS batch, count(*) AS n, min(trim(text)) AS least FROM seg WHERE trim(text) <> '' GROUP BY ALL")
def answered_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines of a batch, parsed again."""
    rows = D.seg(spark, sf).where(F.trim("text") != "").withColumn("text", F.translate("text", "\n", BREAK))
    listed = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    asked = rows.groupBy("session_id", F.floor(F.col("seg_idx") / 4).alias("batch")).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["seg_idx"].cast("string"), F.lit(") "), x["text"])), "\n").alias("answer"), F.count("*").cast("int").alias("n"))
    texts = asked.withColumn("texts", C.numbered_lines(F.col("answer"), F.col("n")))
    return texts.select("session_id", "batch", F.size("texts").cast("bigint").alias("n"), F.array_min(F.transform("texts", lambda t: F.translate(t, BREAK, "\n"))).alias("least"))


@query(SEG + "SELECT session_id, seg_idx, text, start_ms, end_ms FROM seg WHERE seg_idx % 2 = 0 UNION ALL SELECT session_id, seg_idx, text, start_ms, end_ms FROM seg WHERE seg_idx % 3 = 0")
def range_union(spark: SparkSession, sf: str) -> DataFrame:
    """Several files of ranges, which overlap, as one table."""
    path, rows = _scratch(spark), D.seg(spark, sf).select("session_id", "seg_idx", "text", "start_ms", "end_ms")
    rows.where("seg_idx % 2 = 0").write.parquet(f"{path}/a")
    rows.where("seg_idx % 3 = 0").write.parquet(f"{path}/b")
    return spark.read.schema(rows.schema).parquet(f"{path}/a", f"{path}/b")


@query("SELECT user_id AS session_id, json_extract_string(props, '$.k') AS page, count(*) AS n FROM events GROUP BY ALL")
def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    page = F.get_json_object("props", "$.k")
    return D.read(spark, sf, "events").groupBy(F.col("user_id").alias("session_id"), page.alias("page")).agg(F.count("*").alias("n"))
