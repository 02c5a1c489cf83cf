"""Readers of transcripts, logs and tool output, and writers of documents, subtitles and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import schemas
from ..functions.columns import srt_time
from .named_files import read_files, spark_folder, write_named_files


def read_transcripts(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """One row for each JSON document below ``path``, with the label that its folder names; ``corrupt`` is the text of one that isn't JSON."""
    reader = spark.read.schema(f"{schemas.TRANSCRIPT}, corrupt STRING").option("multiLine", True).option("recursiveFileLookup", recursive).option("columnNameOfCorruptRecord", "corrupt")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    file = F.col("_metadata.file_path")
    return reader.json(path).withColumns({"path": file, "label": F.regexp_extract(file, r"/([^/]+)/(?:metadata/)?[^/]+$", 1)})


def segments_of(documents: DataFrame, scale: float = 1.0, session: str = "path") -> DataFrame:
    """Segments of either layout, in milliseconds; ``scale`` is 1000 where a document has seconds. Neither layout: an error."""
    plain = F.transform("result.segments", lambda s: F.struct(F.trim(s["text"]).alias("text"), (s["start"] * scale).alias("start"), (s["end"] * scale).alias("end")))
    raw = F.transform("transcription", lambda s: F.struct(F.trim(s["text"]).alias("text"), s["offsets"]["from"].cast("double").alias("start"), s["offsets"]["to"].cast("double").alias("end")))
    bad = F.raise_error(F.concat(F.lit("no segments in "), F.col(session))).cast("array<struct<text:string,start:double,end:double>>")
    rows = documents.select(F.col(session).alias("session_id"), F.posexplode(F.coalesce(plain, raw, bad)).alias("seg_idx", "s"))
    return rows.select("session_id", "seg_idx", F.col("s.text").alias("text"), F.floor("s.start").alias("start_ms"), F.ceil("s.end").alias("end_ms"))


def words_of(tokens: Column) -> Column:
    """Words of raw tokens: those with text and a place that are no special tokens."""
    good = F.filter(tokens, lambda t: (F.trim(t["text"]) != "") & ~F.trim(t["text"]).startswith("[") & t["offsets"].isNotNull())
    return F.transform(good, lambda t: F.struct(F.trim(t["text"]).alias("word"), F.coalesce(t["offsets"]["from"], F.lit(0)).alias("start"), F.coalesce(t["offsets"]["to"], F.lit(0)).alias("end"), t["p"].alias("probability")))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Segments of lines like ``[00:01:02.345 --> 00:01:04.000]  text``."""
    pattern = r"^\s*\[(\d+):(\d+):(\d+)[.,](\d+)\s*-->\s*(\d+):(\d+):(\d+)[.,](\d+)\]\s*(.*)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    # a fraction of two or of three digits is that of a second
    ms = lambda k: (part(k).try_cast("bigint") * 3600 + part(k + 1).try_cast("bigint") * 60 + part(k + 2).try_cast("bigint")) * 1000 + F.rpad(F.substring(part(k + 3), 1, 3), 3, "0").try_cast("bigint")
    return lines.where(F.col(column).rlike(pattern)).select(F.trim(part(9)).alias("text"), ms(1).alias("start_ms"), ms(5).alias("end_ms"))


def timing_ms(line: Column, name: str) -> Column:
    """The milliseconds that a timing line reports under ``name``; null for another line."""
    return F.nullif(F.regexp_extract(line, rf"{name}\s*=\s*([0-9.]+)\s*ms", 1), F.lit("")).cast("double")


def marked_output(lines: DataFrame, marker: str, order: str = "line_no") -> DataFrame:
    """The rest of each run's first line with ``marker``, else its whole output, else null."""
    own = F.when(F.col("value").startswith(marker), F.substring(F.col("value"), F.lit(len(marker) + 1), F.length("value")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]), "\n")
    return lines.groupBy("run_id").agg(F.coalesce(F.min_by(own, F.when(own.isNotNull(), F.col(order))), F.nullif(whole, F.lit(""))).alias("output"))


def gpu_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a GPU tool's CSV: name, memory in GB, share used; lines of fewer than five fields are skipped."""
    f = F.transform(F.split(column, ","), lambda x: F.trim(x))
    rows = lines.select(f.alias("f")).where(F.size("f") >= 5)
    number = lambda k: F.expr(f"try_cast(f[{k}] AS double)")
    used = F.when(number(2) > 0, number(3) / number(2) * 100).otherwise(0.0)
    return rows.select(F.col("f")[0].alias("name"), F.col("f")[1].alias("driver"), (number(2) / 1024).alias("memory_gb"), used.alias("used_percent"), number(4).alias("utilisation"))


def frames_of(spark: SparkSession, path: str, step: int, fps: float) -> DataFrame:
    """Image files of a folder in order of name, with the time of each."""
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    idx = F.row_number().over(W.partitionBy("session_id").orderBy("path")) - 1
    return files.withColumn("session_id", folder).withColumn("frame_idx", idx).withColumn("ts_ms", F.floor(F.col("frame_idx") * step / fps * 1000 + 0.5))


def missing_files(required: DataFrame, listed: DataFrame) -> DataFrame:
    """Required names that aren't listed."""
    return required.join(listed, "name", "left_anti")


def documents_of(segments: DataFrame) -> DataFrame:
    """One document a session: its text and its segments in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start_ms", "end_ms")))
    listed = F.transform(ordered, lambda s: F.struct(s["text"].alias("text"), s["start_ms"].alias("start"), s["end_ms"].alias("end")))
    grouped = segments.groupBy("session_id").agg(listed.alias("segments"))
    return grouped.select("session_id", F.struct(F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("text"), "segments").alias("result"))


def subtitle_files(cues: DataFrame) -> DataFrame:
    """session_id, value: each session's cues as the text of an SRT file, numbered from 1."""
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", "part", "end_ms", "text")))
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c["start_ms"]), F.lit(" --> "), srt_time(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n"))
    return cues.groupBy("session_id").agg(F.array_join(F.transform(ordered, block), "\n").alias("value"))


def concat_manifest(files: DataFrame) -> DataFrame:
    """Lines ``file '<path>'`` in order of segment."""
    return files.orderBy("session_id", "seg_idx").select(F.concat(F.lit("file '"), "path", F.lit("'")).alias("value"))


def patched(stored: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Stored rows with the columns of a patch laid over them where it has a value; nested values are replaced whole."""
    named = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    joined = stored.join(named, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c != key and c in patch.columns else F.col(c) for c in stored.columns])


def resolved_paths(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """path, file: for each wanted path the file that it names among ``listed`` (path): itself if it is JSON, else the
    transcript in its ``metadata`` folder or in itself. A path that names none is an error."""
    own = F.col("path").endswith(".json")
    names = F.when(own, F.array("path")).otherwise(F.array(F.concat("path", F.lit("/metadata/asr.json")), F.concat("path", F.lit("/asr.json"))))
    tried = wanted.select("path", F.posexplode(names).alias("prio", "file"))
    found = tried.join(listed.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct(), "file", "left")
    first = found.groupBy("path").agg(F.min_by("file", F.when(F.col("there"), F.col("prio"))).alias("file"))
    return first.select("path", F.coalesce("file", F.raise_error(F.concat(F.lit("no transcript at "), "path")).cast("string")).alias("file"))


def monitor_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a GPU monitor's fixed columns: lines that begin with a number; memory and use are the last two percentages."""
    shares = F.transform(F.regexp_extract_all(column, F.lit(r"(\d+)%"), F.lit(1)), lambda x: x.cast("int"))
    number = lambda pattern, kind: F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")).cast(kind)
    rows = lines.where(F.col(column).rlike(r"^\d+\s+")).withColumn("shares", shares)
    last = lambda k: F.when(F.size("shares") >= k, F.get("shares", F.size("shares") - k)).otherwise(0)
    return rows.select(number(r"^(\d+)", "int").alias("gpu"), F.coalesce(number(r"([\d.]+)°C", "double"), F.lit(0.0)).alias("temperature"), last(2).alias("memory_percent"), last(1).alias("gpu_percent"))


def memory_totals(lines: DataFrame, column: str = "value") -> DataFrame:
    """Gigabytes of each kind of memory that lines ``KIND Total Memory (B): n`` name."""
    kind, size = (F.regexp_extract(column, r"(\w+)\s+Total Memory \(B\):\s*(\d+)", k) for k in (1, 2))
    return lines.where(kind != "").select(kind.alias("kind"), (size.cast("double") / (1 << 30)).alias("gb"))


DEVICE = "deviceName STRING, vendorID BIGINT, heaps ARRAY<STRUCT<size:BIGINT,local:BOOLEAN>>"
# Vendors by id.
VENDORS = {0x10DE: "nvidia", 0x1002: "amd", 0x1022: "amd", 0x8086: "intel"}


def devices(outputs: DataFrame, column: str = "value") -> DataFrame:
    """Devices of a tool's outputs, each of them JSON (see DEVICE) or else text with lines ``name = value`` and heaps."""
    parsed = F.from_json(column, DEVICE)
    line = lambda name, pattern: F.nullif(F.regexp_extract(column, rf"{name}\s*=\s*({pattern})", 1), F.lit(""))
    heaps = F.transform(
        F.regexp_extract_all(column, F.lit(r"(?s)memoryHeaps\[\d+\]:.*?(?=memoryHeaps\[|$)"), F.lit(0)),
        lambda h: F.struct(F.regexp_extract(h, r"size\s*=\s*(\d+)", 1).cast("bigint").alias("size"), h.contains("MEMORY_HEAP_DEVICE_LOCAL_BIT").alias("local")),
    )
    text = F.struct(F.trim(line("deviceName", "[^\n]+")).alias("deviceName"), F.conv(F.substring(line("vendorID", "0x[0-9a-fA-F]+"), 3, 16), 16, 10).cast("bigint").alias("vendorID"), heaps.alias("heaps"))
    one = outputs.select(F.when(F.try_parse_json(column).isNotNull(), parsed).otherwise(text).alias("d")).select("d.*").where("deviceName IS NOT NULL")
    most = lambda local: F.coalesce(F.array_max(F.transform(F.filter("heaps", lambda h: h["local"] == F.lit(local)), lambda h: h["size"])) / (1 << 30), F.lit(0.0))
    vendor = F.coalesce(F.create_map(*[F.lit(x) for pair in VENDORS.items() for x in pair])[F.col("vendorID")], F.lit("unknown"))
    sized = one.select(F.col("deviceName").alias("name"), vendor.alias("vendor"), most(True).alias("local_gb"), most(False).alias("shared_gb"))
    kind = F.when((F.col("local_gb") > 0) & (F.col("shared_gb") > 0), "shared").when(F.col("local_gb") > 0, "dedicated").otherwise("unknown")
    return sized.withColumn("memory", kind)


def font_families(lines: DataFrame, column: str = "value") -> DataFrame:
    """family: the names in comma-separated lines, each once."""
    return lines.select(F.explode(F.transform(F.split(column, ","), lambda x: F.trim(x))).alias("family")).where("family <> ''").distinct()


def font_report(configured: DataFrame, families: DataFrame) -> DataFrame:
    """Configured families (family) and whether they are there, and for those that aren't the first family that is."""
    first = families.agg(F.min("family").alias("first"))  # one row
    marked = configured.join(families.select("family", F.lit(True).alias("there")).distinct(), "family", "left").join(F.broadcast(first))
    return marked.select("family", F.col("there").isNotNull().alias("available"), F.when(F.col("there").isNull(), F.col("first")).alias("suggestion"))


def vocabulary_lines(spark: SparkSession, path: str) -> DataFrame:
    """token, piece: from lines ``piece token`` of files below ``path``."""
    bare = F.trim("value")
    return spark.read.text(path).where(bare != "").select(F.element_at(F.split(bare, " "), -1).cast("int").alias("token"), F.element_at(F.split(bare, " "), 1).alias("piece"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """path, token, piece: from files with a JSON array of pieces in order, each of them one vocabulary."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "array<string>").alias("pieces"))
    return text.select("path", F.posexplode("pieces").alias("token", "piece"))


def session_info(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each session's JSON file below ``path``, with its pipeline (``dub`` where it names none).

    A folder's files are found and read by tasks, and parsed as by ``from_json``, which in a column of strings writes anew what
    is no string (1.10 becomes 1.1). Spark's reader, which lists them on the driver and keeps such values' own text, takes
    patterns, paths that Arrow doesn't find and schemas with the column of corrupt records.
    """
    kind, folder = spark.createDataFrame([], schema).schema, spark_folder(spark, path)
    if folder is None or spark.conf.get("spark.sql.columnNameOfCorruptRecord") in kind.names:
        rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("__path", F.col("_metadata.file_path"))
    else:
        files = read_files(spark, folder).where("value IS NULL OR btrim(value, ' \\t\\n\\r') <> ''")
        objects = F.from_json("value", ArrayType(kind))  # a file may hold one or many
        good = F.when(~F.exists(objects, lambda o: o.isNull()), objects)
        rows = files.select(F.explode(F.coalesce(good, F.array(F.lit(None).cast(kind)))).alias("row"), F.col("path").alias("__path")).select("row.*", "__path")
    return rows.withColumns({"pipeline": F.coalesce("pipeline", F.lit("dub")), "path": F.col("__path")}).drop("__path")


def renamed_words(segments: DataFrame) -> DataFrame:
    """Segments whose words' ``word`` is called ``text``."""
    return segments.withColumn("words", F.transform("words", lambda w: F.struct(F.coalesce(w["word"], w["text"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability"))))


def write_documents(segments: DataFrame, path: str, append: bool = False) -> None:
    """Each session's document as a line of JSON below ``path``, which is replaced unless ``append``."""
    documents_of(segments).write.mode("append" if append else "overwrite").json(path)


def write_subtitles(cues: DataFrame, path: str) -> None:
    """An SRT file for each session, by the session's name."""
    write_named_files(subtitle_files(cues).select(F.concat(F.lit("subtitles/"), F.col("session_id").cast("string"), F.lit(".srt")).alias("name"), "value"), path)


def append_log(lines: DataFrame, path: str) -> None:
    """Lines (value) added to the text files below ``path``."""
    lines.select("value").write.mode("append").text(path)


def save_results(results: DataFrame, path: str, append: bool = False) -> None:
    """Results in place of those below ``path``, or beside them."""
    results.write.mode("append" if append else "overwrite").json(path)


def json_schema(df: DataFrame) -> str:
    """The schema of a table as JSON."""
    return df.schema.json()


def schema_properties(documents: DataFrame, column: str = "value") -> DataFrame:
    """name, n, type, required: the properties of JSON documents, by what they have; of several types the most general, else a string."""
    entry = documents.select(F.parse_json(column).alias("v"))
    named = entry.select(F.explode(F.map_entries(F.from_json(F.to_json("v"), "map<string,string>"))).alias("e"), "v").select(F.col("e.key").alias("name"), F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), "e.key", F.lit("']")), "variant")).alias("kind"))
    kind = F.when(F.col("kind") == "BIGINT", 1).when(F.col("kind").startswith("DECIMAL") | F.col("kind").isin("DOUBLE", "FLOAT"), 2).when(F.col("kind") == "BOOLEAN", 3).when(F.col("kind").startswith("OBJECT"), 4).when(F.col("kind").startswith("ARRAY"), 5).otherwise(6)
    counts = named.where("kind <> 'VOID'").groupBy("name").agg(F.count("*").alias("n"), F.min(kind).alias("low"), F.max(kind).alias("high"))
    type_name = F.when((F.col("low") == F.col("high")) | (F.col("high") == 2), F.element_at(F.array(*[F.lit(x) for x in ("integer", "number", "boolean", "object", "array", "string")]), F.col("high"))).otherwise("string")
    total = documents.agg(F.count("*").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("name", "n", type_name.alias("type"), (F.col("n") == F.col("total")).alias("required"))


def result_json(lines: DataFrame) -> DataFrame:
    """session_id, value: a session's lines (text, confidence, box) and their joined text as JSON, confidences to two digits."""
    listed = F.array_sort(F.collect_list(F.struct("frame_idx", "text", F.round("confidence", 2).cast("decimal(5,2)").alias("confidence"), "box")))
    segments = F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["box"].alias("box")))
    whole = F.array_join(F.transform(listed, lambda x: x["text"]), "")
    return lines.groupBy("session_id").agg(F.to_json(F.struct(whole.alias("text"), segments.alias("segments"))).alias("value"))
