"""Site-relative line dedup: lines that stand on too many pages of their host are boilerplate and go.

A line's frequency is the number of the host's pages that contain it, divided by the host's pages. A line that is on
two pages at least and on more than RATIO of the host's goes from all of them. Lines are compared without the white
space at their ends, by two 64-bit hashes; blank lines always stay.

Defined cases: rows with a null host are one host; a null text has no lines and stays null; a line that a page
repeats counts once for that page; repeated rows are pages of their own; empty tables give no rows; other columns
pass through whatever their names, and ``drop_boilerplate`` replaces a column named ``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, own_columns, quoted, read

RATIO, MIN_PAGES = 0.05, 2
#: Hosts whose boilerplate is broadcast, and the lines of them all, 32 bytes each at most.
BROADCAST_HOSTS, BROADCAST_LINES = 50_000, 1_000_000


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without ``www.`` and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?(?:[wW]{3}\.)?([^/:?#]+)", 1))


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: the keys of the host's lines that are on ``min_pages`` pages at least and over ``ratio`` of them all."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), _key))
    listed = pages.select(F.col(host).alias("host"), F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.coalesce(F.filter(keys, lambda x: x.isNotNull()), F.array()))).alias("line"))
    counts = listed.groupBy("host", "line").count()  # the null line counts the host's pages
    per_host = counts.where("line IS NULL").select(F.col("host").alias("h"), F.col("count").alias("pages"))
    often = counts.where(F.col("line").isNotNull() & (F.col("count") >= min_pages))
    return often.join(per_host, F.col("host").eqNullSafe(F.col("h"))).where(F.col("count") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with cleaned texts and ``n_dropped``, the lines that went."""
    whole = pages.drop("n_dropped")
    cleaned = _cleaned(whole.select(own_columns(whole), quoted(host).alias("host"), "text"), ratio, min_pages)
    named = [F.col("good").alias(c) if c == "text" else F.col("__own")[c].alias(c) for c in whole.columns]
    return cleaned.select(*named, F.col("dropped").alias("n_dropped"))


def _cleaned(parts: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """__own, text, good (the text without boilerplate), dropped, for ``parts`` with __own, host and text."""
    found = checkpoint(boilerplate(parts, "host", ratio, min_pages)).select(F.col("host").alias("of_host"), F.col("lines").alias("bad"))
    hosts, n_lines = found.agg(F.count("*"), F.sum(F.size("bad"))).first()
    few = hosts <= BROADCAST_HOSTS and (n_lines or 0) <= BROADCAST_LINES
    # beyond the bound it is a shuffle join, whose large hosts adaptive execution splits
    joined = parts.join(F.broadcast(found) if few else found.hint("shuffle_merge"), F.col("host").eqNullSafe(F.col("of_host")), "left")
    lines = F.split("text", "\n")
    kept = joined.withColumn("kept", F.when(F.col("bad").isNotNull(), F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("bad"), _key(x)), F.lit(False)))))
    goes = F.coalesce(F.size("kept") < F.size(lines), F.lit(False))
    return kept.select(
        "__own", "text", F.when(goes, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("good"),
        F.when(goes, F.size(lines) - F.size("kept")).otherwise(0).cast("long").alias("dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents"), "source").select("doc_id", "source", "n_dropped", "text")


OP7_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
listed AS (SELECT DISTINCT doc_id, source, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM listed WHERE line <> '' GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
        WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * h.n GROUP BY c.source),
good AS (SELECT p.*, list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.bad, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), false)) AS good
         FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source),
cut AS (SELECT *, coalesce(len(good) < len(lines), false) AS goes FROM good)
SELECT doc_id, source, CASE WHEN goes THEN len(lines) - len(good) ELSE 0 END AS n_dropped,
       CASE WHEN goes THEN array_to_string(good, chr(10)) ELSE text END AS text
FROM cut
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines; n_chars, if there is one, follows the text.

    A page that would be left without any line is a copy of other pages: it keeps its text, by which the near-dedup that
    follows tells its group from others.
    """
    cleaned = _cleaned(docs.select(own_columns(docs), F.col("source").alias("host"), "text"), RATIO, MIN_PAGES)
    changed = (F.col("dropped") > 0) & (F.btrim("good", F.lit(SPACES)) != "")
    fresh = {"text": F.col("good")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("good").cast(docs.schema["n_chars"].dataType)
    own = lambda c: F.col("__own")[c]
    return cleaned.select(*[F.when(changed, fresh[c]).otherwise(own(c)).alias(c) if c in fresh else own(c).alias(c) for c in docs.columns])
