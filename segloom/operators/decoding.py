"""Outputs of recognisers to text: best paths of class scores, tokens with timestamps, tokens to characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import is_cjk, piece_text

# Where text tokens end and timestamps begin, the time of one step, and what the last segment gets.
TEXT_END, TIME_BEGIN, STEP_MS, TAIL_MS = 50_257, 50_364, 20, 500
SPACE = "▁"


def best_path(steps: Column, characters: Column) -> Column:
    """text and confidence of an array of arrays of class scores: the best class of each step (the first on ties), each run
    of one class once, class 0 (blank) left out; the confidence is the mean of the steps that stay, 0 for none."""
    best = F.transform(steps, lambda row: F.struct((F.array_position(row, F.array_max(row)) - 1).cast("int").alias("class"), F.array_max(row).alias("score")))
    found = F.get(F.transform(F.array(best), lambda b: F.filter(b, lambda x, i: (x["class"] > 0) & (x["class"] < F.size(characters)) & ~F.coalesce(F.get(b, i - 1)["class"] == x["class"], F.lit(False)))), F.lit(0))
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["score"]) / F.greatest(F.size(found), F.lit(1))
    return F.struct(F.array_join(F.transform(found, lambda x: F.get(characters, x["class"])), "").alias("text"), mean.alias("confidence"))


def timed_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Segments of token rows (session_id, pos, token): text between timestamps, the text before the first one with it.

    The last segment ends TAIL_MS after its start; without any timestamp there is one from 0 to 0. ``vocabulary`` has token
    and piece (base64); other tokens than text and timestamps are skipped, and segments without text left out.
    """
    order = W.partitionBy("session_id").orderBy("pos")
    marked = tokens.withColumn("stamp", F.col("token") >= TIME_BEGIN).withColumn("k", F.sum(F.col("stamp").cast("int")).over(order))
    stamps = marked.where("stamp").select("session_id", "k", ((F.col("token") - TIME_BEGIN) * STEP_MS).cast("bigint").alias("ms"))
    pieces = marked.where(F.col("token") < TEXT_END).join(vocabulary.where("piece <> '='"), "token")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.unbase64("piece").alias("raw"))))
    texts = pieces.groupBy("session_id", F.greatest("k", F.lit(1)).alias("k")).agg(listed.alias("rows"))
    whole = piece_text(F.aggregate("rows", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["raw"])))
    full = texts.select("session_id", "k", F.trim(whole).alias("text")).where("text <> ''")
    begins, ends = stamps.withColumnRenamed("ms", "begin"), stamps.select("session_id", (F.col("k") - 1).alias("k"), F.col("ms").alias("end"))
    placed = full.join(begins, ["session_id", "k"], "left").join(ends, ["session_id", "k"], "left")
    return placed.select("session_id", F.col("k").alias("seg_idx"), "text", F.coalesce("begin", F.lit(0)).alias("start_ms"), F.coalesce("end", F.col("begin") + TAIL_MS, F.lit(0)).alias("end_ms"))


def character_ids(vocabulary: DataFrame) -> DataFrame:
    """token, ids: for each token of two or more CJK characters the tokens of these, if the vocabulary (token, piece) has all."""
    clean = vocabulary.select("token", F.regexp_replace("piece", SPACE, "").alias("clean"))
    long = clean.where((F.length("clean") >= 2) & is_cjk(F.col("clean")))
    parts = long.select("token", F.length("clean").alias("n"), F.posexplode(F.split("clean", "")).alias("at", "character"))
    known = vocabulary.groupBy(F.col("piece").alias("character")).agg(F.min("token").alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    return parts.join(known, "character").groupBy("token").agg(F.first("n").alias("n"), ids.alias("ids")).where(F.size("ids") == F.col("n")).select("token", "ids")


def by_character(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token rows (session_id, pos, token) as one array of ids a session, CJK tokens of several characters taken apart."""
    joined = tokens.join(character_ids(vocabulary), "token", "left")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ids", F.array("token")).alias("ids")))), lambda x: x["ids"]))
    return joined.groupBy("session_id").agg(ids.alias("tokens"))
