"""Benchmark decontamination by templates: texts that hold a benchmark item, also with other numbers, names or units.

Texts become templates: words lower-cased without punctuation, numbers, names (capitalised words inside a sentence)
and units after numbers become typed placeholders. All windows of WIDTH template words, of documents and of items, are
joined by hash. A window that meets one of an item says where the item would lie in the document; there item and
document are compared word by word. A value of the item must always meet the same value of the document (slot
consistency) among the words whose templates agree. An item is in a document if runs of WIDTH or more agreeing words
cover at least half of it, MIN_LITERALS of them, or all that the item has, being no placeholders.

Windows of placeholders alone find nothing, as long as the item has others: a run is found if some window at its place
has a word. Items of fewer than WIDTH words are compared with whole lines of the documents of as many template words: a
line with the item's template, consistently filled, holds the item.

Items with one template and equal values at the same places are joined once; each of their ids is in the result.

Defined cases: null texts hold nothing, and null or blank items are nowhere; documents are told apart by id and text, so
repeated rows give one result and null ids do no harm; empty tables give no rows; other columns don't matter, and the
stage passes them on whatever their names. A text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, let, own_columns, read, small_enough, split_words, text_or_empty

WIDTH, MIN_LITERALS, MIN_COVER = 5, 3, 0.5
#: Item windows that are broadcast (their keys in the plan), bytes of the words of their items, keys of windows (8
#: bytes) that are broadcast where items are more, and keys of contaminated texts (16 bytes).
BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_KEYS, BROADCAST_TEXTS = 20_000, 64 << 20, 2_000_000, 1_000_000

# Units that count as a slot after a number.
UNITS = "mm|cm|m|km|mg|g|kg|ml|l|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|inch(?:es)?|feet|ft|yards?|miles?|pounds?|lbs?|oz|ounces?|dollars?|euros?|cents?|percent|degrees?|meters?|metres?|kilometers?|kilometres?|liters?|litres?|grams?|kilograms?"
MARK = "\x01"
NUMBER, NAME, UNIT = f"{MARK}d", f"{MARK}n", f"{MARK}u"


def with_templates(df: DataFrame) -> DataFrame:
    """Adds ``bare`` and ``template``: the text without punctuation, as it is and with placeholders; words and lines correspond."""
    names = F.regexp_replace(F.translate(text_or_empty(), MARK, " "), r"(?<=[\p{Ll}\p{N},;]\x20)(\p{Lu}\p{Ll}+)", f"{MARK}$1")
    bare = F.regexp_replace(names, rf"[^\p{{L}}\p{{M}}\p{{N}}\s{MARK}]+", "")
    template = F.regexp_replace(F.regexp_replace("bare", rf"{MARK}\p{{L}}+", NAME), r"(?<![^\s])\p{Nd}+(?![^\s])", NUMBER)
    template = F.lower(F.regexp_replace(template, rf"(?<={NUMBER}[\x20\n])(?:{UNITS})(?![^\s])", UNIT))
    return df.withColumn("bare", bare).withColumn("template", template)


def with_words(df: DataFrame) -> DataFrame:
    """Adds ``raw`` and ``slots``, arrays of the same words as they are and as a template has them."""
    return df.withColumn("raw", split_words(F.col("bare"))).withColumn("slots", split_words(F.col("template")))


def light(items: DataFrame) -> bool:
    """Whether rows with ``item_slots`` and ``item_fills`` are few and small enough to be broadcast."""
    size = F.octet_length(F.array_join("item_slots", "")) + 32 * F.size("item_slots") + 64
    rows, weight = items.agg(F.count("*"), F.sum(size.cast("bigint"))).first()
    return rows <= BROADCAST_WINDOWS and (weight or 0) <= BROADCAST_BYTES


def is_slot(word: Column) -> Column:
    return word.startswith(MARK)


def _windows() -> Column:
    """at and key of each window: words are hashed once, and a window's key is a hash of its words' hashes."""
    hashes = F.transform("slots", lambda w: F.xxhash64(w))

    def keyed(h: Column) -> Column:
        firsts = F.slice(h, 1, F.size("slots") - (WIDTH - 1))
        return F.transform(firsts, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WIDTH)]).alias("key")))

    return F.when(F.size("slots") >= WIDTH, let(hashes, keyed)).otherwise(F.array())


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct templates (item, slots, fills) and which ids have them (item, item_id).

    ``fills`` has for each word the first place of its value in the item, so it tells which places hold one value.
    """
    words = with_words(with_templates(benchmark.select("item_id", "text"))).where(F.size("slots") > 0)
    values = F.transform("slots", lambda w, i: F.when(is_slot(w), F.concat(w, F.get("raw", i))).otherwise(""))
    fills = let(values, lambda v: F.transform(v, lambda x, i: F.when(x == "", i + 1).otherwise(F.array_position(v, x)).cast("int")))
    filled = words.select("item_id", "slots", fills.alias("fills"))
    item = F.sha2(F.to_json(F.struct("slots", "fills")), 256).alias("item")
    keyed = checkpoint(filled.select("item_id", "slots", "fills", item))
    return keyed.groupBy("item").agg(F.first("slots").alias("slots"), F.first("fills").alias("fills")), keyed.select("item", "item_id").distinct()


def _literals(slots: Column) -> Column:
    return F.size(F.filter(slots, lambda x: ~is_slot(x)))


def item_windows(items: DataFrame) -> DataFrame:
    """key, item, item_at, item_slots, item_fills: a row for each window of each item that has a word, or for all if none has."""
    long = items.where(F.size("slots") >= WIDTH).withColumn("windows", _windows())
    worded = F.filter("windows", lambda w: _literals(F.slice(F.col("slots"), w["at"] + 1, WIDTH)) > 0)
    chosen = F.explode(F.when(_literals(F.col("slots")) > 0, worded).otherwise(F.col("windows"))).alias("w")
    return long.select("item", F.col("slots").alias("item_slots"), F.col("fills").alias("item_fills"), chosen).select("w.key", "item", F.col("w.at").alias("item_at"), "item_slots", "item_fills")


def text_keys() -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64("text").alias("text_a"), F.xxhash64("text", F.lit(1)).alias("text_b")]


def _agreeing(slots: Column, raw: Column, shift: Column) -> Column:
    """From the item's columns and a document's words: the places of the item whose words agree, with the values there."""
    def word(i: Column) -> Column:
        return F.when((shift + i >= 0) & (F.get(slots, shift + i) == F.get("item_slots", i)), F.get(raw, shift + i))

    pairs = F.transform("item_slots", lambda w, i: F.struct(i.alias("i"), word(i).alias("value"), is_slot(w).alias("slot")))
    return F.filter(pairs, lambda x: x["value"].isNotNull())


def _consistent(agreeing: Column) -> Column:
    """Whether one value of the item always meets one value of the document."""
    filled = F.array_distinct(F.transform(F.filter(agreeing, lambda x: x["slot"]), lambda x: F.struct(F.get("item_fills", x["i"]).alias("old"), x["value"].alias("new"))))
    return let(filled, lambda f: F.size(f) == F.size(F.array_distinct(F.transform(f, lambda x: x["old"]))))


def _covered(agreeing: Column) -> Column:
    """The places in runs of WIDTH or more, as an array."""
    places = F.transform(agreeing, lambda x: x["i"])
    starts = lambda p: F.filter(p, lambda x, k: F.get(p, k + WIDTH - 1) == x + WIDTH - 1)
    return F.array_distinct(F.flatten(F.transform(let(places, starts), lambda x: F.sequence(x, x + WIDTH - 1))))


ME = ["doc_id", "text_a", "text_b"]


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, item, places: consistent runs of an item's words in a document (doc_id, text), for each place it may lie at.

    Many windows say the same of a document, so first the places are found, each once, and then the words of the few
    documents that have any are made again and compared.
    """
    cut = checkpoint(item_windows(items))
    slots = with_templates(docs.select("doc_id", "text")).select("doc_id", *text_keys(), split_words(F.col("template")).alias("slots"))
    if light(cut):  # the keys are part of the plan
        keys = [r["key"] for r in cut.select("key").distinct().collect()]
        placed = slots.select(*ME, F.explode(F.filter(_windows(), lambda w: w["key"].isin(keys))).alias("w")).select(*ME, "w.*")
    else:  # only windows that meet an item are shuffled, as long as their keys can be broadcast
        placed = slots.select(*ME, F.explode(_windows()).alias("w")).select(*ME, "w.*")
        known = cut.select("key").distinct()
        if small_enough(known, BROADCAST_KEYS):
            placed = placed.join(F.broadcast(known), "key", "left_semi")
    places = cut.select("key", "item", "item_at")
    places = F.broadcast(places) if light(cut) else places
    found = checkpoint(placed.join(places, "key").select(*ME, "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    named = found.select(*[F.col(c).alias(f"m_{c}") for c in ME], "item", "shift")
    texts = named.select(*[f"m_{c}" for c in ME]).distinct()
    texts = F.broadcast(texts) if small_enough(texts, BROADCAST_TEXTS) else texts
    own = docs.select("doc_id", "text", *text_keys()).join(texts, _same_text(), "left_semi").dropDuplicates(ME)
    words = with_words(with_templates(own)).select(*ME, "raw", "slots")
    wanted = items.select("item", F.col("slots").alias("item_slots"), F.col("fills").alias("item_fills"))
    met = words.join(named, _same_text()).drop(*[f"m_{c}" for c in ME]).join(wanted, "item")
    agreeing = met.select(*ME, "item", F.size("item_slots").alias("n"), "item_fills", "shift", _agreeing(F.col("slots"), F.col("raw"), F.col("shift")).alias("agreeing"))
    ran = agreeing.withColumn("places", _covered(F.col("agreeing")))
    used = F.filter("agreeing", lambda x: F.array_contains("places", x["i"]))
    return ran.where((F.size("places") > 0) & _consistent(used)).select(*ME, "item", "n", "places")


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("text_a") == F.col("m_text_a")) & (F.col("text_b") == F.col("m_text_b"))


def short_lines(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``passages``, for items that are whole lines. ``docs`` has ME, bare and template."""
    cut = lambda c: F.split(c, "\n")
    lines = F.arrays_zip(cut("bare").alias("bare"), cut("template").alias("template"))
    short = F.filter(F.transform(lines, lambda x: F.struct(split_words(x["bare"]).alias("raw"), split_words(x["template"]).alias("slots"))), lambda x: F.size(x["slots"]).between(1, WIDTH - 1))
    listed = docs.select(*ME, F.explode(F.array_distinct(short)).alias("line")).select(*ME, "line.*")
    wanted = items.select("item", F.col("slots").alias("item_slots"), F.col("fills").alias("item_fills"))
    wanted = F.broadcast(wanted) if light(wanted) else wanted
    met = listed.join(wanted, F.col("slots") == F.col("item_slots"))
    agreeing = met.select(*ME, "item", F.size("item_slots").alias("n"), "item_fills", _agreeing(F.col("slots"), F.col("raw"), F.lit(0)).alias("agreeing"))
    return agreeing.where(_consistent(F.col("agreeing"))).select(*ME, "item", "n", F.transform("agreeing", lambda x: x["i"]).alias("places"))


def _lines_of(docs: DataFrame) -> DataFrame:
    """ME, bare and template of each document's lines of fewer than WIDTH template words, which are its words without those of punctuation alone."""
    words = lambda x: F.size(split_words(F.regexp_replace(F.translate(x, MARK, " "), r"[^\p{L}\p{M}\p{N}\s]+", "")))
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: words(x).between(1, WIDTH - 1))
    some = docs.select("doc_id", *text_keys(), F.array_join(lines, "\n").alias("text")).where(F.col("text") != "")
    return with_templates(some).select(*ME, "bare", "template")


def leaks(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id, text_a, text_b, item_id, n_words, n_covered: the items in each document."""
    items, members = items_of(benchmark)
    items = checkpoint(items)
    found = passages(docs.select("doc_id", "text"), items.where(F.size("slots") >= WIDTH))
    short = items.where(F.size("slots") < WIDTH)
    if short.limit(1).count():
        found = found.union(short_lines(_lines_of(docs), short))
    places = F.array_distinct(F.flatten(F.collect_set("places")))
    covered = found.groupBy(*ME, "item").agg(F.first("n").alias("n"), places.alias("places")).where(F.size("places") >= min_cover * F.col("n"))
    words = F.size(F.filter("places", lambda i: ~is_slot(F.get("slots", i))))
    enough = covered.join(items.select("item", "slots"), "item").where(words >= F.least(F.lit(MIN_LITERALS), _literals(F.col("slots"))))
    return enough.join(members, "item").select(*ME, "item_id", F.col("n").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_covered"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Texts aren't shuffled unless very many are contaminated."""
    bad = checkpoint(leaks(docs, read(spark, sf_dir, "benchmark")).select("text_a", "text_b").distinct())
    bad = F.broadcast(bad) if small_enough(bad, BROADCAST_TEXTS) else bad
    return docs.select(own_columns(docs), *text_keys()).join(bad, ["text_a", "text_b"], "left_anti").select("__own.*")
