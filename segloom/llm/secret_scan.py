"""Secret scans: patterns for known kinds, and sliding-window entropy for strings that match none.

``assign``, ``access`` and ``hex`` are found by pattern. Beyond them, each run of CANDIDATE characters is cut at the
stretches that the allow-list knows (placeholders, plain sequences, one character repeated, words of a path), parts put
together of words are left out, and each other part of WINDOW characters or more is read by a window: counts by character change by one in and one out at each step, and the Shannon
entropy with them. A run is reported as ``entropy`` if a window of one of its parts reaches the threshold of that part's
character class, and if the run overlaps no pattern's span. All of it is SQL.

A random key of letters in one case can't be told from a long word by entropy, so their threshold is where words don't
reach; other classes have thresholds that random strings of WINDOW characters mostly pass. Runs of fewer than WINDOW
characters are never reported by entropy.

Spans are code points, end exclusive. Defined cases: a null text counts as empty; no match gives zero counts, an
empty list and the SHA-256 of the empty string; repeated rows are scanned each by itself; empty tables give no
rows; other columns pass through, and columns with the names of results are replaced.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, text_or_empty

#: For access and hex, runs that are long enough are the runs that aren't dropped; assign needs its matches before it drops any.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_VALUE = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Character classes, the narrowest first, with the bits per character that a window needs. A window of WINDOW characters
#: can reach 3.32 (ten digits), 4 (hex) and 4.32 bits.
CLASSES = [("digits", r"^[0-9]+$", 2.8), ("hex", r"^[0-9a-fA-F]+$", 3.2), ("one case", r"^(?:[a-z]+|[A-Z]+)$", 4.0), ("letters", r"^[A-Za-z]+$", 3.9), ("words", r"^[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*$", 4.1), ("mixed", "", 3.7)]
# Placeholders of documentation, plain sequences, one character repeated, UUIDs.
ALLOWED = r"(?i)example|placeholder|changeme|dummy|sample|x{6,}|0123456789|1234567890|abcdefgh|(.)\1{7,}|(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
#: What is put together of words, as paths and long names are: WORD_LENGTH characters or more for each stretch of one kind.
#: Random keys have some 2.2 (base64), 2.5 (lower case and digits) or 2.8 (letters of both cases).
PIECE, ONE_KIND, WORD_LENGTH = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+", "^(?:[0-9]+|[a-z]+|[A-Z]+)$", 4
#: Two or more words or short numbers, each with a separator behind it.
PATH = r"(?<![A-Za-z])(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]{1,4})[+/_=-]++){2,}+"
#: Matches whose places are added up at a time.
CHUNK = 128

SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's matches: what lies between the matches and they themselves, measured in turn.

    First inside of chunks of matches, then over the chunks, as appending to one long list would copy it each time.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def measured(rows: Column, size, one) -> Column:
        """``one(row, begin)`` for each row, where rows are ``size(row)`` long, and where the last one ends."""
        kind_of = f"array<{'struct<start:bigint,kind:int,end:bigint,text:string>' if one is span else 'struct<begin:bigint,spans:' + SPAN + '>'}>"
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind_of).alias("out"))
        return F.aggregate(rows, start, lambda s, x: F.struct((s["at"] + size(x)).cast("bigint").alias("at"), F.array_append(s["out"], one(x, s["at"])).cast(kind_of).alias("out")))

    def span(x: Column, begin: Column) -> Column:
        first = begin + F.length(x["gap"])
        return F.struct(first.cast("bigint").alias("start"), F.lit(kind).alias("kind"), (first + F.length(x["found"])).cast("bigint").alias("end"), x["found"].alias("text"))

    def chunk(x: Column, begin: Column) -> Column:
        return F.struct(begin.alias("begin"), x["out"].alias("spans"))

    long = lambda x: F.length(x["gap"]) + F.length(x["found"])
    whole = F.filter(pairs, lambda x: x["found"].isNotNull())  # what follows the last match has none
    cut = let(whole, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(CHUNK)), lambda i: measured(F.slice(w, i, CHUNK), long, span)))
    placed = measured(cut, lambda x: x["at"], chunk)["out"]
    moved = F.flatten(F.transform(placed, lambda c: F.transform(c["spans"], lambda s: F.struct((s["start"] + c["begin"]).alias("start"), s["kind"].alias("kind"), (s["end"] + c["begin"]).alias("end"), s["text"].alias("text")))))
    return F.when(text.rlike(pattern), moved).otherwise(F.array().cast(SPAN))


def window_entropy(value: Column) -> Column:
    """The highest entropy, in bits per character, of the windows of WINDOW characters in ``value``; 0 for a shorter one."""
    table = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    weight = lambda c: F.get(table, c)
    zero = F.struct(F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(codes: Column, state: Column, i: Column) -> Column:
        into, out = F.get(codes, i), F.coalesce(F.get(codes, i - WINDOW), F.lit(0))
        changed = F.transform(state["counts"], lambda c, k: c + (k + 1 == into).cast("int") - (k + 1 == out).cast("int"))
        had = F.get(state["counts"], into - 1)
        lost = F.get(state["counts"], out - 1) + (into == out).cast("int")
        total = state["sum"] + weight(had + 1) - weight(had) + F.coalesce(weight(lost - 1) - weight(lost), F.lit(0.0))
        return let(total, lambda t: F.struct(changed.alias("counts"), t.alias("sum"), F.when(i >= WINDOW - 1, F.greatest(state["best"], F.lit(log2(WINDOW)) - t / WINDOW)).otherwise(F.lit(0.0)).alias("best")))

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(codes, lambda codes: F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, lambda s, i: step(codes, s, i), lambda s: s["best"]))


def suspicious(value: Column) -> Column:
    """Whether a part of ``value`` that the allow-list doesn't know has a window of high entropy for its class."""

    def fires(part: Column) -> Column:
        limit = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            limit = F.when(part.rlike(pattern), bits).otherwise(limit)
        wordy = ~part.rlike(ONE_KIND) & (F.length(part) >= WORD_LENGTH * F.size(F.regexp_extract_all(part, F.lit(PIECE), F.lit(0))))
        return (F.length(part) >= WINDOW) & ~wordy & (window_entropy(part) >= limit)

    return F.exists(F.split(value, f"{PATH}|{ALLOWED}"), fires)


def _joined(spans: Column) -> Column:
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(named, ",")


def scan(df: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_entropy, base_sha256, spans (as a string) and found, an array of structs."""
    results = ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "found"]
    t = F.col("__text")
    value = lambda x: F.regexp_extract(x["text"], ASSIGN, 1)
    base = df.drop(*results).withColumn("__text", text_or_empty()).withColumns({
        "__assign": F.filter(_spans(t, ASSIGN, 1), lambda x: F.length(value(x)) >= MIN_VALUE), "__access": _spans(t, ACCESS, 2), "__hex": _spans(t, HEX, 3),
        "__runs": _spans(t, CANDIDATE, 4),
    }).withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    free = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter("__runs", lambda x: free(x) & suspicious(x["text"]))
    found = base.withColumn("__more", more).withColumn("found", F.array_sort(F.concat("__base", "__more")))
    return found.withColumns({
        "n_assign": F.size("__assign").cast("long"), "n_access": F.size("__access").cast("long"), "n_hex": F.size("__hex").cast("long"), "n_entropy": F.size("__more").cast("long"),
        "base_sha256": F.sha2(_joined(F.col("__base")).cast("binary"), 256), "spans": _joined(F.col("found")),
    }).drop("__text", "__assign", "__access", "__hex", "__runs", "__base", "__more")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")
