"""Joins of segments by time: overlaps, containment, nearest starts, and what has no partner.

All go through ``range_pairs``: both sides are cut into buckets of time and joined on (session, bucket) and the range
condition, so that a long session is spread over its buckets, and a pair is kept only in the first bucket it shares.
A segment of over WIDEST buckets, say one with a broken end, lies in buckets that are WIDEST times as wide, and so on, so
that it has few rows however long it is; the other side's segments also lie in such buckets where there are any, which a
subquery over times alone tells. Nearest starts need no pairs: both sides are sorted together.
Segments have session_id, an index, text, start_ms and end_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import iou, shares_character, similar_enough
from .islands import merge_same_text

BUCKET_MS, CELL_MS = 60_000, 600_000
#: Buckets that a segment may lie in.
WIDEST, LEVELS = 64, 11


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _level(low: Column, high: Column, width: int) -> Column:
    """The least level of which a segment takes WIDEST buckets or fewer; level k has buckets of ``width * WIDEST**k``."""
    level, span = F.lit(0), high - low
    for k in range(1, LEVELS):
        if (least := width * WIDEST ** (k - 1) * (WIDEST - 1)) < 1 << 62:
            level += (span >= least).cast("int")
    return level


def _placed(df: DataFrame, low: Column, high: Column, width: int, others: Column) -> DataFrame:
    """``df`` in buckets ``__at`` (level, bucket, first: the first bucket of that level): those of its own ``__level``, and of higher levels among ``others``."""
    own = F.col("__level")
    levels = F.concat(F.array(own), F.filter("__others", lambda k: k > own))

    def buckets(k: Column) -> Column:
        wide = F.lit(float(width)) * F.pow(F.lit(float(WIDEST)), k)
        return F.transform(F.sequence(F.floor(low / wide), F.floor(high / wide)), lambda x: F.struct(k.alias("level"), x.alias("bucket"), F.floor(low / wide).alias("first")))

    return df.withColumns({"__level": _level(low, high, width), "__others": others}).withColumn("__at", F.explode(F.flatten(F.transform(levels, buckets)))).drop("__others")


def range_pairs(a: DataFrame, b: DataFrame, before: int = 0, after: int = 0, closed: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of one session where ``a`` meets ``b`` widened by ``before`` and ``after``; columns ``a_*`` and ``b_*``.

    Segments that end before they begin are in no pair. Half-open: ``a.start < b.end + after`` and ``b.start - before < a.end``. Closed: with ``<=``.
    """
    left, right = _renamed(a, "a_").where("a_end_ms >= a_start_ms"), _renamed(b, "b_").where("b_end_ms >= b_start_ms")
    low, high = F.col("b_start_ms") - before, F.col("b_end_ms") + after
    own, other = (F.col("a_start_ms"), F.col("a_end_ms")), (low, high)
    levels = lambda df, at: df.agg(F.collect_set(_level(*at, bucket_ms))).scalar()
    left, right = _placed(left, *own, bucket_ms, levels(right, other)), _placed(right, *other, bucket_ms, levels(left, own))
    right = right.withColumnsRenamed({"__level": "__b_level", "__at": "__b_at"})
    meets = (F.col("a_start_ms") <= high) & (low <= F.col("a_end_ms")) if closed else (F.col("a_start_ms") < high) & (low < F.col("a_end_ms"))
    same = (F.col("__at.level") == F.col("__b_at.level")) & (F.col("__at.bucket") == F.col("__b_at.bucket"))
    once = (F.col("__at.level") == F.greatest("__level", "__b_level")) & (F.col("__at.bucket") == F.greatest("__at.first", "__b_at.first"))
    return left.join(right, (F.col("a_session_id") == F.col("b_session_id")) & same & once & meets).drop("__at", "__b_at", "__level", "__b_level")


def _overlap() -> Column:
    return F.least("a_end_ms", "b_end_ms") - F.greatest("a_start_ms", "b_start_ms")


def _without(a: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    met = pairs.select(F.col("a_session_id").alias("session_id"), F.col(f"a_{key}").alias(key)).distinct()
    return a.join(met, ["session_id", key], "left_anti")


def best_match(truth: DataFrame, found: DataFrame) -> DataFrame:
    """For each true segment the found one of highest IoU, the first on ties; offsets are null where none overlaps."""
    pairs = range_pairs(truth, found).withColumn("iou", iou(*[F.col(f"{s}_{k}_ms") for s in "ab" for k in ("start", "end")])).where("iou > 0")
    best = pairs.groupBy(F.col("a_session_id").alias("session_id"), F.col("a_seg_idx").alias("seg_idx")).agg(
        F.max_by(F.struct("b_seg_idx", "iou", "b_start_ms", "b_end_ms"), F.struct("iou", -F.col("b_seg_idx"))).alias("best")
    )
    return truth.join(best, ["session_id", "seg_idx"], "left").select(
        "session_id", "seg_idx", F.col("best.b_seg_idx").alias("hyp_idx"), F.col("best.iou").alias("iou"),
        (F.col("best.b_start_ms") - F.col("start_ms")).alias("start_offset"), (F.col("best.b_end_ms") - F.col("end_ms")).alias("end_offset"),
    )


def missed(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True segments that nothing found overlaps."""
    return _without(truth, range_pairs(truth, found).where(_overlap() > 0), "seg_idx")


def false_positives(truth: DataFrame, found: DataFrame) -> DataFrame:
    return missed(found, truth)


def _nearest(a: DataFrame, others: list[DataFrame], tolerance: int) -> DataFrame:
    """session_id, seg_idx and text of ``a``, and ``near_k`` (dist, seg_idx, text): the nearest start in each of ``others``, or null.

    All rows are sorted together by start, so the last one before and, backwards, the last one behind are the
    candidates. A session is cut into cells; only what lies within the tolerance of a border is in two of them.
    """
    width = max(CELL_MS, 4 * tolerance)
    cell = lambda at: F.floor(at / width)
    row = ("session_id", "seg_idx", "text", "start_ms")
    rows = a.select(*row, F.lit(-1).alias("kind"), cell(F.col("start_ms")).alias("cell"))
    for k, b in enumerate(others):
        rows = rows.unionByName(b.select(*row, F.lit(k).alias("kind"), F.explode(F.sequence(cell(F.col("start_ms") - tolerance), cell(F.col("start_ms") + tolerance))).alias("cell")))
    is_a = F.col("kind") == -1
    forth, back = (W.partitionBy("session_id", "cell").orderBy(at, is_a.asc(), F.desc("seg_idx")).rowsBetween(W.unboundedPreceding, W.currentRow) for at in (F.asc("start_ms"), F.desc("start_ms")))
    own = lambda k: F.when(F.col("kind") == k, F.struct("start_ms", "seg_idx", "text"))
    both = range(len(others))
    seen = rows.withColumns({f"{name}_{k}": F.last(own(k), ignorenulls=True).over(w) for k in both for name, w in (("before", forth), ("behind", back))}).where(is_a)

    def candidate(x: Column) -> Column:
        dist = F.abs(F.col("start_ms") - x["start_ms"])
        return F.when(dist <= tolerance, F.struct(dist.alias("dist"), x["seg_idx"].alias("seg_idx"), x["text"].alias("text")))

    return seen.select("session_id", "seg_idx", "text", *[F.least(*[candidate(F.col(f"{name}_{k}")) for name in ("before", "behind")]).alias(f"near_{k}") for k in both])


def nearest_start(a: DataFrame, b: DataFrame, tolerance: int = 4000) -> DataFrame:
    """For each segment of ``a`` the one of ``b`` whose start is nearest, within ``tolerance``, the first on ties."""
    return _nearest(a, [b], tolerance).select("session_id", "seg_idx", "text", F.col("near_0.seg_idx").alias("near_idx"), F.col("near_0.dist").alias("dist"), F.col("near_0.text").alias("near_text"))


def nearest_of_two(truth: DataFrame, first: DataFrame, second: DataFrame, tolerance: int = 4000) -> DataFrame:
    """The nearer of two versions' segments; the first version's on equal distance."""
    one, two = F.col("near_0"), F.col("near_1")
    best = F.when(one["dist"] <= F.coalesce(two["dist"], one["dist"]), one).otherwise(two)
    return _nearest(truth, [first, second], tolerance).select("session_id", "seg_idx", "text", best["seg_idx"].alias("match_idx"), best["dist"].alias("dist"))


def overlap_text_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each of ``a`` the segment of ``b`` with like text that it overlaps longest, the first on ties."""
    pairs = range_pairs(a, b).withColumn("overlap_ms", _overlap()).where((F.col("overlap_ms") > 0) & similar_enough(F.col("a_text"), F.col("b_text")))
    best = F.max_by(F.struct("b_seg_idx", "overlap_ms"), F.struct("overlap_ms", -F.col("b_seg_idx"))).alias("best")
    return pairs.groupBy(F.col("a_session_id").alias("session_id"), F.col("a_seg_idx").alias("seg_idx")).agg(best).select("session_id", "seg_idx", F.col("best.b_seg_idx").alias("match_idx"), "best.overlap_ms")


def fusion_split(ocr: DataFrame, asr: DataFrame) -> DataFrame:
    """OCR segments cut by the ASR segments of other text inside them: the piece before, the ASR segment, the rest; neighbours of one text merged."""
    inside = (F.col("b_start_ms") >= F.col("a_start_ms")) & (F.col("b_end_ms") <= F.col("a_end_ms")) & (F.col("a_text") != F.col("b_text"))
    cuts = range_pairs(ocr, asr, 1, 1).where(inside).select(
        F.col("a_session_id").alias("session_id"), F.col("a_seg_idx").alias("seg_idx"), F.struct(F.col("b_start_ms").alias("s"), F.col("b_seg_idx").alias("i"), F.col("b_end_ms").alias("e"), F.col("b_text").alias("t")).alias("cut")
    )
    in_order = W.partitionBy("session_id", "seg_idx").orderBy("cut")
    at = F.coalesce(F.lag("cut.e").over(in_order), F.col("start_ms"))
    last = F.lead("cut").over(in_order).isNull()
    placed = ocr.join(cuts, ["session_id", "seg_idx"], "left").withColumns({"at": at, "last": last, "k": F.row_number().over(in_order)})
    piece = lambda t, s, e: F.struct(t.alias("text"), s.alias("start_ms"), e.alias("end_ms"))
    rest = F.coalesce("cut.e", "start_ms")
    pieces = F.array(
        F.when(F.col("cut.s") > F.col("at"), piece(F.col("text"), F.col("at"), F.col("cut.s"))), F.when(F.col("cut").isNotNull(), piece(F.col("cut.t"), F.col("cut.s"), F.col("cut.e"))),
        F.when(F.col("last") & (rest < F.col("end_ms")), piece(F.col("text"), rest, F.col("end_ms"))),
    )
    cut = placed.select("session_id", F.col("start_ms").alias("from_ms"), "seg_idx", "k", F.posexplode(pieces).alias("piece", "p")).where("p IS NOT NULL")
    return merge_same_text(cut.select("session_id", "from_ms", "seg_idx", (3 * F.col("k") + F.col("piece")).alias("piece"), "p.*"), order=("from_ms", "seg_idx", "piece"))


def fusion_union(ocr: DataFrame, asr: DataFrame, slack: int = 500) -> DataFrame:
    """OCR and those ASR segments that no OCR segment covers: ``o.start <= a.start`` and ``o.end >= a.end - slack``; neighbours of one text merged."""
    covers = (F.col("b_start_ms") <= F.col("a_start_ms")) & (F.col("b_end_ms") >= F.col("a_end_ms") - slack)
    extra = _without(asr, range_pairs(asr, ocr, 0, slack, closed=True).where(covers), "seg_idx")
    return _united(ocr, extra)


def _united(ocr: DataFrame, extra: DataFrame) -> DataFrame:
    both = ocr.withColumn("source", F.lit(0)).unionByName(extra.withColumn("source", F.lit(1)))
    return merge_same_text(both, order=("start_ms", "source", "seg_idx"))


def fusion_short(ocr: DataFrame, asr: DataFrame, max_ms: int = 2000) -> DataFrame:
    """OCR and those short ASR segments that touch no OCR segment which contains their text or is contained in it; neighbours of one text merged."""
    short = asr.where(F.col("end_ms") - F.col("start_ms") <= max_ms)
    alike = F.col("a_text").contains(F.col("b_text")) | F.col("b_text").contains(F.col("a_text"))
    extra = _without(short, range_pairs(short, ocr, closed=True).where(alike), "seg_idx")
    return _united(ocr, extra)


def recalled(truth: DataFrame, found: DataFrame, slack: int = 1000) -> DataFrame:
    """True segments near which something with a common character was found; very short ones need only be near."""
    pairs = range_pairs(truth, found, slack, slack, closed=True).where(shares_character(F.col("a_text"), F.col("b_text")) | (F.length("a_text") < 3))
    met = pairs.select(F.col("a_session_id").alias("session_id"), F.col("a_seg_idx").alias("seg_idx")).distinct()
    return truth.join(met, ["session_id", "seg_idx"], "left_semi")


def without_noise(segments: DataFrame) -> DataFrame:
    """Segments (with ``frames``) that lie in no other one which contains their text and has over twice their frames."""
    inside = (F.col("b_start_ms") <= F.col("a_start_ms")) & (F.col("b_end_ms") >= F.col("a_end_ms")) & F.col("b_text").contains(F.col("a_text"))
    other = (F.col("a_seg_idx") != F.col("b_seg_idx")) & (F.col("b_frames") > 2 * F.col("a_frames"))
    return _without(segments, range_pairs(segments, segments, closed=True).where(inside & other), "seg_idx")


def zip_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one index side by side, ``b``'s columns as ``b_*``; an error if a session's numbers differ."""
    named = _renamed(b, "b_")
    joined = a.join(named, (F.col("session_id") == F.col("b_session_id")) & (F.col("seg_idx") == F.col("b_seg_idx")), "full")
    bad = F.col("session_id").isNull() | F.col("b_session_id").isNull()
    return joined.withColumn("session_id", F.when(bad, F.raise_error(F.lit("the two sides differ in number")).cast(a.schema["session_id"].dataType)).otherwise(F.col("session_id")))
