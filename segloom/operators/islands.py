"""Window operators over the segments or frames of a session: gaps, padding, runs and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START_PAD, END_PAD, MIN_GAP = 100, 300, 50
CHUNK_MS = 600_000


def by_session(*order: str):
    return W.partitionBy("session_id").orderBy(*order)


def with_gaps(segments: DataFrame) -> DataFrame:
    """Adds ``gap_ms``: the start less the end before; null for a session's first."""
    return segments.withColumn("gap_ms", F.col("start_ms") - F.lag("end_ms").over(by_session("seg_idx")))


def pad(segments: DataFrame) -> DataFrame:
    """Widens segments into the gaps beside them: in full where there is room, in proportion, or to the gap's middle."""
    w = by_session("seg_idx")
    room = START_PAD + END_PAD + MIN_GAP
    before, after = F.col("start_ms") - F.lag("end_ms").over(w), F.lead("start_ms").over(w) - F.col("end_ms")

    def share(gap: Column, most: int) -> Column:
        part = (gap - MIN_GAP) * float(most) / (START_PAD + END_PAD)
        return F.when(gap >= room, F.lit(float(most))).when(gap > MIN_GAP, part).otherwise(gap / 2)

    start = F.greatest(F.col("start_ms") - F.when(before.isNull(), F.lit(float(START_PAD))).otherwise(share(before, START_PAD)), F.lit(0.0))
    end = F.col("end_ms") + F.when(after.isNull(), F.lit(float(END_PAD))).otherwise(share(after, END_PAD))
    return segments.withColumns({"padded_start": start, "padded_end": end})


def _merged(rows: DataFrame, keys: list[str], order: tuple[str, ...], max_gap: int | None) -> DataFrame:
    """``rows`` (first: the order and the first row's seg_idx, text and start_ms; end_ms, n_merged, parted) merged inside of ``keys``.

    Neighbours of one text are a run, unless one is ``parted`` from what is before; a run is cut where a start is more
    than ``max_gap`` behind all ends before. Adds ``run`` and ``isle``, the number within the run.
    """
    in_order = [F.col(f"first.{c}") for c in order]
    new = F.col("parted") | ~F.lag("first.text").over(W.partitionBy(*keys).orderBy(*in_order)).eqNullSafe(F.col("first.text"))
    runs = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(W.partitionBy(*keys).orderBy(*in_order)))
    in_run = W.partitionBy(*keys, "run").orderBy(*in_order)
    far = F.lit(0)
    if max_gap is not None:
        before = F.max("end_ms").over(in_run.rowsBetween(W.unboundedPreceding, -1))
        far = F.coalesce((F.col("first.start_ms") - before > max_gap).cast("int"), F.lit(0))
    isles = runs.withColumn("far", far).withColumn("isle", F.sum("far").over(in_run))
    return isles.groupBy(*keys, "run", "isle").agg(F.min("first").alias("first"), F.max("end_ms").alias("end_ms"), F.sum("n_merged").alias("n_merged"))


def merge_same_text(segments: DataFrame, max_gap: int | None = 1000, order: tuple[str, ...] = ("start_ms", "seg_idx")) -> DataFrame:
    """Neighbours of one text whose gap is at most ``max_gap`` become one segment; blank texts are left out before.

    ``order`` begins with a time; rows are ordered by it. Merging merged segments gives what merging the rows gives, so
    chunks of CHUNK_MS are merged side by side, and then, for each session, what lies in the first and last run of a
    chunk: nothing else can meet what is in another chunk. A long session is spread over its chunks.
    """
    own = [*order, *[c for c in ("seg_idx", "text", "start_ms") if c not in order]]
    chunk = F.coalesce(F.floor(F.col(order[0]) / CHUNK_MS), F.lit(-(1 << 62)))  # rows without a time come first
    rows = segments.where(F.coalesce("text", F.lit("")) != "").select("session_id", chunk.alias("chunk"), F.struct(*own).alias("first"), "end_ms", F.lit(1).alias("n_merged"), F.lit(False).alias("parted"))
    inside = _merged(rows, ["session_id", "chunk"], order, max_gap)
    last = F.max("run").over(W.partitionBy("session_id", "chunk"))
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last"))
    parted = (F.col("run") == F.col("last")) & (F.col("run") > 1) & (F.col("isle") == 0)
    across = inside.withColumn("last", last).select("session_id", F.when(~edge, F.col("chunk")).alias("inner"), "first", "end_ms", "n_merged", parted.alias("parted"))
    whole = _merged(across, ["session_id", "inner"], order, max_gap)
    return whole.select("session_id", "first.seg_idx", "first.text", "first.start_ms", "end_ms", "n_merged")


def frame_runs(frames: DataFrame, min_ms: int = 500) -> DataFrame:
    """Runs of equal text among the frames with text; a run ends where the next begins, the last at the last frame."""
    last = frames.groupBy("session_id").agg(F.max("ts_ms").alias("last_ms"))
    w = by_session("ts_ms", "frame_idx")
    marked = frames.where("text <> ''").withColumn("new", (~F.lag("text").over(w).eqNullSafe(F.col("text"))).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy("session_id", "run").agg(F.first("text").alias("text"), F.min("ts_ms").alias("start_ms"), F.count("*").alias("frames"))
    ended = runs.withColumn("next", F.lead("start_ms").over(by_session("run"))).join(last, "session_id")
    return ended.select("session_id", "run", "text", "start_ms", F.coalesce("next", "last_ms").alias("end_ms"), "frames").where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def stable_runs(frames: DataFrame, fps: float) -> DataFrame:
    """Runs of equal text, also the empty one, of at least four hundredths of a second's frames."""
    least = max(1, int(0.04 * fps + 0.5))
    w = by_session("ts_ms", "frame_idx")
    marked = frames.withColumn("new", (~F.lag("text").over(w).eqNullSafe(F.col("text"))).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = marked.groupBy("session_id", "run").agg(F.first("text").alias("text"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("frames"))
    return runs.where(F.col("frames") >= least)


def bridge_runs(runs: DataFrame, max_gap: int = 120) -> DataFrame:
    """Neighbouring runs of one text with a gap below ``max_gap`` become one."""
    named = runs.withColumnRenamed("run", "seg_idx")
    merged = merge_same_text(named, max_gap - 1)
    return merged.withColumnRenamed("seg_idx", "run")


def transitions(runs: DataFrame) -> DataFrame:
    """Where the text of a run differs from the run before: the time, the old text and the new."""
    before = F.lag("text").over(by_session("start_ms", "run"))
    return runs.withColumn("from_text", before).where(F.col("from_text").isNotNull() & (F.col("from_text") != F.col("text"))).select("session_id", F.col("start_ms").alias("ms"), "from_text", F.col("text").alias("to_text"))


def clip_windows(segments: DataFrame, total: str = "total_ms") -> DataFrame:
    """What to cut from the audio: 80 ms before to 160 ms after, within the whole."""
    return segments.withColumns({"clip_start": F.greatest(F.col("start_ms") - 80, F.lit(0)), "clip_end": F.least(F.col(total), F.col("end_ms") + 160)}).where("clip_end > clip_start")


def shift_lead_in(segments: DataFrame, removed: str = "removed_ms") -> DataFrame:
    """Starts moved past silence of over 500 ms, all but 80 ms of it, unless that reaches the end."""
    moved = F.col("start_ms") + F.col(removed) - 80
    return segments.withColumn("start_ms", F.when((F.col(removed) > 500) & (moved < F.col("end_ms")), moved).otherwise(F.col("start_ms")))


def best_lines(lines: DataFrame) -> DataFrame:
    """The line of highest confidence in each frame, the last on ties."""
    best = F.max_by(F.struct("text", "confidence", "line_idx"), F.struct("confidence", "line_idx")).alias("best")
    return lines.groupBy("session_id", "frame_idx").agg(best).select("session_id", "frame_idx", "best.text", "best.confidence", "best.line_idx")


def consecutive(observations: DataFrame, hold_ms: int = 0) -> DataFrame:
    """Observations (time_ms, text) of one text in a row as one segment, to the last of them and ``hold_ms`` more."""
    rows = observations.select("session_id", "seg_idx", "text", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + hold_ms).alias("end_ms"))
    return merge_same_text(rows, None)


def reading_order(boxes: DataFrame, band: int = 20) -> DataFrame:
    """Lines of a frame numbered from top to bottom, in bands of ``band``, and from left to right; ``box`` is an array of points.

    Heights less apart than a band aren't ordered by them in the reference, which is no order; bands are one.
    """
    centre = lambda k: F.aggregate("box", F.lit(0.0), lambda a, p: a + p[k]) / F.size("box")
    placed = boxes.withColumns({"centre_x": centre(0), "centre_y": centre(1)})
    w = W.partitionBy("session_id", "frame_idx").orderBy(F.floor(F.col("centre_y") / band), "centre_x", "line_idx")
    return placed.withColumn("place", F.row_number().over(w))


def in_band(lines: DataFrame, low: float = 620, high: float = 700) -> DataFrame:
    """Lines whose box has the middle of its height from ``low`` to ``high``, with the box's extents."""
    side = lambda f, k: f(F.transform("box", lambda p: p[k]))
    sized = lines.withColumns({"x_min": side(F.array_min, 0), "x_max": side(F.array_max, 0), "y_min": side(F.array_min, 1), "y_max": side(F.array_max, 1)})
    return sized.where(((F.col("y_min") + F.col("y_max")) / 2).between(low, high))


def sure_lines(lines: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Lines of more than ``threshold`` confidence, not of just as much."""
    return lines.where(F.col("confidence") > threshold)


def snapped(rows: DataFrame, frames: DataFrame, seconds: str, per_second: int = 5) -> DataFrame:
    """Each row with the frame (frame_no, path) nearest to its time, or nulls where there is no such frame."""
    number = F.floor(F.col(seconds) * per_second + 0.5).cast("bigint") + 1
    return rows.withColumn("frame_no", number).join(frames, ["session_id", "frame_no"], "left")
