"""Stages of a dubbing pipeline as compositions of operators, from a registry by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded_translation, js_round, srt_time
from ..operators import folds, islands


def asr_fix(segments: DataFrame) -> DataFrame:
    """Trimmed segments with text, padded into their gaps, with formatted times."""
    clean = segments.withColumn("text", F.trim("text")).where(F.length("text") > 0)
    return islands.pad(clean).withColumns({"start_fmt": srt_time(F.col("padded_start")), "end_fmt": srt_time(F.col("padded_end"))})


def ocr_segments(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """The best line of each frame, merged to segments. ``frames`` has session_id, frame_idx, ts_ms, box_low, box_high."""
    best = islands.best_lines(lines).select("session_id", "frame_idx", "text")
    return folds.merge_frames(frames.join(best, ["session_id", "frame_idx"], "left").fillna("", ["text"]))


def translation(segments: DataFrame, dst: str, src_lang: str, dst_lang: str) -> DataFrame:
    """Translation rows; a translation that failed gives way to its source."""
    good = F.replace(guarded_translation(F.col("text"), F.col(dst), F.lit(dst_lang)), F.lit("——"), F.lit("，"))
    return segments.select("session_id", "seg_idx", F.col("text").alias("src"), good.alias("dst"), F.lit(src_lang).alias("src_lang"), F.lit(dst_lang).alias("dst_lang"), F.floor("start_ms").alias("start_time"), F.ceil("end_ms").alias("end_time"), F.lit("1").alias("speaker"))


def untranslated(segments: DataFrame) -> DataFrame:
    """Rows of a session that isn't translated: the text is its own translation, and times are whole."""
    text = F.trim("text")
    rows = segments.where(F.length(text) > 0)
    return rows.select("session_id", "seg_idx", text.alias("src"), text.alias("dst"), js_round(F.col("start_ms")).alias("start_time"), js_round(F.col("end_ms")).alias("end_time"))


def cues(timings: DataFrame, text: str = "dst") -> DataFrame:
    """Subtitle cues of translated and timed rows."""
    placed = timings.select("session_id", "seg_idx", F.trim(text).alias("text"), F.coalesce("actual_start_time", "start_time").alias("start_ms"), F.coalesce("actual_end_time", "end_time").alias("end_ms"))
    return folds.allocate_cues(folds.with_fragments(placed.where(F.length("text") > 0)))


STAGES = {"asr_fix": asr_fix, "ocr": ocr_segments, "translate": translation, "merge_audio": folds.schedule, "merge_video": cues}
