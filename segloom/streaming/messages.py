"""Streams: worker messages correlated by task and stage, frames merged as they come, and sessions of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .. import schemas
from ..operators.folds import BRIDGE_MS, LEAST_MS, MAX_DISTANCE, within
from ..plans.shipping import ship_package


def parse_messages(lines: DataFrame) -> DataFrame:
    """Messages of JSON lines; what is no message is left out."""
    return lines.select(F.from_json("value", schemas.MESSAGES).alias("m")).select("m.*").where("type IS NOT NULL")


def progress_of(lines: DataFrame) -> DataFrame:
    """Percent done from lines like ``[PROGRESS] 40`` or ``3/12``."""
    plain = F.regexp_extract("value", r"\[PROGRESS\]\s*(\d+)", 1)
    done, all_ = (F.regexp_extract("value", r"(\d+)/(\d+)", k).try_cast("int") for k in (1, 2))
    percent = F.coalesce(F.nullif(plain, F.lit("")).cast("int"), F.floor(100 * done / F.nullif(all_, F.lit(0))).cast("int"))
    return lines.withColumn("progress", percent).where("progress IS NOT NULL")


def task_outcomes(messages: DataFrame, idle_ms: int = 1_800_000) -> DataFrame:
    """For each task and stage its last progress when it completes or fails, or ``idle`` when nothing came for ``idle_ms``."""
    ship_package(messages.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        progress, outcome = state.get if state.exists else (0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "stage": [key[1]], "outcome": ["idle"], "progress": [progress]})
            return
        for rows in batches:
            for kind, value in zip(rows["type"], rows["progress"], strict=True):
                if outcome is None and kind in ("complete", "error"):
                    outcome = kind
                elif kind == "progress" and value == value and value is not None:
                    progress = max(progress, int(value))
        if outcome is None:
            state.update((progress, outcome))
            state.setTimeoutDuration(idle_ms)
        else:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "stage": [key[1]], "outcome": [outcome], "progress": [progress]})

    return messages.groupBy("task_id", "stage").applyInPandasWithState(run, "task_id string, stage string, outcome string, progress int", "progress int, outcome string", "append", GroupStateTimeout.ProcessingTimeTimeout)


class FrameMerger(StatefulProcessor):
    """Frames of a session wait until the watermark has passed them and are then merged in order of time, whenever they came.

    A run goes on with a like text BRIDGE_MS behind its last frame at most. It ends where the blanks behind it begin, else
    with the next text, but no more than BRIDGE_MS behind its last frame. One timer is set, for the first frame that waits
    or the open run's end, whichever comes first; what waits is bounded by the watermark's delay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, text string")
        self.run = handle.getValueState("run", "text string, start long, last long, blank long")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, at: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = self.timer.get()[0] if self.timer.exists() else None
        for batch in rows:
            frames = [(int(t.timestamp() * 1000), text) for t, text in zip(batch["ts"], batch["text"].fillna(""), strict=True)]
            if frames:
                self.waiting.appendList(frames)
                earliest = min(t for t, _ in frames)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._set_timer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        frames = sorted(self.waiting.get())
        rest = [f for f in frames if f[0] > watermark]
        run, closed = self.run.get() if self.run.exists() else None, []
        for now, text in frames[: len(frames) - len(rest)]:
            if not text:
                run = (*run[:3], now) if run is not None and run[3] is None else run
            elif run is not None and now - run[2] <= BRIDGE_MS and within(text, run[0], MAX_DISTANCE):
                run = (run[0], run[1], now, None)
            else:
                if run is not None:
                    closed.append((run[0], run[1], min(now, run[2] + BRIDGE_MS, run[3] or now)))
                run = (text, now, now, None)
        if run is not None and run[2] + BRIDGE_MS <= watermark:
            closed.append((run[0], run[1], min(run[2] + BRIDGE_MS, run[3] or run[2] + BRIDGE_MS)))
            run = None
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.run.update(run) if run is not None else self.run.clear()
        self._set_timer(min((x for x in (rest[0][0] if rest else None, run[2] + BRIDGE_MS if run else None) if x is not None), default=None))
        found = [c for c in closed if c[2] - c[1] >= LEAST_MS]
        if found:
            yield pd.DataFrame({"session_id": [key[0]] * len(found), "text": [c[0] for c in found], "start_ms": [c[1] for c in found], "end_ms": [c[2] for c in found]})

    def close(self) -> None:
        pass


def frame_segments(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Segments of a stream of frames (session_id, ts, text), the same however the frames are cut into batches: see FrameMerger.

    Frames later than ``delay`` are left out. The state's lists and timers need the RocksDB store, which is set here.
    """
    ship_package(frames.sparkSession)
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = frames.schema["session_id"].dataType.simpleString()
    grouped = frames.select("session_id", "ts", "text").withWatermark("ts", delay).groupBy("session_id")
    return grouped.transformWithStateInPandas(FrameMerger(), f"session_id {kind}, text string, start_ms long, end_ms long", "append", "eventTime")


def event_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user's events (ts a timestamp) with their number; the reference has no such windows."""
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
