"""Where models plug in: a callable made once for each task reads rows in Arrow batches. Deterministic stubs stand in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.shipping import ship_package


class Model(Protocol):
    """``load`` once, then ``generate`` for each batch of rows, then ``dispose``."""

    def load(self) -> None: ...
    def generate(self, rows: pd.DataFrame) -> pd.DataFrame: ...
    def dispose(self) -> None: ...


BACKENDS: dict[str, Callable[..., Model]] = {}


def register_backend(name: str, make: Callable[..., Model]) -> None:
    """``make(**config)`` gives the model that is called ``name`` in configurations."""
    BACKENDS[name] = make


def backend(name: str, **config) -> Callable[[], Model]:
    """What makes the model of that name; it is called in each task, so what it loads needn't be sent."""
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(sorted(BACKENDS))}")
    make = BACKENDS[name]
    return lambda: make(**config)


def _made(model: Model, rows: pd.DataFrame, attempts: int, fallback: Callable[[pd.DataFrame], pd.DataFrame] | None) -> Iterator[pd.DataFrame]:
    """What the model makes of ``rows``; if it fails ``attempts`` times, of each half, down to the rows that are at fault."""
    for left in reversed(range(attempts)):
        try:
            yield model.generate(rows)
            return
        except Exception:
            if not left and fallback is None:
                raise
    if len(rows) == 1:
        yield fallback(rows)
        return
    half = len(rows) // 2
    for part in (rows.iloc[:half], rows.iloc[half:]):
        yield from _made(model, part.reset_index(drop=True), attempts, fallback)


def apply_model(df: DataFrame, make: Callable[[], Model], schema: str, attempts: int = 1, fallback: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Rows that the model makes of ``df``'s, any number for each; a batch is tried ``attempts`` times.

    With a ``fallback`` a batch that still fails is halved until the failing rows stand alone, and these go through the
    fallback; without one the task fails. A failure of one row costs some ``attempts * log2`` batches more.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        model.load()
        try:
            for rows in batches:
                yield from _made(model, rows, attempts, fallback)
        finally:
            model.dispose()

    return df.mapInPandas(run, schema)


def translate(segments: DataFrame, make: Callable[[], Model], attempts: int = 3) -> DataFrame:
    """``dst`` and ``fell_back`` for segments (session_id, seg_idx, text): the model's text, or the source's where it fails."""
    kinds = {c: segments.schema[c].dataType.simpleString() for c in ("session_id", "seg_idx")}
    schema = f"session_id {kinds['session_id']}, seg_idx {kinds['seg_idx']}, src string, dst string, fell_back boolean"

    def source(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"session_id": rows["session_id"], "seg_idx": rows["seg_idx"], "src": rows["text"], "dst": rows["text"], "fell_back": True})

    class Texts:
        """The backend sees texts only."""

        def __init__(self):
            self.inner = make()
            self.load, self.dispose = self.inner.load, self.inner.dispose

        def generate(self, rows: pd.DataFrame) -> pd.DataFrame:
            return source(rows).assign(dst=self.inner.generate(rows[["text"]])["text"].to_numpy(), fell_back=False)

    return apply_model(segments.select("session_id", "seg_idx", "text"), Texts, schema, attempts, source)


class Bracketer:
    """Stands in for a translator: texts in brackets; it refuses batches with a text whose length ends in ``refuses``."""

    def __init__(self, refuses: int | None = None):
        self.refuses = refuses

    def load(self) -> None:
        pass

    def dispose(self) -> None:
        pass

    def generate(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self.refuses is not None and (rows["text"].str.len() % 10 == self.refuses).any():
            raise ValueError("refused")
        return pd.DataFrame({"text": "[" + rows["text"] + "]"})


class EchoRecogniser:
    """Stands in for speech or character recognition: a segment for each sentence of ``text``, times by length."""

    def load(self) -> None:
        pass

    def dispose(self) -> None:
        pass

    def generate(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for session, text in zip(rows["session_id"], rows["text"].fillna(""), strict=True):
            at = 0
            for i, part in enumerate(p.strip() for p in text.split(".") if p.strip()):
                out.append((session, i, part, at, at + 50 * len(part)))
                at += 50 * len(part)
        return pd.DataFrame(out, columns=["session_id", "seg_idx", "text", "start_ms", "end_ms"])


register_backend("echo", EchoRecogniser)
register_backend("bracketer", Bracketer)
