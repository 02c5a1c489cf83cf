"""Runs stages one after the other over a folder of tables: what is fresh is skipped, what failed is where the next run begins.

A stage's table is written with a note of the tables it was made from. It is fresh as long as these are the ones that are
there; sources are known by a mark, say a time of change or a version. So a change of a source makes all that follows from
it again, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import versions

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    make: Callable[[Tables], DataFrame]


class StageFailed(Exception):
    """``outcomes`` has what happened up to the stage that failed."""

    def __init__(self, stage: str, outcomes: dict[str, str]):
        super().__init__(f"stage {stage} failed")
        self.stage, self.outcomes = stage, outcomes


def run(spark: SparkSession, path: str, stages: list[Stage], sources: Tables, marks: dict[str, str], attempts: int = 1) -> dict[str, str]:
    """Brings all stages' tables below ``path`` up to date; for each stage ``fresh`` or ``made``. A stage is tried ``attempts`` times."""
    outcomes: dict[str, str] = {}
    for stage in stages:
        there = versions.entries(spark, path)
        of = {i: there[i]["folder"] if i in there else marks[i] for i in stage.inputs}
        if stage.name in there and there[stage.name]["note"] == of:
            outcomes[stage.name] = "fresh"
            continue
        tables = sources | versions.read_tables(spark, path)
        for left in reversed(range(attempts)):
            try:
                versions.write_tables(spark, path, {stage.name: stage.make(tables)}, note=of)
                break
            except Exception as e:
                if not left:
                    outcomes[stage.name] = "failed"
                    raise StageFailed(stage.name, outcomes) from e
        outcomes[stage.name] = "made"
    return outcomes
