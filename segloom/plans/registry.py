"""All queries of the engine by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import files, observations, readers, streams, tables, timeline


def queries() -> dict:
    return timeline.QUERIES | tables.QUERIES | readers.QUERIES | observations.QUERIES | files.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return timeline.ORACLES | tables.ORACLES | readers.ORACLES | observations.ORACLES | files.ORACLES | streams.ORACLES
