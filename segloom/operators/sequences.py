"""Folds over the rows of a key in order, for recurrences that windows can't express: streams with a bounded state.

``fold`` deals rows out by key, sorts each partition, which spills, and hands every key's rows as an iterator to a small
generator. Nothing of a key is held but what the generator itself keeps, so cost is linear and memory bounded however
many rows a key has. A recurrence is sequential, so one key is one stream.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice, starmap

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shipping import ship_package

BATCH = 10_000


def fold(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterable], Iterator[tuple]], out: str, backwards: bool = False) -> DataFrame:
    """The keys and what ``run`` yields for each key's rows in ``order``: tuples of ``out``, a schema. Rows have the columns but the keys by name."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    ordered = rows.select(*keys, *order, *rest).repartition(*keys).sortWithinPartitions(*keys, *[F.desc(c) if backwards else F.asc(c) for c in order])
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(out).fields])
    names, n = [*order, *rest], len(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("row", names)  # noqa: PYI024
        kinds = to_arrow_schema(schema)
        values = (v for batch in batches for v in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = ((*key, *made) for key, own in groupby(values, key=lambda v: v[:n]) for made in run(starmap(row, (v[n:] for v in own))))
        while part := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    ship_package(rows.sparkSession)
    return ordered.mapInArrow(stream, schema)
