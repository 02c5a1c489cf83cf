"""Columns and helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.plans.shipping import ship_package

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def split_words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; an empty array for none. ``text`` isn't null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes of an Arrow batch at which it is closed, where the session has no value of its own; Spark's default is 64 MB, of
#: which a task has several copies on both sides of the pipe.
BATCH_BYTES, BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors, in batches of BATCH_BYTES and the rest of the last row at most."""
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, source: str, made: Callable[[pa.Array], list[pa.Array]], more: dict[str, T.DataType], cut: Callable, keep: bool = True) -> DataFrame:
    """``df`` with the columns ``more``, which ``made`` makes of arrays of ``source``; ``cut`` gives it smaller batches.

    Columns go through Python by number, so they may have any names; columns with the names of results are replaced.
    """
    plain = df.select(*[quoted(c) for c in df.columns if c not in more])
    names = plain.columns
    numbered = plain.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(source)}"
    kept = [i for i in range(len(names)) if keep or names[i] != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, own):
            columns = [*(batch.column(i) for i in kept), *made(batch.column(own))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"o{i}" for i in range(len(columns))])

    kinds = [*(numbered.schema[i].dataType for i in kept), *more.values()]
    schema = T.StructType([T.StructField(f"o{i}", kind) for i, kind in enumerate(kinds)])
    return map_arrow(numbered, run, schema).toDF(*[names[i] for i in kept], *more)


def slices(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches' rows again, as slices with ``most`` bytes of ``text`` and the rest of the last text at most.

    Arrow batches are bounded by BATCH_BYTES only, so whoever builds more arrays by the byte takes these.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # every row counts a little, so that empty texts don't gather without end
        block = (np.cumsum(sizes + 64) - sizes - 64) // most
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):  # noqa: B905
            yield batch.slice(begin, end - begin)


def own_columns(df: DataFrame, struct: str = "__own") -> Column:
    """All columns of ``df`` in one struct, out of the way of an operator's own names; ``<struct>.*`` gives them back."""
    return F.struct(*[quoted(c) for c in df.columns]).alias(struct)


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read from there."""
    spark = df.sparkSession
    shared_folder(spark)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder, and read from there: smaller than a checkpoint.

    Results are read from such tables, so they go when the application ends.
    """
    spark = df.sparkSession
    shared_folder(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder}/segloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> None:
    """Leaves spark.checkpoint.dir as it is; where it is unset, one machine takes a temporary folder, and a cluster is refused."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="segloom-"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that of a large one."""
    return df.limit(rows + 1).count() <= rows


#: Rows of a few numbers each up to which a table gets by with one partition a core.
FEW_ROWS = 1_000_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in one partition a core at most, if it comes from few ``rows``; else with the partitions of its shuffle.

    A partition costs files in each shuffle and checkpoint and a task, whether it has rows or not.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if rows <= FEW_ROWS else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
