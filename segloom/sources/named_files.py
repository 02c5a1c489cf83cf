"""Text files under names of their own, many or one a row, all of them or none: a data source that is only written to; and
files below a folder, found and read by tasks.

Tasks write below a hidden folder of the job, which an abort removes. Once all have written, that folder gets the path's name
if there is nothing yet. Else tasks move what it holds, level by level: a folder goes whole where none of its name is, else by
what it holds in turn. Files are found in the same way, so that the driver sees no names, however many there are. Any file
system that Arrow opens by URI will do; a local folder is listed as a stream.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..plans.shared import checkpoint
from ..plans.shipping import ship_package

#: Rows and bytes at which a batch is closed.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
#: Something below a folder: its name from there, which begins with a slash, and whether it is a folder itself.
PLACE = "name STRING, folder BOOLEAN"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class NamedFiles(DataSource):
    """Options: path, job (the hidden folder). Columns: name, which may have folders before it, and value."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options["job"], schema.names.index("name"), schema.names.index("value"))


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, job: str, name_at: int, value_at: int):
        self.path, self.job, self.name_at, self.value_at = path, job, name_at, value_at

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        files, _ = file_system(self.path)
        for row in iterator:
            name = row[self.name_at]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name of a file below {self.path}")
            target, own = f"{self.job}/files/{name}", f"{self.job}/{uuid.uuid4().hex}"
            # an attempt again writes the same; a file has its name only when it is whole
            files.create_dir(target.rpartition("/")[0], recursive=True)
            with files.open_output_stream(own) as out:
                out.write((row[self.value_at] or "").encode())
            files.move(own, target)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All is written and nothing has its name yet: tasks see to that, see write_named_files."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        drop_folder(file_system(self.path)[0], self.job)


def is_gone(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.NotFound


def drop_folder(files: fs.FileSystem, folder: str) -> None:
    if not is_gone(files, folder):
        files.delete_dir(folder)


def children(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """What lies in a folder, and whether it is a folder; nothing where the folder has gone."""
    if not isinstance(files, fs.LocalFileSystem):
        yield from ((f.base_name, f.type == fs.FileType.Directory) for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
    elif os.path.isdir(folder):
        with os.scandir(folder) as entries:
            yield from ((e.name, e.is_dir()) for e in entries)


def _batches(places: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(places, BATCH_ROWS)):
        names, folders = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_())], names=["name", "folder"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
    for batch in batches:
        yield from zip(batch.column("name").to_pylist(), batch.column("folder").to_pylist(), strict=True)


def levels(spark: SparkSession, path: str, top: str, step: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What lies below ``top`` (PLACE), a folder of the path's file system, level by level, as far as ``step`` leaves it: the next level is what the folders among that hold.

    Tasks list the folders, and ``step``, which gets each name once, has them dealt over all cores.
    """
    ship_package(spark)
    cores, level, found = spark.sparkContext.defaultParallelism, spark.createDataFrame([("", True)], PLACE), []

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(path)
        yield from _batches((f"{name}/{child}", folder) for name, _ in _places(batches) for child, folder in children(files, top + name))

    while not level.isEmpty():
        inside = level.repartition(cores, "name").mapInArrow(listed, PLACE)
        found.append(checkpoint(step(inside.repartition(cores, "name"))))
        level = found[-1].where("folder")
    return found


def moved(files: fs.FileSystem, source: str, target: str, folder: bool) -> bool:
    """Gives a file or a whole folder its name; False for a folder that has to be moved by what it holds."""
    if folder and not is_gone(files, target):
        return False
    try:
        files.move(source, target)
    except (OSError, pa.ArrowException):
        if is_gone(files, source):  # an earlier attempt moved it
            return True
        if not folder:
            raise
        files.create_dir(target)  # stores move no folders
        return False
    return True


def removed(files: fs.FileSystem, path: str, folder: bool) -> None:
    try:
        (files.delete_dir if folder else files.delete_file)(path)
    except (OSError, pa.ArrowException):
        if not is_gone(files, path):  # else an earlier attempt removed it
            raise


def write_named_files(rows: DataFrame, path: str, append: bool = False) -> None:
    """Each row's ``value`` as the file ``name`` below ``path``; other files there go, unless ``append``, which replaces only files of a name."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    files, base = file_system(path)
    base, hidden = base.rstrip("/"), f"_job-{uuid.uuid4().hex}"
    new = is_gone(files, base)
    job = base[: base.rfind("/") + 1] + hidden if new else f"{base}/{hidden}"
    staged = f"{job}/files"

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(path)
        for name, folder in _places(batches):
            if name != f"/{hidden}":
                removed(own, base + name, folder)
        yield from _batches(iter(()))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(path)
        yield from _batches((name, folder) for name, folder in _places(batches) if not moved(own, staged + name, base + name, folder))

    rows.select("name", "value").write.format("named_files").option("path", path).option("job", job).mode("append").save()
    try:
        if not new and not append:
            levels(spark, path, base, lambda found: found.mapInArrow(clear, PLACE))
        if not moved(files, staged, base, True):
            levels(spark, path, staged, lambda found: found.mapInArrow(move, PLACE))
        files.create_dir(base)  # there were no rows
    finally:
        drop_folder(files, job)


def spark_folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """A folder as Spark's paths of its files begin, and as ``file_system`` takes it; None for a pattern, a file, or what Arrow doesn't find."""
    if re.search(r"[*?\[{\\]", path):
        return None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    place = whole.removeprefix("file:")
    try:
        files, base = (fs.LocalFileSystem(), place) if place.startswith("/") else file_system(place)
        return (whole, place) if files.get_file_info(base).type == fs.FileType.Directory else None
    except (OSError, pa.ArrowException):
        return None


def read_files(spark: SparkSession, folder: tuple[str, str]) -> DataFrame:
    """path, as Spark writes it, and value, as text (null where it is none in UTF-8, -16 or -32), of each file below a folder that
    ``spark_folder`` gave. As for Spark's readers, what begins with a dot or an underscore isn't there, and files are unpacked by their name's end."""
    whole, place = folder
    top = file_system(place)[1].rstrip("/")
    own = F.element_at(F.split("name", "/"), -1)
    hidden = own.startswith(".") | (own.startswith("_") & ~own.contains("=")) | own.endswith("._COPYING_")
    found = functools.reduce(DataFrame.union, levels(spark, place, top, lambda rows: rows.where(~hidden))).where("NOT folder").select("name")

    def text(value: bytes) -> str | None:
        try:
            return value.decode(json.detect_encoding(value))
        except UnicodeDecodeError:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(place)
        made = lambda paths, values: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["path", "value"])
        for batch in batches:
            paths, values, size = [], [], 0
            for name in batch.column("name").to_pylist():
                if name.endswith((".deflate", ".snappy")):
                    raise ValueError(f"{whole}{name} is packed in a way that Arrow doesn't know")
                with files.open_input_stream(top + name) as stream:
                    value = stream.read()
                # Spark's paths are URIs
                paths.append(re.sub(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\x9f]""", lambda m: quote(m[0]), whole + name))
                values.append(text(value))
                size += len(value)
                if size >= BATCH_BYTES:
                    yield made(paths, values)
                    paths, values, size = [], [], 0
            yield made(paths, values)

    return found.mapInArrow(read, "path STRING, value STRING")
