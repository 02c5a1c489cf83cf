"""Named files whose names the driver never holds, and sessions' files read as Spark's own reader does."""

import gzip
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.sources import named_files, transcripts

INFO = "pipeline STRING, title STRING, k INT"


def files_below(path):
    return {str(f.relative_to(path)): f.read_text() for f in path.rglob("*") if f.is_file()}


def test_commit_holds_no_names(tmp_path):
    schema, path = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]), f"{tmp_path}/out"
    writer = named_files.NamedFiles({"path": path, "job": f"{tmp_path}/_job"}).writer(schema, True)
    message = writer.write((f"s{k}/info.json", "x") for k in range(2000))
    tracemalloc.start()
    writer.commit([message])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000


def test_driver_lists_no_files(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("s%s/info.json", "id").alias("name"), F.format_string('{"k": %s}', "id").alias("value"))
    named_files.write_named_files(rows, f"file://{tmp_path}/out")
    info = transcripts.session_info(spark, f"file://{tmp_path}/out", INFO)
    assert info.inputFiles() == []
    assert {(r.path, r.pipeline, r.k) for r in info.collect()} == {(f"file:{tmp_path}/out/s{k}/info.json", "dub", k) for k in range(300)}


def test_no_rows(spark, tmp_path):
    named_files.write_named_files(spark.createDataFrame([], "name string, value string"), f"{tmp_path}/out")
    assert transcripts.session_info(spark, f"{tmp_path}/out", INFO).collect() == []


@pytest.mark.parametrize("append", [False, True])
def test_over_other_files(spark, tmp_path, append):
    named = lambda *rows: spark.createDataFrame(rows, "name string, value string").repartition(3)
    path, old = f"{tmp_path}/out", {"a/b/c": "1", "a/b/d": "2", "a/e": "3", "f": "4", "g/h/i": "5"}
    named_files.write_named_files(named(*old.items()), path)
    (tmp_path / "out" / "hollow" / "deep").mkdir(parents=True)
    new = {"a/b/c": "new", "a/b/x/y": "new", "a/b2/c": "new", "hollow/z": "new", "hollow/deep/z": "new", "top": "new"}
    named_files.write_named_files(named(*new.items()), path, append=append)
    assert files_below(tmp_path) == {f"out/{k}": v for k, v in ((old | new) if append else new).items()}
    assert not [f for f in tmp_path.rglob("_job*")]


def test_nothing_of_a_failed_write_stays(spark, tmp_path):
    with pytest.raises(Exception, match="no name of a file"):
        named_files.write_named_files(spark.createDataFrame([("good", "1"), ("../bad", "2")], "name string, value string"), f"{tmp_path}/out")
    assert files_below(tmp_path) == {}


def test_read_as_by_spark(spark, tmp_path):
    odd = {
        "s 1/a b.json": b'{"title": "t", "pipeline": "subtitle"}', "s%202/x#?.json": '{"title": "\u00fc"}'.encode(), "s3/list.json": b'[{"title": "x", "k": 1}, {"title": "y", "k": "bad"}]', "s4/broken.json": b'{"title":',
        "s5/empty.json": b"", "s6/blank.json": b" \n\t\r", "s7/bom.json": b'\xef\xbb\xbf{"title": "b"}', "s8/wide.json": '{"title": "w"}'.encode("utf-16"), "s9/wide.json": '{"title": "v"}'.encode("utf-16-be"),
        "s10/bytes.json": b'{"title": "\xff\xfe"}', "s11/two.json": b'{"title": "1"} {"title": "2"}', "s12/packed.json.gz": gzip.compress(b'{"title": "z"}'), "s13/number.json": b"5", "s14/none.json": b"[]", "s15/null.json": b"null",
        "s16/nulls.json": b'[null, {"title": "y"}]', "s17/kinds.json": b'{"title": {"a":1}, "k": "x", "pipeline": null}', "_hidden/a.json": b'{"title": "h"}', "_k=1/a.json": b'{"title": "p"}', ".dot/a.json": b'{"title": "d"}',
        "s18/_a.json": b'{"title": "h"}', "s18/deep/er/a.json": b'{"title": "deep"}', "top.json": b'{"title": "top"}',
    }
    for name, value in odd.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(value)
    plain = spark.read.schema(INFO).option("multiLine", True).option("recursiveFileLookup", True).json(str(tmp_path))
    want = plain.select(F.coalesce("pipeline", F.lit("dub")), "title", "k", "_metadata.file_path")
    got = transcripts.session_info(spark, str(tmp_path), INFO)
    assert got.columns == ["pipeline", "title", "k", "path"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    # what is no string, in a column of strings, is written anew
    (tmp_path / "s17" / "kinds.json").write_text('{"title": {"a": 1.10}}')
    assert got.where("path LIKE '%/s17/%'").first().title == '{"a":1.1}'
    assert transcripts.session_info(spark, f"{tmp_path}/s1*", INFO).count() == plain.where("_metadata.file_path LIKE '%/s1%'").count()
