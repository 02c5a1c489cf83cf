"""Databases, named files, versions, appended batches and fallbacks: what happens when something fails or comes twice."""

import os
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from segloom.operators import plugs, versions
from segloom.plans import runner
from segloom.sources import databases, named_files, transcripts
from segloom.streaming import sinks


@pytest.fixture
def database(tmp_path):
    file = str(tmp_path / "a db?.sqlite")
    con = sqlite3.connect(file)
    con.execute('CREATE TABLE "my tasks" (id INTEGER PRIMARY KEY, "the url" TEXT, score REAL, data BLOB)')
    con.executemany('INSERT INTO "my tasks" VALUES (?, ?, ?, ?)', [(k * 3 - 50, f"v{k}" if k % 4 else None, k / 2, bytes([k])) for k in range(100)])
    con.execute('UPDATE "my tasks" SET score = \'high\' WHERE id = 1')
    con.execute("CREATE TABLE plain (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.execute("INSERT INTO plain VALUES ('a', 1), ('b', 2)")
    con.execute("CREATE TABLE hollow (x INT)")
    con.commit()
    con.close()
    return file


def test_scan(spark, database):
    df = databases.read_sqlite(spark, database, "my tasks", 4)
    assert df.dtypes == [("id", "bigint"), ("the url", "string"), ("score", "double"), ("data", "binary")] and df.rdd.getNumPartitions() == 4
    want = [(k * 3 - 50, f"v{k}" if k % 4 else None, None if k * 3 - 50 == 1 else k / 2, bytes([k])) for k in range(100)]
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in df.collect()) == want
    assert {r.id for r in df.where("`the url` IN ('v1', 'v5', 'v8') AND id > -45").collect()} == {-35}
    assert df.where("`the url` IS NULL").count() == 25 and df.where("score IS NULL").count() == 1
    assert databases.read_sqlite(spark, database, "my tasks", columns=["id"]).agg(F.sum("id")).first()[0] == sum(w[0] for w in want)
    assert sorted(tuple(r) for r in databases.read_sqlite(spark, database, "plain", 3).collect()) == [("a", 1), ("b", 2)]
    assert databases.read_sqlite(spark, database, "hollow", 3).count() == 0
    with pytest.raises(Exception, match="no table"):
        databases.read_sqlite(spark, database, "none").count()


def test_filters_spare_rows(database):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("the url", T.StringType())])
    read = lambda *filters: (r := databases.SqliteReader(database, "my tasks", 3, schema), list(r.pushFilters(list(filters))), sum(b.num_rows for p in r.partitions() for b in r.read(p)))[2]
    assert read() == 100
    assert read(GreaterThan(("id",), 100)) == 49
    assert read(EqualTo(("the url",), "v7")) == 1
    assert read(In(("id",), (1, 4, 5)), GreaterThan(("id",), 1)) == 1


def test_written_database(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS name", "id / 2 AS half", "id % 2 = 0 AS even").repartition(3)
    path = f"file://{tmp_path}/db"
    databases.write_sqlite(rows, path, "t")
    databases.write_sqlite(rows.where("id < 10"), path, "t", append=True)
    assert databases.read_sqlite(spark, path, "t", 6).agg(F.count("*"), F.sum("id"), F.sum("half"), F.sum("even")).first() == (1010, 499545, 249772.5, 505)
    bad = rows.withColumn("name", F.when(F.col("id") == 700, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        databases.write_sqlite(bad, path, "t")
    assert databases.read_sqlite(spark, path, "t", 6).count() == 1010 and all(f.endswith(".sqlite") for f in os.listdir(tmp_path / "db"))
    databases.write_sqlite(rows.where("id < 5"), path, "t")
    assert databases.read_sqlite(spark, path, "t").count() == 5


def test_named_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    named = lambda *rows: spark.createDataFrame(rows, "name string, value string")
    listed = lambda: {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file()}
    named_files.write_named_files(named(("a.txt", "1"), ("d/b.txt", "zwei\n"), ("d/e/c", None)), path)
    assert listed() == {"a.txt": "1", "d/b.txt": "zwei\n", "d/e/c": ""}
    named_files.write_named_files(named(("a.txt", "new"), ("x", "y")), path, append=True)
    assert listed() == {"a.txt": "new", "d/b.txt": "zwei\n", "d/e/c": "", "x": "y"}
    with pytest.raises(Exception, match="no name of a file"):
        named_files.write_named_files(named(("good", "1"), ("../bad", "2")), path, append=True)
    assert "good" not in listed() and len(listed()) == 4
    named_files.write_named_files(named(("only", "1")), path)
    assert listed() == {"only": "1"}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/tables"
    one = lambda n: spark.range(n).withColumnRenamed("id", "k")
    counts = lambda: {t: df.count() for t, df in versions.read_tables(spark, path).items()}
    assert versions.current(spark, path) == 0 and counts() == {}
    assert versions.write_tables(spark, path, {"tasks": one(3), "stages": one(9)}) == 1
    broken = one(5).withColumn("k", F.when(F.col("k") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        versions.write_tables(spark, path, {"tasks": one(5), "stages": broken})
    assert counts() == {"tasks": 3, "stages": 9}
    assert versions.write_tables(spark, path, {"tasks": one(4)}) == 2 and counts() == {"tasks": 4, "stages": 9}
    with pytest.raises(versions.Conflict):
        versions.write_tables(spark, path, {"tasks": one(7)}, base=1)
    assert counts() == {"tasks": 4, "stages": 9}
    assert versions.read_tables(spark, path, 1)["tasks"].count() == 3
    assert versions.vacuum(spark, path) and counts() == {"tasks": 4, "stages": 9} and len([f for f in os.listdir(path) if not f.startswith(".")]) == 3


def test_batch_again(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "k")
    (tmp_path / "in").mkdir()
    rows.where("k < 12").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    start = lambda: sinks.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    start()
    rows.where("k >= 12").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    start()
    # as if the driver had been lost between the batch's rows and its commit: the batch comes again
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()
    start()
    found = sinks.read_appended(spark, f"{tmp_path}/out")
    assert sorted(r.k for r in found.collect()) == list(range(20)) and found.select("batch").distinct().count() == 2


class Strict:
    """Refuses some texts; counts its calls."""

    def __init__(self, bad):
        self.bad, self.calls = bad, 0

    def load(self):
        pass

    def dispose(self):
        pass

    def generate(self, rows):
        self.calls += 1
        if rows["text"].isin(self.bad).any():
            raise ValueError("refused")
        return rows.assign(out=rows["text"] + "!")


@pytest.mark.parametrize("bad", [[], ["t500"], ["t0", "t999"], ["t7", "t8", "t9"]])
def test_only_failing_rows_fall_back(bad):
    model, rows = Strict(bad), pd.DataFrame({"text": [f"t{k}" for k in range(1000)]})
    made = pd.concat(plugs._made(model, rows, 2, lambda r: r.assign(out=r["text"])), ignore_index=True)
    assert list(made["out"]) == [t if t in bad else t + "!" for t in rows["text"]]
    assert model.calls <= 1 + 2 * 22 * len(bad)


def test_fallback_in_tasks(spark):
    rows = spark.range(100).selectExpr("id AS session_id", "1 AS seg_idx", "repeat('x', CAST(id AS INT)) AS text")
    got = {r.session_id: (r.dst, r.fell_back) for r in plugs.translate(rows, plugs.backend("bracketer", refuses=3)).collect()}
    assert got == {k: ("x" * k, True) if k % 10 == 3 else (f"[{'x' * k}]", False) for k in range(100)}
    with pytest.raises(ValueError, match="no backend 'other'"):
        plugs.backend("other")
    with pytest.raises(Exception, match="refused"):
        plugs.apply_model(rows.select("text"), plugs.backend("bracketer", refuses=3), "text string").count()


def test_retry(spark):
    class Flaky(Strict):
        def generate(self, rows):
            self.calls += 1
            if self.calls % 2:
                raise OSError("for now")
            return rows.assign(out=rows["text"] + "!")

    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    assert sorted(r.out for r in plugs.apply_model(rows, lambda: Flaky([]), "text string, out string", attempts=2).collect()) == ["a!", "b!"]


def test_corrupt_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"result": {"segments": [{"text": "a", "start": 0, "end": 1}]}}')
    (tmp_path / "bad.json").write_text('{"result": {"segm')
    rows = transcripts.read_transcripts(spark, str(tmp_path)).select("path", "corrupt", "result").collect()
    assert {r.path.rpartition("/")[2]: r.corrupt for r in rows} == {"good.json": None, "bad.json": '{"result": {"segm'}


def test_runner(spark, tmp_path):
    path, calls = f"{tmp_path}/run", []

    def stage(name, *inputs, fails=()):
        def make(tables):
            calls.append(name)
            if name in fails:
                raise OSError("lost")
            return tables[inputs[0]].withColumn(name, F.lit(len(inputs)))

        return runner.Stage(name, inputs, make)

    source = {"asr": spark.range(3), "video": spark.range(2)}
    chain = lambda *fails: [stage("fix", "asr"), stage("ocr", "video"), stage("both", "fix", "ocr", fails=fails), stage("end", "both")]
    with pytest.raises(runner.StageFailed) as failed:
        runner.run(spark, path, chain("both"), source, {"asr": "1", "video": "1"}, attempts=2)
    assert failed.value.outcomes == {"fix": "made", "ocr": "made", "both": "failed"} and calls == ["fix", "ocr", "both", "both"]
    go = lambda **marks: list(runner.run(spark, path, chain(), source, marks).values())
    assert go(asr="1", video="1") == ["fresh", "fresh", "made", "made"]
    assert go(asr="1", video="1") == ["fresh"] * 4
    assert go(asr="1", video="2") == ["fresh", "made", "made", "made"]
    assert versions.read_tables(spark, path)["end"].columns == ["id", "fix", "both", "end"]
