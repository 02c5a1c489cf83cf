"""What a task holds at a time, beside its results."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segloom.llm import common, lm_scoring, simhash


def test_batches_are_bounded_by_bytes(spark):
    wide = spark.range(0, 4000, 1, 1).select(F.array_repeat("id", 1000).alias("x"))  # 32 MB in one task

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = common.map_arrow(wide, run, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) <= (8 << 20) + 20_000


def test_sketches_of_many_hashes_are_made_in_slices():
    sizes = [1000] * 300 + [0, 200_000, 0, 5]
    hashes = np.random.default_rng(0).integers(-(2**63), 2**63, sum(sizes))
    tracemalloc.start()
    simhash.fingerprints_of(hashes, np.cumsum(sizes))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # 160 MB when 500,000 were counted at a time
    tracemalloc.stop()
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes))], names=["hashes"])
    slices = [simhash.list_values(part.column("hashes")) for part in simhash.list_slices(iter([batch]), "hashes")]
    assert [len(values) for values, _ in slices if len(values) > 60_000] == [pytest.approx(200_000, abs=60_000)]
    for found, whole in zip(zip(*[simhash.sketches_of(*part) for part in slices], strict=True), simhash.sketches_of(hashes, np.cumsum(sizes)), strict=True):
        assert np.array_equal(np.concatenate(found), whole)


def test_pairs_of_dense_buckets_come_in_parts():
    n = 3000
    parts = simhash.near_pairs(np.zeros((n, 1), dtype=np.uint64), np.zeros(n, dtype=np.int64), 3)
    sizes = [len(a) for a, _, _ in parts]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= 50_000 * 64  # all 4.5 million at once before


def test_few_links_take_few_partitions(spark):
    """Rounds over a handful of links write no file for each shuffle partition: 1,600 files before, of 64 partitions."""
    links = [(k, k + 1) for k in range(0, 20)] + [(100, 200), (200, 300), (7, 400)]
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = lambda: {f for f in folder.rglob("part-*") if not f.name.startswith(".")}
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        there = files()
        found = simhash.components(spark.createDataFrame(links, "a bigint, b bigint"))
        made = len(files() - there)
        assert {r.node: r.root for r in found.collect()} == {k: 0 for k in [*range(21), 400]} | {k: 100 for k in (100, 200, 300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made <= 64 + 4 * 4 * 10  # those of the links, then one a core in each table of a round


def test_many_rows_keep_their_partitions(spark):
    assert common.narrowed(spark.range(0, 100, 1, 64), 1_000_001).rdd.getNumPartitions() == 64
    assert common.narrowed(spark.range(0, 100, 1, 64), 1_000_000).rdd.getNumPartitions() == 4


def test_scores_of_few_texts_take_few_files(spark):
    """Tables of words and neighbours, and what is returned, in 64 partitions each before."""
    docs = spark.createDataFrame([(k, f"the cat {k} sat on mat {k % 7} again and again") for k in range(40)], "doc_id bigint, text string")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = lambda: {f for f in folder.rglob("part-*") if not f.name.startswith(".")}
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        there = files()
        found = lm_scoring.score(docs, lm_scoring.model_path())
        assert found.rdd.getNumPartitions() <= 4 and len(files() - there) <= 3 * 4
        assert found.count() == 40 and found.where("score < 0 AND base_score < 0 AND n_known <= n_tokens").count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
