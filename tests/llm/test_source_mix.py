"""The mix of sources against one block after the other, with a heap of quotients."""

import heapq
import os
import random
import re
import struct
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from segloom.llm import source_mix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string"
NAMES = ["doc_id", "size", "source_size", "target", "taken"]


def seeded(doc_id, text):
    h = xxhash.xxh64_intdigest(struct.pack("<i", source_mix.SEED), 42)
    for part in (" " if doc_id is None else str(doc_id), text or ""):
        h = xxhash.xxh64_intdigest(part.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def by_quotients(weights, seats):
    """The seats of each of ``weights`` (name: weight), one after the other."""
    quota = dict.fromkeys(weights, 0)
    queue = [(-w, name) for name, w in weights.items() if w > 0]
    heapq.heapify(queue)
    for _ in range(seats if queue else 0):
        _, name = heapq.heappop(queue)
        quota[name] += 1
        heapq.heappush(queue, (-weights[name] / (2 * quota[name] + 1), name))
    return quota


def expected(rows, block=source_mix.BLOCK, shards=source_mix.SHARDS):
    docs = [(doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), source, seeded(doc_id, text)) for doc_id, text, source in rows]
    size = defaultdict(int)
    for _, n, source, _ in docs:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:  # a source at a time
        open_weight = sum(weight[s] for s in order if s not in full)
        rate = (total - sum(3 * size[s] for s in full)) / open_weight if open_weight else 0.0
        over = [s for s in order if s not in full and rate * weight[s] > 3 * size[s]]
        if not over:
            break
        full.add(over[0])
    target = {s: float(3 * size[s]) if s in full else rate * weight[s] for s in order}
    quota = by_quotients({k: target[s] for k, s in enumerate(order)}, round(sum(target.values()) / block))
    out = []
    for k, s in enumerate(order):
        cells = defaultdict(list)
        for d in docs:
            if d[2] == s:
                cells[d[3] % shards].append(d)
        words = {c: sum(d[1] for d in own) for c, own in cells.items()}
        own_quota = by_quotients(words, quota[k])
        for c, own in cells.items():
            share = 3 * words[c] if target[s] >= 3 * size[s] else min(own_quota[c] * block, 3 * words[c])
            before = 0
            for doc_id, n, _, _ in sorted(own, key=lambda d: (d[3], d[1])):
                taken = share // words[c] * n + max(0, min(share % words[c] - before, n)) if words[c] else 0
                before += n
                out.append((doc_id, n, size[s], round(target[s], 6), taken))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_table(spark):
    rows = [tuple(r[c] for c in ("doc_id", "text", "source")) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    found = source_mix.op12_source_mix(spark, SF)
    assert found.columns == NAMES and got(found) == expected(rows)


@pytest.fixture
def odd():
    """A source with a third of the words, tiny ones, null, blank and long texts, repeated rows."""
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(0, 300), rng.choice(["big", "big", *(f"s{j}" for j in range(9)), None, "é", "Z", ""])) for k in range(200)]
    return [*rows, (300, None, "only null"), (301, " \n", "blank"), (302, "x", "tiny"), (303, "word " * 5000, "s1"), (None, "a b", None), (None, "a b", None), rows[3], rows[3]]


@pytest.mark.parametrize(("block", "shards"), [(8, 1024), (8, 2), (1, 1), (500, 3)])
def test_odd_rows(spark, odd, block, shards):
    docs = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS size", "'x' AS shard", "2 AS number", "3 AS words", "4 AS weight")
    assert got(source_mix.mixed(docs, block, shards)) == expected(odd, block, shards)


def test_near_targets(spark, odd):
    rows = source_mix.mixed(spark.createDataFrame(odd, SCHEMA)).collect()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[(r.source_size, r.target)] += r.taken
    for (_, target), words in taken.items():
        assert abs(words - target) <= 8 * 30


def test_seats(spark):
    """Very unequal weights, equal ones, none, and fewer seats than names."""
    rng = random.Random(1)
    groups = [([rng.randrange(1, 10**9) for _ in range(40)], 977), ([5] * 7, 3), ([0, 0], 4), ([10**12, 1, 1, 0], 1000), ([3], 17), ([1, 2, 3], 0)]
    rows = [(g, k, w, seats) for g, (weights, seats) in enumerate(groups) for k, w in enumerate(weights)]
    found = source_mix.apportion(spark.createDataFrame(rows, "grp int, name int, weight long, seats long")).collect()
    want = {(g, k): n for g, (weights, seats) in enumerate(groups) for k, n in by_quotients(dict(enumerate(weights)), seats).items()}
    assert {(r.grp, r.name): r.quota for r in found} == want


def test_empty(spark):
    assert source_mix.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(source_mix.mixed(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
