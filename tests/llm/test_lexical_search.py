"""Ranked search against scores of every document, on whole tables and on odd rows, whatever the tiers."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from segloom.llm import lexical_search

SF = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=20):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms if n_terms else 0
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture
def odd():
    """Copies in a large group, ties, nulls, blanks, a long text, terms of other scripts, terms in every document."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "日本", "ß1", "a-b", "x y"]
    make = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 64)] for _ in range(n))
    copy = "every w50 w51 w52 copy"
    docs = [*[(k, "every " + make(rng.randrange(1, 60))) for k in range(150)], *[(1000 + k, copy) for k in range(60)], (None, copy), (None, "w3"), (7, None), (8, ""), (9, " -- "), (2000, "w40 " * 300_000 + "w41"), (3, "w3"), (3, "w3")]
    items = [*[(k, make(rng.randrange(1, 12))) for k in range(12)], (20, copy), (20, copy), (20, "W50, w50!"), (21, None), (22, "--"), (23, "unknown"), (24, "every"), (None, "w41 w40")]
    return docs, items


@pytest.mark.parametrize("tiers", [(), (0.05, 0.3), (0.5,), (0.0, 0.2, 0.4, 0.9), (1.0,)])
def test_odd_rows(spark, odd, tiers):
    docs, items = odd
    index_of = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS row", "2 AS n", "'x' AS terms_0", "0 AS item")
    (block,) = lexical_search.blocks_of(spark.createDataFrame(items, ITEMS).selectExpr("*", "'y' AS terms"))
    index = lexical_search.build(index_of, block.terms, tiers)
    assert got(lexical_search.search(index, block)) == expected(docs, items)


def test_proofs(spark):
    """Items of rare terms are proven at the first tier, one of a frequent term falls through; both are exact."""
    rng = random.Random(2)
    docs = [(k, " ".join(["common"] * (k % 7 + 1) + [f"filler{rng.randrange(30)}" for _ in range(30)] + [f"rare{k % 5}"] * (1 + k % 3) * (k < 150))) for k in range(600)]
    items = [(0, "rare1 rare2"), (1, "common filler1 filler2 filler3")]
    (block,) = lexical_search.blocks_of(spark.createDataFrame(items, ITEMS))
    index = lexical_search.build(spark.createDataFrame(docs, DOCS), block.terms, (0.15, 0.5))
    assert got(lexical_search.search(index, block)) == expected(docs, items)
    assert 1 <= sum(index.proven) < 2


def test_blocks(spark, odd):
    docs, items = odd
    assert len(list(lexical_search.blocks_of(spark.createDataFrame(items, ITEMS), 30))) > 1
    assert got(lexical_search.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_terms=30)) == expected(docs, items)


def test_empty(spark, odd):
    docs, items = (spark.createDataFrame(x, kind) for x, kind in zip(odd, (DOCS, ITEMS), strict=True))
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_table(spark):
    read = lambda t, *c: [tuple(r[x] for x in c) for r in pq.read_table(f"{SF}/{t}.parquet").to_pylist()]
    found = got(lexical_search.op13_lexical_search(spark, SF))
    assert found == expected(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert found == sorted(con.execute(lexical_search.OP13_SQL).fetchall(), key=str)
