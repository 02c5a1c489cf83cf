"""The numbered queries on whole small tables, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash

from segloom.llm import decontaminate, lm_scoring, piece_coding, quality_model, quality_rules, secret_scan, simhash, token_counts

from .test_operators import WORD, leaked, words

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(sf, table="documents"):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def test_fingerprints(spark):
    prints = {}
    for r in rows(SF):
        w = words(r["text"])
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else [], dtype=np.uint64)
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 3) for v in values]
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", ids[label[k]]) for k, i in enumerate(ids)}


def test_base_scores(spark):
    docs = rows(SMALL)
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1
    counts = Counter(w for r in docs if not held(r) for w in [*words(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for r in docs:
        tokens = [*words(r["text"]), None]
        want[r["doc_id"]] = (held(r), len(tokens), sum(counts[t] > 0 for t in tokens), n, pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    got = lm_scoring.op2_lm_scoring(spark, SMALL).collect()
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_secrets(spark):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
    want = {}
    for r in rows(SF):
        text = r["text"] or ""
        base = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        n = Counter(s[0] for s in base)
        want[r["doc_id"]] = (n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.op3_secret_scan(spark, SF).collect()} == want


def test_round_trips(spark):
    got = piece_coding.op4_piece_coding(spark, SF).collect()
    assert len(got) == len(rows(SF)) and all(r.round_trip for r in got)


def test_counts_of_tokens(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_coding.model_path())
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in rows(SF)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.op5_token_counts(spark, SF).collect()} == want


def test_counts_of_rules(spark):
    want = {}
    for r in rows(SF):
        text = r["text"] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = len({i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})
        want[r["doc_id"]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, len(w) < 50 or 100 * repeated > 50 * len(w))
    got = quality_rules.op6_quality_rules(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows(SF, "labels")}
    got = [(r.score, labels[r.doc_id]) for r in quality_model.op8_quality_model(spark, SF).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in got if y == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_leaks(spark):
    items, docs = rows(SMALL, "benchmark"), rows(SMALL)
    want = {(r["doc_id"], i["item_id"]): n for r in docs for i in items if (n := leaked(r["text"], i["text"]))}
    got = {(r.doc_id, r.item_id): r.n_covered for r in decontaminate.op10_decontaminate(spark, SMALL).collect()}
    assert got == want


def test_stages(spark):
    """Each stage's decisions on the smallest table, from the operator's own verdicts or by brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counted = quality_rules.with_counts(docs)
    kept = {r.doc_id for r in quality_rules.judge(counted, quality_rules.fit(counted), min_words=0).collect() if r.kept}
    assert {r.doc_id for r in quality_rules.stage(spark, docs, SMALL).collect()} == kept and 100 < len(kept) < docs.count()
    items = rows(SMALL, "benchmark")
    clean = {r["doc_id"] for r in rows(SMALL) if not any(leaked(r["text"], i["text"]) for i in items)}
    assert {r.doc_id for r in decontaminate.stage(spark, docs, SMALL).collect()} == clean
    texts = {r["doc_id"]: words(r["text"]) for r in rows(SMALL)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in texts.items()}
    label = {k: k for k in sets}
    near = {k: [j for j in sets if j == k or (sets[j] and 9 * len(sets[j] & sets[k]) >= 4 * (len(sets[j]) + len(sets[k])))] for k in sets}
    for _ in range(10):
        label = {k: min(label[j] for j in near[k]) for k in sets}
    blank = [k for k in sets if not sets[k]]
    got = {r.doc_id for r in simhash.stage(spark, docs, SMALL).collect()}
    assert got - set(blank) == {k for k in sets if label[k] == k} - set(blank)
    library = token_counts.count_tokens(docs, piece_coding.model_path()).select("doc_id", "n_chars").count()
    coded = piece_coding.decode(piece_coding.stage(spark, docs, SMALL), piece_coding.model_path()).collect()
    assert len(coded) == library and all(r.decoded == (r.text or "").replace("▁", " ") and r.n_pieces == len(r.piece_ids) for r in coded)
