"""Joins and merges of sessions with broken ends and with very many rows."""

import random

import pytest
from pyspark.sql import functions as F

from segloom.operators import folds, intervals, islands

SEGMENTS = "session_id string, seg_idx int, text string, start_ms bigint, end_ms bigint"
NEVER = 4 * 10**14


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)

    def made(n):
        rows, at = [], 0
        for i in range(n):
            at += rng.choice([0, 200, 5000, 400_000])
            rows.append(("s", i, rng.choice(["ab", "abc", "b", "xyz"]), at, at + rng.choice([500, 1500, 4000, 9_000_000])))
        rows[n // 3] = (*rows[n // 3][:4], NEVER)
        rows[n // 2] = (*rows[n // 2][:4], rows[n // 2][3] - 5)
        return rows

    a, b = made(60), made(70)
    return a, b, spark.createDataFrame(a, SEGMENTS), spark.createDataFrame(b, SEGMENTS)


def meets(x, y, before=0, after=0, closed=False):
    if x[4] < x[3] or y[4] < y[3]:
        return False
    low, high = y[3] - before, y[4] + after
    return x[3] <= high and low <= x[4] if closed else x[3] < high and low < x[4]


def overlap(x, y):
    return min(x[4], y[4]) - max(x[3], y[3])


def test_best_match(sides):
    a, b, left, right = sides
    iou = lambda x, y: overlap(x, y) / (max(x[4], y[4]) - min(x[3], y[3])) if meets(x, y) and overlap(x, y) > 0 else 0
    want = {x[1]: max(((iou(x, y), -y[1]) for y in b if iou(x, y) > 0), default=None) for x in a}
    got = {r.seg_idx: None if r.hyp_idx is None else (pytest.approx(r.iou), -r.hyp_idx) for r in intervals.best_match(left, right).collect()}
    assert got == want


def test_missed_and_false(sides):
    a, b, left, right = sides
    lone = lambda xs, ys: {x[1] for x in xs if not any(meets(x, y) and overlap(x, y) > 0 for y in ys)}
    assert {r.seg_idx for r in intervals.missed(left, right).collect()} == lone(a, b)
    assert {r.seg_idx for r in intervals.false_positives(left, right).collect()} == lone(b, a)


def test_overlap_text_match(sides):
    a, b, left, right = sides

    def alike(s, t):
        short, long = (s, t) if len(s) <= len(t) else (t, s)
        return short in long or 2 * sum(c in long for c in short) >= len(short)

    want = {x[1]: best[1] for x in a if (best := max(((overlap(x, y), -y[1]) for y in b if meets(x, y) and overlap(x, y) > 0 and alike(x[2], y[2])), default=None))}
    assert {r.seg_idx: -r.match_idx for r in intervals.overlap_text_match(left, right).collect()} == want


def test_fusions(sides):
    """The parts before merging, which is tested by itself."""
    a, b, left, right = sides
    n = lambda df: df.agg(F.sum("n_merged")).first()[0]
    covered = [y for y in b if any(meets(y, x, 0, 500, True) and x[3] <= y[3] and x[4] >= y[4] - 500 for x in a)]
    assert n(intervals.fusion_union(left, right)) == len(a) + len(b) - len(covered)
    short = [y for y in b if y[4] - y[3] <= 2000]
    alike = [y for y in short if any(meets(y, x, 0, 0, True) and (x[2] in y[2] or y[2] in x[2]) for x in a)]
    assert n(intervals.fusion_short(left, right)) == len(a) + len(short) - len(alike)
    pieces = 0
    for x in a:
        cuts, at = sorted((y[3], y[1], y[4]) for y in b if meets(x, y, 1, 1) and y[3] >= x[3] and y[4] <= x[4] and y[2] != x[2]), x[3]
        for s, _, e in cuts:
            pieces += 1 + (s > at)
            at = e
        pieces += at < x[4]
    assert n(intervals.fusion_split(left, right)) == pieces


def test_recalled(sides):
    a, b, left, right = sides
    want = {x[1] for x in a if any(meets(x, y, 1000, 1000, True) and (set(x[2]) & set(y[2]) or len(x[2]) < 3) for y in b)}
    assert {r.seg_idx for r in intervals.recalled(left, right).collect()} == want


def test_without_noise(sides):
    a, _, left, _ = sides
    frames = lambda i: (i * 7) % 40
    inside = lambda x, y: meets(x, y, 0, 0, True) and y[3] <= x[3] and y[4] >= x[4] and x[2] in y[2] and frames(y[1]) > 2 * frames(x[1])
    want = {x[1] for x in a if not any(x[1] != y[1] and inside(x, y) for y in a)}
    assert {r.seg_idx for r in intervals.without_noise(left.withColumn("frames", (F.col("seg_idx") * 7) % 40)).collect()} == want


@pytest.mark.parametrize("cell", [intervals.CELL_MS, 1])
def test_nearest(sides, monkeypatch, cell):
    """Ties, equal starts, cells of any width."""
    monkeypatch.setattr(intervals, "CELL_MS", cell)
    a, b, left, right = sides
    near = lambda x, ys: min(((abs(x[3] - y[3]), y[1]) for y in ys if abs(x[3] - y[3]) <= 4000), default=None)
    got = {r.seg_idx: None if r.near_idx is None else (r.dist, r.near_idx) for r in intervals.nearest_start(left, right).collect()}
    assert got == {x[1]: near(x, b) for x in a} and None in got.values()
    even = [x for x in a if x[1] % 2 == 0]
    want = {}
    for x in a:
        one, two = near(x, b), near(x, even)
        want[x[1]] = one if one and (not two or one[0] <= two[0]) else two
    found = intervals.nearest_of_two(left, right, left.where("seg_idx % 2 = 0")).collect()
    assert {r.seg_idx: None if r.match_idx is None else (r.dist, r.match_idx) for r in found} == want


def test_two_hundred_thousand_rows(spark):
    """One session; every row is in the result, and what a row says doesn't depend on how many come after."""
    n = 200_000
    rows = spark.range(n).selectExpr("'s' AS session_id", "id AS seg_idx", "CASE WHEN id % 5 < 3 THEN 'same' ELSE 'other' END AS text", "id * 700 AS start_ms", "id * 700 + 650 AS end_ms", "700 AS dur_ms")
    merged = islands.merge_same_text(rows)
    assert merged.count() == 2 * n // 5 and merged.agg(F.sum("n_merged")).first()[0] == n
    assert folds.schedule(rows).where("actual_start >= seg_idx * 700").count() == n
    near = intervals.nearest_start(rows, rows.withColumn("start_ms", F.col("start_ms") + 300))
    assert near.where("near_idx = seg_idx AND dist = 300").count() == n
