"""Conversation repair against a plain search over all edits, on whole tables and on odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from segloom.llm import conversation_repair as repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BARE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def best_edits(marked):
    """The least (cost, audit) by widening the reachable strings of initials row by row; ``marked``: role, must go, cut off."""
    at = {"": (0, "")}  # by the last two initials that matter: "", "s", "u", "a"

    def better(found, key, value):
        if key not in found or value < found[key]:
            found[key] = value

    def follows(last, new):
        return (last, new) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def inserted(found):
        for _ in range(4):
            for last, (cost, audit) in list(found.items()):
                for new in "ua":
                    if follows(last, new):
                        better(found, new, (cost + 2, audit + "I"))
        return found

    at = inserted(at)
    for role, must_go, cut in marked:
        found = {}
        for last, (cost, audit) in at.items():
            better(found, last, (cost + 3, audit + "D"))
            if not must_go:
                if role[:1] in ("s", "u", "a") and follows(last, role[:1]):
                    better(found, role[:1], (cost + cut, audit + "K"))
                for new in "ua":
                    if follows(last, new):
                        better(found, new, (cost + 2 + cut, audit + "R"))
        at = inserted(found)
    return min(at[k] for k in ("", "a") if k in at)


def expected(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damaged([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][: repair.HEAD], hashlib.md5(r[3].encode()).digest()))
        marked, seen, counts = [], set(), [0, 0, 0]
        for _, _, role, text in own:
            blank, again = not BARE.search(text), (role, text) in seen
            cut = not blank and not again and BARE.findall(text)[-1] not in ".!?"
            for k, yes in enumerate((blank, again and not blank, cut)):
                counts[k] += yes
            seen.add((role, text))
            marked.append((role, blank or again, cut))
        cost, audit = best_edits(marked)
        turns, result, last, k = [r[1] for r in own if r[1] is not None], [], "", 0
        for edit in audit:
            wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            role, text = (wanted, "") if edit == "I" else (own[k][2] if edit == "K" else wanted, own[k][3])
            k += edit != "I"
            if edit != "D":
                result.append(f"{role}:{text}")
                last = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        want[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest())
    return want


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_table(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert got(repair.op11_conversation_repair(spark, SF)) == expected(rows)


@pytest.fixture
def odd():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut", " \t", "", None, "Why?", "Da ist ", "long " * 3000 + "."]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(400)]
    return [*rows, *rows[:20], *[(99, k, ["user", "assistant"][(k // 7) % 2], f"{k % 50} done.") for k in range(300)]]


@pytest.mark.parametrize("chunk", [repair.CHUNK, 1, 7])
def test_odd_rows(spark, odd, chunk):
    """Nulls, ties, repeated rows, foreign roles and columns; the same whatever the chunk."""
    rows = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS at", "2 AS digest", "'x' AS gone", "role AS place")
    assert got(repair.summaries(repair.repaired(repair.damage(repair.plain(rows)), chunk))) == expected(odd)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_dropped_whole(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = repair.damage(repair.plain(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)))
    assert got(repair.summaries(repair.repaired(rows))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = repair.plain(spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C.")], SCHEMA)).selectExpr("*", "false AS gone")
    turns = repair.repaired(rows).where("place IS NOT NULL").orderBy("place").collect()
    assert [(r.role, r.text) for r in turns] == [("user", "A."), ("assistant", ""), ("user", "B."), ("assistant", "C.")]
