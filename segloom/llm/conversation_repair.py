"""Conversation structure repair: the cheapest edits after which a conversation's roles are legal.

Roles are legal if their initials read ``(s?(ua)+)?``. Nodes are (turn index, grammar state); keeping, re-roling and
deleting a turn go one turn on, inserting stays. Dijkstra pops nodes by (cost, audit), the audit being the edits'
initials so far, and stops at the first accepting end node. Two ways to one node have consumed the same turns, so of
equal cost neither's audit begins with the other's, and whichever is less stays less whatever follows.

Conversations of any length: turns come as a sorted stream, without their texts, CHUNK at a time. Between chunks the
cheapest way to each of the four states is carried, and what these ways have in common is decided and put out. Texts
meet their edits again by a join; only the hash of a conversation, which is sequential by its nature, is one stream.

Defined cases: null roles and texts are one space; so is a null id or turn where rows are chosen for damage. Null ids
are one conversation. Turns of one number are in the order of role, the text's first HEAD characters and its hash. A
role without an initial s, u or a, an empty one too, can't be kept. Repeated rows are duplicates. Other columns of the
input are left out; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, map_arrow, read

#: Turns whose lattice is searched at once.
CHUNK = 1000
HEAD = 32
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Grammar states: before all, after a system turn, after a user's, after an assistant's.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
GOES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
WANTED = ["user", "user", "assistant", "user"]
ACCEPTING = (BEGIN, ASSISTANT)
FIRST_TURN = -(1 << 63)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls in the last two, and the sort key ``at`` that puts null turns first."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", filled("role"), filled("text"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("at"))


def damage(rows: DataFrame) -> DataFrame:
    """``plain`` rows with faults planted by a hash of id and turn; ``gone`` marks rows that are dropped."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(named) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "at", (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def _digest() -> Column:
    return F.unhex(F.md5("text")).alias("digest")


def _light(rows: DataFrame) -> DataFrame:
    """What the search needs of a row: its place in order, a digest of the text, whether it is blank or cut off, and where its like first came."""
    marks = let(F.btrim("text", F.lit(SPACES)), lambda bare: F.struct((bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")))
    light = rows.select("conv_id", "at", "role", F.substring("text", 1, HEAD).alias("head"), _digest(), "gone", marks.alias("m")).select("*", "m.*").drop("m")
    seen = light.where("not gone").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("first_at"))
    return light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").drop("c", "r", "d")


def ways(turns: list[tuple[str, bool, bool]], begin: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) to each grammar state after ``turns`` (role, must go, cut off) from those in ``begin``; to the first accepting one only if these are the ``last``."""
    queue = [(cost, audit, 0, state) for state, (cost, audit) in begin.items()]
    heapq.heapify(queue)
    settled: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        onward = GOES[state][WANTED[state][0]]
        if i == len(turns):
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        else:
            role, must_go, cut_off = turns[i]
            heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                if role[:1] in GOES[state]:
                    heapq.heappush(queue, (cost + KEEP + CUT_OFF * cut_off, audit + "K", i + 1, GOES[state][role[:1]]))
                heapq.heappush(queue, (cost + REROLE + CUT_OFF * cut_off, audit + "R", i + 1, onward))
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, onward))
    return ends


class _Conversation:
    """The turns of one conversation as they come. ``put`` takes the edits that are decided, and the summary at the end."""

    def __init__(self, put, chunk: int):
        self.put, self.chunk, self.turns, self.waiting = put, chunk, [], []
        self.carried = {BEGIN: (0, "")}
        self.place, self.state, self.audit = 0, BEGIN, []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turn_numbers: list[int] = []
        self.before: tuple | None = None

    def add(self, at: int, role: str, digest: bytes, blank: bool, cut: bool, first_at: int) -> None:
        key = (at, role, digest)
        repeated = not blank and (at > first_at or (self.before is not None and key == self.before))
        self.counts["blank"] += blank
        self.counts["duplicate"] += repeated
        self.counts["truncated"] += not blank and not repeated and cut
        if self.before is not None:
            self.counts["illegal"] += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        if at != FIRST_TURN:
            # first, last and number of the turns' numbers
            self.turn_numbers = [at, at, 1] if not self.turn_numbers else [self.turn_numbers[0], at, self.turn_numbers[2] + (at != self.turn_numbers[1])]
        self.before = key
        self.turns.append((role, blank or repeated, cut and not blank))
        self.waiting.append(key)
        if len(self.turns) == self.chunk:
            self._search(last=False)

    def _search(self, last: bool) -> None:
        self.carried = ways(self.turns, self.carried, last)
        self.turns = []
        sure = os.path.commonprefix([audit for _, audit in self.carried.values()])
        self.carried = {state: (cost, audit[len(sure) :]) for state, (cost, audit) in self.carried.items()}
        self.audit.append(sure)
        used = 0
        for edit in sure:
            key = None
            if edit != "I":
                key, used = self.waiting[used], used + 1
            if edit == "D":
                continue
            role = key[1] if edit == "K" else WANTED[self.state]
            self.put(place=self.place, key=key, role=role)
            self.place, self.state = self.place + 1, GOES[self.state][role[0]]
        del self.waiting[:used]

    def end(self) -> None:
        self._search(last=True)
        ((self.counts["cost"], _),) = self.carried.values()
        if self.turn_numbers:
            self.counts["gaps"] = self.turn_numbers[1] - self.turn_numbers[0] + 1 - self.turn_numbers[2]
        self.put(summary=[*self.counts.values(), "".join(self.audit)])


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What stays and comes of damaged ``rows``: conv_id, place, role; at, old_role and digest of the row it was (null: an insertion); and a row a conversation with null place, the counts, cost and audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, role string, at long, old_role string, digest binary, {', '.join(f'{c} long' for c in COUNTS)}, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own: _Conversation | None = None
        current = None

        def put(place=None, key=None, role=None, summary=None) -> None:
            out.append((current, place, role, *(key or (None,) * 3), *(summary or (None,) * (len(COUNTS) + 1))))

        def ready(types: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, types, strict=True)], schema=types)

        types = None
        for batch in batches:
            if types is None:
                longs = [pa.field(c, pa.int64()) for c in COUNTS]
                types = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("at", pa.int64()), pa.field("old_role", pa.string()), pa.field("digest", pa.binary()), *longs, pa.field("audit", pa.string())])
            for conv, at, role, digest, gone, blank, cut, first_at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "digest", "gone", "blank", "cut", "first_at")), strict=True):
                if own is None or conv != current:
                    if own is not None:
                        own.end()
                    own, current = _Conversation(put, chunk), conv
                if not gone:
                    own.add(at, role, digest, blank, cut, first_at)
                if len(out) > 5000:
                    yield ready(types)
        if own is not None:
            own.end()
            yield ready(types)

    ordered = _light(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at", "role", "head", "digest")
    return map_arrow(ordered.select("conv_id", "at", "role", "digest", "gone", "blank", "cut", "first_at"), run, schema)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``edits`` with the ``text`` of each turn, empty for insertions: the repaired conversations, and their summaries with null place."""
    texts = rows.where("not gone").select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("role").alias("r"), _digest().alias("d"), "text").dropDuplicates(["c", "a", "r", "d"])
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")) & (F.col("old_role") == F.col("r")) & (F.col("digest") == F.col("d"))
    found = edits(rows, chunk).join(texts, same, "left").drop("c", "a", "r", "d")
    return found.withColumn("text", F.when(F.col("place").isNotNull(), F.coalesce("text", F.lit(""))))


def summaries(found: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``: counts, cost, audit, and the hash of its turns, read as a stream."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, empty = hashlib.sha256(), True
        for batch in batches:
            places, hashes = batch.column("place").to_pylist(), []
            for place, role, text in zip(places, batch.column("role"), batch.column("text"), strict=True):
                if place is None:
                    hashes.append(own.hexdigest())
                    own, empty = hashlib.sha256(), True
                else:
                    own.update(f"{'' if empty else chr(10)}{role.as_py()}:{text.as_py()}".encode())
                    empty = False
            ends = batch.filter(pa.array([p is None for p in places])).select(["conv_id", *COUNTS, "audit"])
            yield pa.RecordBatch.from_arrays([*ends.columns, pa.array(hashes, pa.string())], names=[*ends.schema.names, "repaired_sha256"])

    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("place"))
    return map_arrow(ordered.select("conv_id", "place", "role", "text", *COUNTS, "audit"), run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(repaired(damage(plain(read(spark, sf_dir, "conversations")))))
