"""SimHash near-dedup: fingerprints of shingles, compared bit-sliced.

Bit planes of many fingerprints stand vertically: a word of plane ``b`` has bit ``b`` of 64 fingerprints. A query's
bit, spread over a word, is combined with the plane by XOR, and the differing bits of 64 pairs are added at once by
carry-save counters, of which there are as many as the radius needs. After some planes, blocks in which all pairs
exceed the radius are abandoned.

Which blocks are compared: fingerprints within ``radius`` bits agree on at least ``BANDS - radius`` of BANDS bands, so
each distinct fingerprint stands once in a bucket for each choice of so many bands, and no link is lost. A bucket of
over CHUNK fingerprints is cut into chunks, and each pair of chunks is compared on its own. A bucket emits a spanning
forest of its links, the closest first, so never more links than fingerprints. Components come from rounds of stars
over the links of distinct fingerprints, each round written to the shared checkpoint folder.

For whole texts (``keep_one``) a link is a share of at least NEAR of all shingles of five words. Fingerprints of 256 bits
are compared the same way at a radius that such texts stay below, in buckets of equal minima of shingle hashes; what is
found is compared exactly, shingle by shingle. A forest alone would hide links behind candidates that fail this
comparison, so sets of texts that such candidates touch are gone through again with their shingles in the buckets: there
every pair that no link connects yet is compared at once, and only true links go into the forest. A text is known by a 64-bit hash; of texts that share it, all but one are left alone.

Defined cases: a null text counts as empty, and texts without words have the fingerprint zero, linked like any other;
texts of fewer words than a shingle are one shingle; a component of rows without ids has no id; repeated rows are
linked as copies; empty tables give no rows; other columns don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, let, lower_ascii, map_arrow, narrowed, own_columns, read, small_enough, split_words, table, text_or_empty

BITS, RADIUS, BANDS, SHINGLE, SEED = 64, 3, 5, 3, 42
CHUNK = 4096
#: Pairs of a query and a word of 64 fingerprints that are compared at a time, some 100 bytes each, and more for each link in dense buckets.
BLOCKS = 50_000
#: Links that are handed on at a time.
LINKS = 500_000
#: Hashes of shingles that are counted at a time, 320 bytes each for one fingerprint word (64 bits, as bytes and as integers).
HASHES = 50_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: Column, width: int) -> Column:
    """XXH64 (seed 42) of each window of ``width`` words, of the words together if they are fewer, or an empty array."""

    def windows(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
        one = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]))
        return F.when(F.size(words) > 0, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))

    return let(split_words(lower_ascii(text)), windows)


def fingerprints_of(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each slice of ``hashes``: bits that over half of its hashes have."""
    begins = np.concatenate([[0], ends[:-1]])
    ones = np.zeros((len(ends), BITS), dtype=np.int64)
    for first in range(0, len(hashes), HASHES):
        last = min(first + HASHES, len(hashes))
        rows = np.flatnonzero((begins < last) & (ends > first) & (begins < ends))
        bits = np.unpackbits(hashes[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[rows] += np.add.reduceat(bits, np.maximum(begins[rows] - first, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > (ends - begins)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def list_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, as slices with HASHES values of a list column and the rest of the last list at most."""
    for batch in batches:
        sizes = batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        block = (np.cumsum(sizes) - sizes) // HASHES
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)), batch.num_rows]
        for first, last in zip(edges, edges[1:]):  # noqa: B905
            yield batch.slice(first, last - first)


def list_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list ends."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def fingerprints(df: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp: each row's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, "hashes"):
            found = fingerprints_of(*list_values(batch.column("hashes")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    hashed = df.select("doc_id", shingle_hashes(text_or_empty(), width).alias("hashes"))
    return map_arrow(hashed, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp bigint")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64-bit words, [bits, words of 64 rows]; the last word is filled up with zeros."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    filled = np.zeros((ceil(len(prints) / 64) * 64, bits.shape[1]), dtype=np.uint8)
    filled[: len(prints)] = bits
    return np.packbits(np.ascontiguousarray(filled.T), axis=1, bitorder="little").view(np.uint64)


def near_pairs(prints: np.ndarray, group: np.ndarray, radius: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that differ in at most ``radius`` bits, with that number; rows are sorted by group.

    ``prints`` is [rows, words]. With ``side`` (0 or 1 for each row), only pairs of the two sides.
    """
    n = len(prints)
    planes, queries = planes_of(prints), np.unpackbits(prints.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    digits = radius.bit_length()
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(n)
    first, words = rows // 64, np.where(ends - rows > 1, (ends - 1) // 64 - rows // 64 + 1, 0)
    sides = None if side is None else planes_of(np.where(side, ALL, np.uint64(0)).reshape(-1, 1))[0]
    low = lambda k: np.where(k >= 64, ALL, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))  # noqa: E731  the lowest k bits
    upto = np.cumsum(words)
    begin = 0
    while begin < n:
        stop = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BLOCKS, side="right")), begin + 1)
        q = np.repeat(rows[begin:stop], words[begin:stop])
        local = np.cumsum(words[begin:stop]) - words[begin:stop]
        w = first[q] + np.arange(len(q)) - np.repeat(local, words[begin:stop])
        begin = stop
        # lanes after the query and inside of its group
        alive = low(np.clip(ends[q] - 64 * w, 0, 64)) & ~low(np.clip(q + 1 - 64 * w, 0, 64))
        if sides is not None:
            alive &= np.where(side[q].astype(bool), ~sides[w], sides[w])
        counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(digits)]
        for b in range(planes.shape[0]):
            carry = planes[b][w] ^ np.where(queries[q, b], ALL, np.uint64(0))
            for k in range(digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry  # an overflow is beyond any radius of so many digits
            if b % 8 == 7:
                over = np.zeros(len(q), dtype=np.uint64)  # counter > radius, from the highest digit down
                same = np.full(len(q), ALL)
                for k in reversed(range(digits)):
                    if radius >> k & 1:
                        same &= counters[k]
                    else:
                        over |= same & counters[k]
                        same &= ~counters[k]
                alive &= ~over
                left = np.flatnonzero(alive)
                if len(left) < len(q):
                    q, w, alive, counters = q[left], w[left], alive[left], [c[left] for c in counters]
        if len(q):
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            bit = lambda c: (c[at] >> lane.astype(np.uint64)) & np.uint64(1)
            yield q[at], 64 * w[at] + lane, sum((bit(c).astype(np.int64) << k) for k, c in enumerate(counters))


class Forest:
    """Sets of rows that grow together; keeps the links that joined two of them."""

    def __init__(self, root: np.ndarray):
        self.root = root.copy()
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, rows: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root[rows]]
            if (up == self.root[rows]).all():
                return up
            self.root[rows] = up

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the links that join two sets; returns those that don't."""
        at, left = np.arange(len(a)), np.ones(len(a), dtype=bool)
        while len(at):
            x, y = self.find(a[at]), self.find(b[at])
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, one = np.unique(high, return_index=True)  # each set joins one lower set at a time, so links make no circle
            self.root[high[one]] = low[one]
            self.links.append((a[at[one]], b[at[one]]))
            left[at[one]] = False
        return a[left], b[left]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *(x[k] for x in self.links)]).astype(np.int64) for k in (0, 1))


def common_counts(values: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows, how many values their slices of ``values`` share; a slice has no value twice."""
    begins = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(a), dtype=np.int64)
    by = np.argsort(a, kind="stable")
    stops = np.flatnonzero(np.diff(a[by], append=-1)) + 1
    for first, last in zip(np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist(), strict=True) if len(a) else ():
        own = np.sort(values[begins[a[by[first]]] : ends[a[by[first]]]])
        for k in range(first, last, COMPARED):
            rows = by[k : min(k + COMPARED, last)]
            sizes = (ends - begins)[b[rows]]
            stop = np.cumsum(sizes)
            flat = values[np.repeat(begins[b[rows]] - (stop - sizes), sizes) + np.arange(int(stop[-1]))]
            at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
            hit = np.concatenate([[0], np.cumsum(own[at] == flat)]) if len(own) else np.zeros(len(flat) + 1, dtype=np.int64)
            out[rows] = hit[stop] - hit[stop - sizes]
    return out


def may_link(sizes: np.ndarray | None, keys: np.ndarray | None, choice: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows may share NEAR of their shingles by the number of these, and share no bucket before this one."""
    use = np.ones(len(a), dtype=bool)
    if sizes is not None:
        use &= sum(NEAR) * np.minimum(sizes[a], sizes[b]) >= NEAR[0] * (sizes[a] + sizes[b])
    for k in range(0 if keys is None else keys.shape[1]):
        use &= (keys[a, k] != keys[b, k]) | (choice[a] <= k)
    return use


def forest(prints: np.ndarray, group: np.ndarray, radius: int, side: np.ndarray | None = None, known: np.ndarray | None = None, sizes: np.ndarray | None = None, keys: np.ndarray | None = None, choice: np.ndarray | None = None, sets: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links in all groups, as a spanning forest; closer links first among those that are found together.

    Only links between rows that differ in ``known`` (one number for rows that are joined already) and, with ``sizes``
    of their shingle sets, that may share NEAR of them. With ``sets`` (the shingles of all rows, and where each row's end)
    a link is a pair that does share NEAR; such a pair is compared in the first bucket that it shares, which ``keys`` of
    all buckets and ``choice`` of this one tell.
    """
    joined = np.arange(len(prints))
    if known is not None:
        _, first, of = np.unique(np.stack([group, known]), axis=1, return_index=True, return_inverse=True)
        joined = first[of.reshape(-1)]
    found = Forest(joined)
    for a, b, distance in near_pairs(prints, group, radius, side):
        use = found.find(a) != found.find(b)
        a, b, distance = a[use], b[use], distance[use]
        new = may_link(sizes, keys, choice, a, b)
        a, b, distance = a[new], b[new], distance[new]
        if sets is not None:
            near = sum(NEAR) * common_counts(*sets, a, b) >= NEAR[0] * (sizes[a] + sizes[b])
            a, b, distance = a[near], b[near], distance[near]
        for d in np.unique(distance):
            found.add(a[distance == d], b[distance == d])
    return found.rows()


def _buckets(prints: DataFrame, radius: int) -> DataFrame:
    """key, fp: each fingerprint once for each choice of bands on which its neighbours may agree with it."""
    cuts = [round(k * BITS / BANDS) for k in range(BANDS + 1)]
    masks = []
    for chosen in combinations(range(BANDS), BANDS - radius):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    key = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits")
    return prints.select("fp", key)


#: Columns of rows in buckets that are compared, beside node and words, as for ``forest``.
MORE = ("known", "size", "keys", "shingles")


def gathered_buckets(placed: DataFrame) -> DataFrame:
    """choice, bits, x, y, rows: the rows of each bucket of two or more; the large ones in chunks, each pair of chunks together.

    Chunks have CHUNK rows and, where shingles go along, SHINGLES of these. A bucket whose rows are all joined already has
    no link to find.
    """
    own = ["node", "words", *(c for c in MORE if c in placed.columns)]
    weight = F.sum("size") / SHINGLES if "shingles" in own else F.lit(0.0)
    apart = F.min("known") < F.max("known") if "known" in own else F.lit(True)
    counts = placed.groupBy("choice", "bits").agg(F.count("*").alias("count"), apart.alias("apart"), F.ceil(F.greatest(F.count("*") / CHUNK, weight)).cast("int").alias("parts"))
    shared = checkpoint(counts.where((F.col("count") > 1) & F.col("apart")).drop("apart"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y"), (F.col("mine") > k).cast("int").alias("side"))))
    together = placed.join(shared, ["choice", "bits"]).withColumn("mine", mine).select("choice", "bits", *own, pair.alias("p"))
    return together.groupBy("choice", "bits", "p.x", "p.y").agg(F.collect_list(F.struct(*own, "p.side")).alias("rows")).where(F.size("rows") > 1)


def compared_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """Of gathered buckets: nodes, which bucket of the batch each is in, and the arguments of ``forest`` for them.

    Buckets in one chunk come together, pairs of two chunks together; with shingles there must be one bucket only.
    """
    rows = batch.column("rows")
    group = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
    fields = rows.flatten()
    there = [field.name for field in fields.type]
    plain = {f: fields.field(f).to_numpy(zero_copy_only=False) for f in ("node", "side", "known", "size") if f in there}
    wide = lambda f, kind: np.ascontiguousarray(fields.field(f).flatten().to_numpy(zero_copy_only=False)).view(kind).reshape(len(group), -1)
    prints, keys = wide("words", np.uint64), wide("keys", np.int64) if "keys" in there else None
    choice = batch.column("choice").to_numpy()[group]
    two = (batch.column("x").to_numpy() != batch.column("y").to_numpy())[group]
    for chosen in (~two, two):
        own = np.flatnonzero(chosen)
        if len(own):
            more = {"prints": np.ascontiguousarray(prints[own]), "group": group[own], "side": plain["side"][own] if two[own[0]] else None}
            more |= {"known" if f == "known" else "sizes": plain[f][own] for f in ("known", "size") if f in there}
            if keys is not None:
                more |= {"keys": keys[own], "choice": choice[own]}
            if "shingles" in there:
                more["sets"] = list_values(fields.field("shingles"))  # one bucket, so that all of its rows are chosen
            yield plain["node"][own], group[own], more


def links_in_buckets(placed: DataFrame, radius: int) -> DataFrame:
    """a, b: a spanning forest of each bucket's links.

    ``placed`` has choice, bits (the bucket), node, words (the fingerprint), and may have columns of MORE.
    """
    alone = "shingles" in placed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1 if alone else b.num_rows) for b in batches for k in range(0, b.num_rows, 1 if alone else b.num_rows)):
            for nodes, _, rows in compared_rows(batch):
                a, b = forest(radius=radius, **rows)
                for k in range(0, len(a), LINKS):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a[k : k + LINKS]]), pa.array(nodes[b[k : k + LINKS]])], names=["a", "b"])

    found = map_arrow(gathered_buckets(placed).select("choice", "x", "y", "rows"), run, "a bigint, b bigint")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contested(placed: DataFrame, radius: int) -> DataFrame:
    """choice, bits, node: the rows of buckets that a pair needs which may be a link between two known sets.

    Each such pair counts in the first bucket that it shares only, so that few rows must be followed by their shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, group, rows in compared_rows(batch):
                hit = np.zeros(len(nodes), dtype=bool)
                for a, b, _ in near_pairs(rows["prints"], group, radius, rows["side"]):
                    use = may_link(rows["sizes"], rows["keys"], rows["choice"], a, b) & (rows["known"][a] != rows["known"][b])
                    hit[a[use]] = hit[b[use]] = True
                of = pa.array(group[hit])
                yield pa.RecordBatch.from_arrays([batch.column("choice").take(of), batch.column("bits").take(of), pa.array(nodes[hit])], names=["choice", "bits", "node"])

    kind = placed.schema["choice"].dataType.simpleString()
    return map_arrow(gathered_buckets(placed).select("choice", "bits", "x", "y", "rows"), run, f"choice {kind}, bits bigint, node bigint").distinct()


def links_within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links of the distinct fingerprints ``fp`` that connect all that differ in at most ``radius`` bits."""
    return links_in_buckets(_buckets(prints, radius).select("choice", "bits", F.col("fp").alias("node"), F.array("fp").alias("words")), radius)


def components(links: DataFrame) -> DataFrame:
    """node, root: for each number in ``links`` (a, b), the smallest number of its component.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are linked to the smallest
    that it knows, until nothing changes. Joins have no aggregate next to them, so that Spark can split a hub's rows.
    Few links take few partitions, as each round has some ten shuffles.
    """
    now = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    rows = now.count()
    few = lambda df: narrowed(df, rows)
    now, before = few(now), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))))
        large = checkpoint(few(few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()))
        least = checkpoint(few(large.groupBy("u").agg(F.min("v").alias("m"))))
        joined = few(large.join(least, "u"))
        stars = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = checkpoint(few(stars.distinct()))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(few(now.select("v", "v").distinct()))
        before = state


def group_ids(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id for all rows' fingerprints (doc_id, fp): the smallest doc_id of its component."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = checkpoint(components(links_within(distinct, radius)))
    rooted = checkpoint(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    smallest = checkpoint(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest id of the documents that its links reach."""
    prints = checkpoint(fingerprints(read(spark, sf_dir, "documents")))
    grouped = checkpoint(group_ids(prints))
    return prints.join(grouped, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For whole texts: words of a shingle, the least share of common shingles (four fifths, as whole numbers), fingerprint
#: words, and their radius: texts of that share differ by 48 of 256 bits at most on average (sets of 4 and 5; large ones
#: by 39), and exceed the radius in 1.6 of 100,000 cases (large ones in fewer than 1 of 100 million).
NEAR_SHINGLE, NEAR, WORDS, NEAR_RADIUS = 5, (4, 5), 4, 75
#: Shingles of the texts of a chunk of a bucket, 8 bytes each, and pairs of one text that are compared at a time.
SHINGLES, COMPARED = 1_000_000, 2000
#: Buckets for whole texts: pairs of minima of shingle hashes. Texts with a share of 0.8 miss all of them in 4 of 100,000 cases.
PAIRS = 10
#: Ids of texts with a link, and rows that go, that are broadcast: 8 and 16 bytes each.
BROADCAST_NODES = 1_000_000


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


#: Odd factors without small multiples among each other: a hash that is small under one isn't so under the next.
FACTORS = _mixed(_mixed(np.arange(1, 2 * PAIRS + 1, dtype=np.uint64), 1), 2) | np.uint64(1)


def sketches_of(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of WORDS words, and PAIRS bucket keys, of each slice of ``hashes``; keys of empty slices are zero."""
    hashes = hashes.view(np.uint64)
    prints, keys = np.zeros((len(ends), WORDS), dtype=np.uint64), np.zeros((len(ends), PAIRS), dtype=np.uint64)
    begins = np.concatenate([[0], ends[:-1]])
    some = np.flatnonzero(begins < ends)
    for k in range(WORDS):
        prints[:, k] = fingerprints_of(_mixed(hashes, k), ends)
    for k in range(2 * PAIRS if len(some) else 0):
        least = np.minimum.reduceat(hashes * FACTORS[k], begins[some])
        keys[some, k // 2] = _mixed(keys[some, k // 2] ^ least, k)
    return prints, keys


def text_nodes() -> list[Column]:
    """node, check: the hash that stands for a text in links, and another by which two texts of one hash are told apart."""
    return [F.xxhash64(text_or_empty()).alias("node"), F.xxhash64(text_or_empty(), F.lit(1)).alias("check")]


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, check) with two hashes of the text, and links (a, b) that connect all texts that share NEAR of their shingles."""
    shingles = F.array_distinct(shingle_hashes(text_or_empty(), NEAR_SHINGLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, "hashes"):
            hashes, ends = list_values(batch.column("hashes"))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in sketches_of(hashes, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), batch.column("check"), pa.array(np.diff(ends, prepend=0)), *lists], names=["doc_id", "node", "check", "size", "words", "keys"])

    hashed = docs.select("doc_id", *text_nodes(), shingles.alias("hashes"))
    rows = table(map_arrow(hashed, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, check bigint, size bigint, words array<bigint>, keys array<bigint>"))
    n = rows.count()
    few = lambda df: narrowed(df, n)
    texts = table(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "words", "keys"))))
    placed = texts.select("node", "size", "words", "keys", F.posexplode("keys").alias("choice", "bits")).where("bits <> 0")
    maybe = table(few(links_in_buckets(placed.drop("keys"), NEAR_RADIUS)))
    nodes = table(few(maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    sent = small_enough(nodes, BROADCAST_NODES)
    # texts of one hash are taken from the row with the smallest id, so that texts are no part of a shuffle where ids differ
    first = checkpoint(few(rows.join(F.broadcast(nodes) if sent else nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("first"))))
    same = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))
    texts_of = docs.select("doc_id", "text", text_nodes()[0]).join((F.broadcast(first) if sent else first).withColumnRenamed("node", "of"), same)
    sets = table(texts_of.select("node", shingles.alias("shingles")))
    if sets.count() > first.count():
        sets = table(sets.dropDuplicates(["node"]))
    # a text is in as many pairs as its buckets have it joined to others, so its shingles go along for each of these
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}"))
    near = sum(NEAR) * F.size(F.array_intersect("of_a", "of_b")) >= NEAR[0] * (F.size("of_a") + F.size("of_b"))
    checked = table(maybe.join(side("a"), "a").join(side("b"), "b").select("a", "b", near.alias("near")))
    links = checked.where("near").select("a", "b")
    # a link that is hidden lies between two sets of linked texts that failed candidates touch
    roots = checkpoint(few(components(links)))
    known = checkpoint(few(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("known"))))
    end = lambda k: known.select(F.col("node").alias(k), F.col("known").alias(f"known_{k}"))
    failed = few(checked.where("NOT near").join(end("a"), "a").join(end("b"), "b").where("known_a <> known_b"))
    unsure = checkpoint(few(failed.select(F.explode(F.array("known_a", "known_b")).alias("known")).distinct()))
    if unsure.limit(1).count():
        again = checkpoint(few(known.join(unsure, "known", "left_semi")))
        mixed = checkpoint(placed.join(F.broadcast(again) if small_enough(again, BROADCAST_NODES) else again, "node"))
        needed = checkpoint(few(contested(mixed, NEAR_RADIUS)))
        of = needed.select("node").distinct()
        followed = sets.join(F.broadcast(of) if small_enough(of, BROADCAST_NODES) else of, "node", "left_semi")
        links = links.union(table(few(links_in_buckets(mixed.join(needed, ["choice", "bits", "node"]).join(followed, "node"), NEAR_RADIUS))))
    return rows.select("doc_id", "node", "check"), links


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each group of linked texts, the row with the smallest id stays (null: last)."""
    rows, links = near_links(docs)
    n = rows.count()
    few = lambda df: narrowed(df, n)
    roots = checkpoint(few(components(links)))
    texts = checkpoint(few(rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("check").alias("check"), F.max("check").alias("other"))))
    rooted = checkpoint(few(texts.select(F.col("node").alias("n"), "id").join(roots, F.col("n") == F.col("node"), "left").select("n", "id", F.coalesce("root", "n").alias("root"))))
    stays = checkpoint(few(rooted.groupBy("root").agg(F.min_by(F.struct("n", "id"), F.struct(F.col("id").isNull(), "id", "n")).alias("s")))).select(F.col("s.n").alias("n"), F.col("s.id").alias("id"))
    # a group has one row in stays, so that the rows of a hot text lie apart by their ids
    goes = rows.join(stays, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    clashes = texts.where(F.col("check") != F.col("other")).select(F.col("node").alias("n"), F.col("check").alias("known"))
    if clashes.limit(1).count():  # other texts of the same hash are no copies
        goes = goes.join(F.broadcast(clashes) if small_enough(clashes, BROADCAST_NODES) else clashes, F.col("node") == F.col("n"), "left").where(F.col("known").isNull() | (F.col("known") == F.col("check")))
    goes = checkpoint(few(goes.select(F.col("doc_id").alias("id"), F.col("node").alias("n"), F.col("check").alias("c")).distinct()))
    sent = small_enough(goes, BROADCAST_NODES)
    marked = docs.select(own_columns(docs), F.col("doc_id").alias("doc"), *text_nodes())
    same = (F.col("node") == F.col("n")) & (F.col("check") == F.col("c")) & F.col("doc").eqNullSafe(F.col("id"))
    kept = marked.join(F.broadcast(goes) if sent else goes, same, "left_anti")
    if rows.groupBy("doc_id", "node", "check").count().where("count > 1").limit(1).count():  # rows that only a shuffle can tell apart
        kept = kept.dropDuplicates(["doc", "node", "check"])
    return kept.select("__own.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
