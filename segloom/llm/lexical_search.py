"""Ranked lexical search over a tiered index: postings of high impact first, with a bound for what each term still holds.

The index has a row for each document and, for each tier, two columns: the terms whose postings are of that tier and
their impacts. A posting's value is its impact times its term's weight, and tiers are cut by value at shares of all
postings, so the first tier is small and its columns alone are read at first. Each term's residual is the highest
value it has below a tier. An item is proven at a tier if not even the best document outside of its KEEP candidates
could reach its k-th: candidate scores so far and the residuals of the item's terms tell. Its candidates are then scored
with all tiers. Items that lack this proof fall to the next tier by themselves, and after the last nothing is left out.

Items go in blocks of some BLOCK_TERMS words by a hash, so that what is sent to the tasks is bounded however many items
there are. Documents are scored where they lie, and each task puts out no more than KEEP documents an item; nothing is
gathered by term, so frequent words and large groups of copies make no hot task. All arithmetic is in 64-bit integers.

Defined cases: a null text has no terms; items without terms and documents without a score above zero are in no row;
repeated rows of documents are documents of their own, those of items are one item; a null doc_id comes after others of
its score. Texts of any length are counted in pieces. Other columns are left out; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, map_arrow, read, table, text_or_empty

TOP, KEEP = 20, 64
#: Shares of all postings that the first tier has, and the first two.
TIERS = (0.05, 0.3)
BLOCK_TERMS = 200_000
PIECE, CELLS, PENDING = 1 << 20, 2_000_000, 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = [0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
#: Bytes of terms in lower case, all others as spaces; beyond ASCII every byte belongs to a term.
PLAIN = bytes(bytes([b]).lower()[0] if _IS_TERM[b] else 0x20 for b in range(256))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda t: t != "")


def count_text(text: bytes) -> Counter:
    """The terms of a text with their numbers, a piece at a time."""
    counts: Counter = Counter()
    plain, begin = text.translate(PLAIN), 0
    while begin < len(plain):
        end = plain.find(b" ", begin + PIECE)
        end = len(plain) if end < 0 else end
        counts.update(plain[begin:end].split())
        begin = end
    return counts


@dataclass
class Items:
    """A block of items: ``ids``, and for each term the items that have it (``item[start[t]:start[t + 1]]``) and how often."""

    ids: list
    terms: list[bytes]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def only(self, wanted: np.ndarray) -> Items:
        """With the postings of items where ``wanted`` is set."""
        kept = wanted[self.item]
        before = np.concatenate([[0], np.cumsum(kept)])
        return Items(self.ids, self.terms, before[self.start], self.item[kept], self.times[kept])

    def sums(self, of_term: np.ndarray) -> np.ndarray:
        """For each item the sum of ``of_term`` over its terms, repeats included."""
        out = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(out, self.item, self.times * np.repeat(of_term, np.diff(self.start)))
        return out


@dataclass
class Index:
    """``rows``: row, doc_id, and terms_k and impacts_k for each tier k; ``weights`` and the tiers' ``residuals`` by term."""

    rows: DataFrame
    weights: np.ndarray
    residuals: list[np.ndarray]
    proven: list[int] = field(default_factory=list)


def blocks_of(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Items]:
    """The different items (item_id, text) in blocks that the driver can hold; only one with more words by itself is larger."""
    listed = items.select("item_id", "text").distinct().withColumn("terms", terms_of(text_or_empty())).where(F.size("terms") > 0)
    words = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, math.ceil(words / block_terms))
    for k in range(n):
        found = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "terms").collect()
        if not found:
            continue
        counts = [Counter(t.encode() for t in r.terms) for r in found]
        terms = sorted(set().union(*counts))
        number = {t: i for i, t in enumerate(terms)}
        entries = sorted((number[t], i, times) for i, c in enumerate(counts) for t, times in c.items())
        term, item, times = np.array(entries, dtype=np.int64).T
        yield Items([r.item_id for r in found], terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, times)


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), and those among ``terms``, by number, with how often they occur."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, found, times = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                counts = count_text(text.as_py() or b"")
                own = counts.keys() & number.keys()
                n.append(counts.total())
                sizes.append(len(own))
                found += [number[t] for t in own]
                times += [counts[t] for t in own]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, terms array<int>, times array<int>")


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _owners(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def build(docs: DataFrame, terms: list[bytes], tiers: tuple[float, ...] = TIERS) -> Index:
    """The index of ``docs`` for ``terms``, written to the shared folder."""
    parts = table(counted(docs, terms))
    n_docs, n_terms = parts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(n_docs), max(1, int(n_terms))
    df = np.zeros(len(terms), dtype=np.int64)
    for t, n in parts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    n_tiers = len(tiers) + 1

    def impacts(batch: pa.RecordBatch) -> np.ndarray:
        m = 75 + 25 * batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64) * n_docs // n_terms
        times = _flat(batch.column("times"))
        return 1_000_000_000 * times // (1000 * times + 12 * m[_owners(batch.column("times"))])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings by the logarithm of their value, in eighths."""
        counts = np.zeros(512, dtype=np.int64)
        for batch in batches:
            value = weights[_flat(batch.column("terms"))] * impacts(batch)
            counts += np.bincount((8 * np.log2(value + 1.0)).astype(np.int64), minlength=512)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bin", "n"])

    histogram = np.zeros(512, dtype=np.int64)
    for b, n in map_arrow(parts, bins, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():  # 512 rows at most
        histogram[b] = n
    above = np.cumsum(histogram[::-1])[::-1]
    # the least bin from which on a tier's share of the postings lies; falling from tier to tier
    edges = [int(np.argmax(above <= share * above[0])) if above[-1] <= share * above[0] else 512 for share in tiers]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, impact, owner = _flat(batch.column("terms")), impacts(batch), _owners(batch.column("terms"))
            where = (8 * np.log2(weights[term] * impact + 1.0)).astype(np.int64)
            tier = sum((where < e for e in edges), np.zeros(len(where), dtype=np.int64))
            columns = [batch.column("row"), batch.column("doc_id")]
            for k in range(n_tiers):
                own = tier == k
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=batch.num_rows))]), pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x[own], pa.int32())) for x in (term, impact)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *(f"{c}_{k}" for k in range(n_tiers) for c in ("terms", "impacts"))])

    schema = "row long, doc_id long, " + ", ".join(f"{c}_{k} array<int>" for k in range(n_tiers) for c in ("terms", "impacts"))
    rows = table(map_arrow(parts.withColumn("row", F.monotonically_increasing_id()), cut, schema))
    highest = np.zeros((n_tiers, len(terms)), dtype=np.int64)
    for k in range(1, n_tiers):
        best = rows.select(F.explode(F.arrays_zip(F.col(f"terms_{k}").alias("t"), F.col(f"impacts_{k}").alias("i"))).alias("p")).groupBy("p.t").agg(F.max("p.i"))
        for t, i in best.collect():  # a row for each term of the block
            highest[k, t] = weights[t] * i
    return Index(rows, weights, [highest[k + 1 :].max(axis=0) if k + 1 < n_tiers else np.zeros(len(terms), dtype=np.int64) for k in range(n_tiers)])


class _Best:
    """The highest ``keep`` scores of each item among the rows of a task, ties by doc_id, null last."""

    def __init__(self, n_items: int, keep: int):
        self.keep, self.floor, self.parts, self.pending = keep, np.ones(n_items, dtype=np.int64), [], 0

    def add(self, scores: np.ndarray, rows: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.floor)
        self.parts.append(np.stack([i, scores[d, i], nulls[d], docs[d], rows[d]]))
        self.pending += len(d)
        if self.pending > PENDING:
            self.close()

    def close(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((5, 0), dtype=np.int64)
        all_rows = np.concatenate(self.parts, axis=1)
        all_rows = all_rows[:, np.lexsort((all_rows[4], all_rows[3], all_rows[2], -all_rows[1], all_rows[0]))]
        first = np.searchsorted(all_rows[0], np.arange(len(self.floor) + 1))
        place = np.arange(all_rows.shape[1]) - first[all_rows[0]]
        last = all_rows[:, place == self.keep - 1]
        self.floor[last[0]] = last[1]
        kept = all_rows[:, place < self.keep]
        self.parts, self.pending = [kept], 0
        return kept


def _scores(batch: pa.RecordBatch, tiers: int, items: Items, weights: np.ndarray) -> np.ndarray:
    """Scores of a batch's documents for all items from the first ``tiers`` tiers."""
    out = np.zeros(batch.num_rows * len(items.ids), dtype=np.int64)
    for k in range(tiers):
        term, impact, owner = _flat(batch.column(f"terms_{k}")), _flat(batch.column(f"impacts_{k}")), _owners(batch.column(f"terms_{k}"))
        n = items.start[term + 1] - items.start[term]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.start[term], n)
        np.add.at(out, np.repeat(owner, n) * len(items.ids) + items.item[at], np.repeat(weights[term] * impact, n) * items.times[at])
    return out.reshape(batch.num_rows, len(items.ids))


def scan(index: Index, tiers: int, items: Items, keep: int, among: tuple[Items, np.ndarray] | None = None) -> DataFrame:
    """item, score, doc_id, row, place: the best ``keep`` of each of ``items`` by the first ``tiers`` tiers; ``among``: other items, for given rows only."""
    weights = index.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items.ids), keep)
        step = max(1, CELLS // max(1, len(items.ids)))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                rows, docs = batch.column("row").to_numpy(zero_copy_only=False), pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
                scores = _scores(batch, tiers, items, weights)
                if among is not None:
                    few = np.flatnonzero(np.isin(rows, among[1]))
                    if len(few):
                        scores[few] += _scores(batch.take(pa.array(few)), tiers, among[0], weights)
                best.add(scores, rows, docs, pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64))
        item, score, null, doc, row = best.close()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=null.astype(bool)), pa.array(row)], names=["item", "score", "doc_id", "row"])

    rows = index.rows.select("row", "doc_id", *(f"{c}_{k}" for k in range(tiers) for c in ("terms", "impacts")))
    if among is not None and not len(items.item):
        wanted = rows.sparkSession.createDataFrame([(int(r),) for r in among[1]], "row long")
        rows = rows.join(F.broadcast(wanted), "row", "left_semi")  # KEEP rows for each item of the block at most
    found = map_arrow(rows, run, "item long, score long, doc_id long, row long")
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)


def search(index: Index, items: Items, top: int = TOP, keep: int = KEEP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item; ``index.proven`` gets the number of items proven at each tier."""
    keep, tiers = max(keep, top), len(index.residuals)
    still, sure = np.ones(len(items.ids), dtype=bool), []
    for k in range(1, tiers):
        open_items = items.only(still)
        rest = open_items.sums(index.residuals[k - 1])
        per_item = scan(index, k, open_items, keep).groupBy("item").agg(
            F.max(F.when(F.col("place") == top, F.col("score"))).alias("least"), F.max(F.when(F.col("place") == keep, F.col("score"))).alias("last"), F.collect_list("row").alias("rows")
        )
        before = still.copy()
        for item, least, last, rows in per_item.collect():  # KEEP rows for each item of the block at most
            if rest[item] == 0 or (last or 0) + rest[item] < (least or 0):
                still[item] = False
                sure += rows
        index.proven.append(int((before & ~still).sum()))
        if not still.any():
            break
    found = scan(index, tiers, items.only(still), top, (items.only(~still), np.unique(np.array(sure, dtype=np.int64))))
    ids = items.ids
    named = found.sparkSession.createDataFrame(list(enumerate(ids)), f"item long, item_id {'string' if any(isinstance(x, str) for x in ids) else 'long'}")
    return found.join(F.broadcast(named), "item").select("item_id", F.col("place").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents (doc_id, text) of each item (item_id, text), block by block."""
    out = items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in blocks_of(items, block_terms):
        out = out.unionByName(search(build(docs, block.terms), block, top))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, {_TERMS_SQL} AS terms FROM d),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM t),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY ALL),
i AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(CAST(1000 AS DOUBLE) * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m FROM t, c WHERE len(terms) > 0),
s AS (SELECT item_id, text, m.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
