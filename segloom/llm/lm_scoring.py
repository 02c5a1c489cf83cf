"""LM scoring: a causal self-attention model on subword ids gives each text's probability.

The model's event is the text's words, A-Z lower-cased, and one end. Words are encoded as pieces of a SentencePiece
model (``piece_coding``), once, into a table beside the rows. Every piece has its own probability (``attention``): the most
frequent ones stand in groups of pieces with like neighbours, all others in a square of rows and columns.

Training: counts of words, pieces and neighbours cover all training documents, and so does gradient descent: every token of
every training document is predicted once, in rounds over growing parts of the documents (PARTS), each task going through
its own documents from the weights that the round before gave; the tasks' changes are averaged by their tokens. Corpora of
fewer than LEAST_TOKENS tokens are gone through several times. Only averaged weights, figures by piece and frequent words
reach the driver.

Beside it stands the base, a unigram model of whole words. Words that are at least N / FREQUENT of the training tokens and
not overlong, so at most FREQUENT of them, are looked up in a broadcast table; all others are joined with the counts by a
shuffle, in which no key is hot.

Defined cases: a null text counts as empty and scores its end alone; without training documents shares are even and
``n_known`` is 0; null ids count as training rows with the CRC of the empty string; repeated rows count as often as they
occur; empty tables give no rows; other columns don't matter. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import GROUPS, MEMBERS, OWN, RATE, SIDE, Scorer, Shares, Trainer, Weights, score_texts
from .common import map_arrow, narrowed, read, slices, table, text_or_empty
from .piece_coding import model_path, viterbi
from .subwords import SPACE, Batch, pieces, spread, sums

FOLDS, HELD_OUT = 5, 1
#: A word with at least this fraction of the tokens is frequent if it has at most LONGEST characters: some 50 bytes each.
FREQUENT, LONGEST = 500_000, 40
#: Sixteenths of the documents at which the rounds end; passes over a small corpus.
PARTS, LEAST_TOKENS, PASSES = (1, 5, 16), 6_000_000, 8
DEPTH, BUCKETS = 5, 128  # 2**DEPTH groups
#: Bytes of text, and tokens, that a task holds as arrays at a time; a longer text makes a slice of its own.
ARRAY_BYTES, LIST_BYTES, TOKENS = 1 << 20, 2 << 20, 400_000
#: New words that a document is taken to bring, where it is decided whether the table of words stays in few partitions.
NEW_WORDS = 10
CHUNK = 256  # weights in a row
END = 2  # the id of </s>, which no text encodes to


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def words_of(texts: pa.Array) -> pa.ListArray:
    """Each text's words, A-Z lower-cased; white space is ASCII's."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(trimmed)
    return pc.if_else(pc.equal(trimmed, ""), pa.scalar([], lists.type), lists) if (pc.min(pc.binary_length(trimmed)).as_py() or 0) == 0 and len(texts) else lists


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word stands in the texts; n_docs texts' ends are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, LIST_BYTES):
            counted = pc.value_counts(words_of(batch.column("text")).flatten())
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"])

    return map_arrow(docs.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _encoded(words: pa.Array, path: str) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: the batch, and where the ids of its strings begin and end among all ids."""
    batch = Batch(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())))
    return batch, *viterbi(batch, pieces(path))


def _bucket(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64) * 2654435761 >> 8) % (BUCKETS - 1)


def piece_neighbours(counts: DataFrame, path: str) -> DataFrame:
    """piece, bucket, n: how often a piece of the words follows (below BUCKETS) or precedes (from there on) each bucket of pieces.

    The last bucket of either is the word's edge, so the buckets below BUCKETS sum up to the piece's count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, begins, ends, ids = _encoded(batch.column("word"), path)
            weight = np.zeros(len(begins))
            weight[coded.which] = batch.column("n").to_numpy()
            sizes = ends - begins
            of = np.repeat(weight, sizes)
            flat = ids[spread(begins, sizes)]
            stops = np.cumsum(sizes)
            bucket = _bucket(flat)
            before = np.concatenate([[BUCKETS - 1], bucket[:-1]]) if len(flat) else bucket
            after = np.concatenate([bucket[1:], [BUCKETS - 1]]) if len(flat) else bucket
            before[(stops - sizes)[sizes > 0]] = BUCKETS - 1
            after[(stops - 1)[sizes > 0]] = BUCKETS - 1
            keys, at = np.unique(np.concatenate([flat.astype(np.int64) * 2 * BUCKETS + before, flat.astype(np.int64) * 2 * BUCKETS + BUCKETS + after]), return_inverse=True)
            n = np.bincount(at, np.concatenate([of, of]), minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys // (2 * BUCKETS)), pa.array(keys % (2 * BUCKETS)), pa.array(n.astype(np.int64))], names=["piece", "bucket", "n"])

    return map_arrow(counts.select("word", "n"), run, "piece bigint, bucket bigint, n bigint").groupBy("piece", "bucket").agg(F.sum("n").alias("n"))


def halves(seen: np.ndarray, rows: np.ndarray, depth: int) -> list[np.ndarray]:
    """``rows`` cut in two again and again, at the median of their first principal component."""
    if not depth:
        return [rows]
    spread_ = seen[rows] - seen[rows].mean(axis=0)
    axis = np.random.default_rng(0).standard_normal(seen.shape[1])
    for _ in range(30):
        axis = spread_.T @ (spread_ @ axis)
        axis /= np.linalg.norm(axis) + 1e-30
    order = rows[np.argsort(spread_ @ axis, kind="stable")]
    return [x for half in np.split(order, 2) for x in halves(seen, half, depth - 1)]


def shares_of(neighbours: DataFrame, n_docs: int, path: str) -> Shares:
    """From at most 32,000 figures by piece, and BUCKETS * 2 for each of OWN pieces, which the driver collects."""
    names = pieces(path).names
    if len(names) > OWN + SIDE * SIDE:
        raise ValueError(f"{path} has more pieces than the square holds")
    n = np.zeros(len(names))
    for row in neighbours.where(F.col("bucket") < BUCKETS).groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[row["piece"]] = row["n"]
    n[END] = n_docs
    by_count = np.argsort(-n, kind="stable")
    top, rest = by_count[:OWN], by_count[OWN:]
    place = np.full(len(names), -1)
    place[top] = np.arange(OWN)
    seen = np.zeros((OWN, 2 * BUCKETS))
    chosen = neighbours.sparkSession.createDataFrame([(int(p),) for p in top], "piece bigint")
    for row in neighbours.join(F.broadcast(chosen), "piece").collect():
        seen[place[row["piece"]], row["bucket"]] = row["n"]
    seen = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    group, member = np.full(len(names), GROUPS), np.zeros(len(names), dtype=np.int64)
    for k, rows in enumerate(halves(seen, np.arange(OWN), DEPTH)):
        group[top[rows]], member[top[rows]] = k, np.arange(MEMBERS)
    begins = np.array([names[i].startswith(SPACE) for i in rest])
    member[np.concatenate([rest[~begins], rest[begins]])] = np.arange(len(rest))
    smooth = n + 0.5
    groups = np.bincount(group, smooth, minlength=GROUPS + 1)
    members, own = np.zeros((GROUPS, MEMBERS)), group < GROUPS
    members[group[own], member[own]] = smooth[own] / groups[group[own]]
    square = np.full(SIDE * SIDE, 1e-6)
    square[member[~own]] = smooth[~own]
    square = square.reshape(SIDE, SIDE)
    rows = square.sum(axis=1, keepdims=True)
    return Shares(group, member, groups / groups.sum(), members, rows[:, 0] / rows.sum(), np.log(square / rows).astype(np.float32))


def coded_words(counts: DataFrame, path: str) -> DataFrame:
    """word, n and the word's ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, begins, ends, ids = _encoded(batch.column("word"), path)
            sizes = (ends - begins)[coded.which]
            stops = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            listed = pa.ListArray.from_arrays(stops, pa.array(ids[spread(begins[coded.which], sizes)], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), listed], names=["word", "n", "ids"])

    return map_arrow(counts.select("word", "n"), run, "word string, n bigint, ids array<int>")


def coded_texts(docs: DataFrame, frequent: pa.Table, n: int, v: int, path: str) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known and base_score of frequent words, the other words as ``rare``, and ``ids``.

    ``frequent`` has the pieces of its words, so that only the others are encoded for every slice of texts that has them.
    """
    listed = frequent.column("ids").combine_chunks()
    known_sizes = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    known_ids = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((frequent.column("word").combine_chunks(), frequent.column("n").to_numpy().astype(np.float64), known_sizes, known_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, known_sizes, known_ids = sent.value
        known_begins = np.cumsum(known_sizes) - known_sizes
        for batch in slices(batches, ARRAY_BYTES):
            lists = words_of(batch.column("text")).cast(pa.list_(pa.string()))
            text_sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            text_ends = np.cumsum(text_sizes)
            text_begins = text_ends - text_sizes
            flat = lists.flatten()
            distinct = flat.dictionary_encode()
            which = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.fill_null(pc.index_in(distinct.dictionary.cast(words.type), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = place >= 0
            coded, begins, ends, ids = _encoded(distinct.dictionary.filter(pa.array(~own)), path)
            begin, size = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
            begin[own], size[own] = known_begins[place[own]], known_sizes[place[own]]
            begin[~own], size[~own] = len(known_ids) + begins[coded.which], (ends - begins)[coded.which]
            ids = np.concatenate([known_ids, ids])
            place = place[which]
            sizes = size[which]
            text_pieces = sums(sizes, text_begins, text_ends)
            stop = np.cumsum(text_pieces + 1)
            all_ids = np.full(int(stop[-1]), END, dtype=np.int32)
            all_ids[spread(stop - text_pieces - 1, text_pieces)] = ids[spread(begin[which], sizes)]
            is_known = place >= 0
            c = np.where(is_known, counts[place] if len(counts) else 0, 0)
            base = np.where(is_known, np.log10((c + 0.5) / (n + 0.5 * (v + 1))), 0)
            lacking = np.concatenate([[0], np.cumsum(sums((~is_known).astype(np.int64), text_begins, text_ends))])
            rare = pa.ListArray.from_arrays(pa.array(lacking, pa.int32()), flat.filter(pa.array(~is_known)))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(all_ids))
            known = pa.array(sums(is_known.astype(np.int64), text_begins, text_ends))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(text_sizes + 1), known, pa.array(sums(base, text_begins, text_ends)), rare, listed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = map_arrow(docs, run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, rare array<string>, ids array<int>")
    return made.withColumn("row", F.monotonically_increasing_id())


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows again, TOKENS tokens at a time, with all tokens in a row and where each text begins and ends."""
    for batch in batches:
        sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // TOKENS
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)), batch.num_rows]
        for first, last in zip(edges, edges[1:]):  # noqa: B905
            part = batch.slice(first, last - first)
            stop = np.cumsum(sizes[first:last])
            yield part, part.column("ids").flatten().to_numpy(zero_copy_only=False), stop - sizes[first:last], stop


def averaged(ids: DataFrame, weights: Weights, shares: Shares, rate: float) -> Weights:
    """The weights after each task of ``ids`` has learned its rows from ``weights``, averaged by tokens."""
    sent = ids.sparkSession.sparkContext.broadcast((weights, shares))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shares = sent.value
        trainer = Trainer(now, shares, rate)
        for _, tokens, begins, ends in token_slices(batches):
            trainer.learn(tokens, begins, ends)
        change = np.zeros(-(-len(trainer.values) // CHUNK) * CHUNK, dtype=np.float64)
        change[: len(trainer.values)] = (trainer.values.astype(np.float64) - now.flat()) * trainer.seen
        yield _chunks(np.arange(len(change) // CHUNK), change, trainer.seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            values = batch.column("change").flatten().to_numpy(zero_copy_only=False).reshape(-1, CHUNK)
            for at, change, n in zip(batch.column("at").to_pylist(), values, batch.column("n").to_pylist(), strict=True):
                total[at], seen[at] = total.get(at, 0) + change, seen.get(at, 0) + n
        if total:
            yield _chunks(np.array(list(total)), np.concatenate(list(total.values())), np.array(list(seen.values())))

    kind = "at bigint, change array<double>, n bigint"
    changes = map_arrow(ids, learn, kind)
    flat = weights.flat().astype(np.float64)
    mean = np.zeros(-(-len(flat) // CHUNK) * CHUNK)
    for row in map_arrow(changes.repartition("at"), add, kind).collect():  # the weights, in rows of CHUNK
        mean[row["at"] * CHUNK : (row["at"] + 1) * CHUNK] = np.array(row["change"]) / max(row["n"], 1)
    sent.unpersist()
    return weights.filled((flat + mean[: len(flat)]).astype(np.float32))


def _chunks(at: np.ndarray, values: np.ndarray, n) -> pa.RecordBatch:
    listed = pa.FixedSizeListArray.from_arrays(pa.array(values), CHUNK).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(at), listed, pa.array(np.broadcast_to(n, len(at)).astype(np.int64))], names=["at", "change", "n"])


def fit(coded: DataFrame, shares: Shares) -> Weights:
    """Weights from the rows of ``coded`` that are no held-out ones; every one of their tokens is learned."""
    training = coded.where("NOT held_out").select("ids", F.pmod(F.xxhash64("row"), F.lit(PARTS[-1])).alias("part"))
    tokens = training.agg(F.sum(F.size("ids"))).first()[0] or 0
    weights = Weights.start(shares)
    if not tokens:
        return weights
    tasks = coded.rdd.getNumPartitions()
    for turn in range(min(PASSES, max(1, -(-LEAST_TOKENS // tokens)))):
        begin = 0
        for k, end in enumerate(PARTS):
            part = training.where((F.col("part") >= begin) & (F.col("part") < end)).select("ids")
            # a round has as many tasks as its share of the documents is worth
            part = part.coalesce(max(1, tasks * (end - begin) // PARTS[-1]))
            weights = averaged(part, weights, shares, RATE / (1 + (k + turn) / 2))
            begin = end
    return weights


def scored_rows(coded: DataFrame, weights: Weights, shares: Shares) -> DataFrame:
    """The rows of ``coded`` without words and pieces, with ``score``."""
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    sent = coded.sparkSession.sparkContext.broadcast((weights, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch, tokens, begins, ends in token_slices(batches):
            found = score_texts(scorer, tokens, begins, ends) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], names=[*kept, "score"])

    kinds = ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(coded.select(*kept, "ids"), run, f"{kinds}, score double")


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    marked = docs.select("doc_id", text_or_empty().alias("text"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    training = marked.where("NOT held_out")
    n_docs = training.count()
    counts = table(narrowed(word_counts(training), NEW_WORDS * n_docs))
    figures = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = figures["n"] + n_docs, figures["v"] + (n_docs > 0)
    often = (F.col("n") >= max(n / FREQUENT, 1)) & (F.length("word") <= LONGEST)
    coded = table(coded_texts(marked, coded_words(counts.where(often), path).toArrow(), n, v, path))
    shares = shares_of(table(narrowed(piece_neighbours(counts, path), v)), n_docs, path)
    scored = scored_rows(coded, fit(coded, shares), shares)
    total = F.lit(n + 0.5 * (v + 1))
    listed = coded.select("row", F.explode("rare").alias("word"))
    c = F.coalesce("n", F.lit(0))
    found = listed.join(counts.where(~often), "word", "left").groupBy("row").agg(F.count("n").alias("k"), F.sum(F.log10((c + 0.5) / total)).alias("b"))
    end = log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
    return narrowed(scored.join(found, "row", "left"), coded.count()).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0)) + end).alias("base_score"), "score",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), model_path())
