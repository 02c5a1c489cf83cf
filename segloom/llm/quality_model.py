"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Words, and runs of ASCII punctuation, fall into BUCKETS by hash. Each bucket has an index vector of NONZERO random
signs; a bucket's word vector is the sum of the index vectors that stand within REACH of it in any document, scaled to
length one. Each task sums its own documents' vectors; the sums are added up by a shuffle of BUCKETS rows a task. A
document is the mean and the spread of its words' vectors, and its length. Two layers with softmax are trained on at
most TRAIN_ROWS labelled documents (the first by a hash, of labels and then of rows), one in five of which set the
temperature instead, so that shares of labels and scores agree.

Vectors come from all documents, labelled or not, and never from labels. Training rows are those whose CRC-32 of the
id leaves a remainder other than HELD_OUT; source, language and id are no inputs.

Defined cases: a null or blank text counts as one without words and gets the score of its length; documents with
several labels or rows with one id train by each; without labels of both kinds all scores are the share of good labels
(0.5 without any); repeated rows are scored each by itself; empty tables give no rows; other columns don't matter.
Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, slices, table

BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 32, 2, 2
TRAIN_ROWS, HIDDEN, EPOCHS, BATCH, RATE = 20_000, 32, 30, 64, 0.003
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bytes of text that a task holds as arrays at a time.
TEXT_BYTES = 4 << 20


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, and where each text's words end."""
    apart = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([!-/:-@\[-`{-~]+)", r" \1 ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(apart))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pandas().to_numpy(dtype=object)
    place = (pd.util.hash_array(distinct, categorize=False) % BUCKETS).astype(np.int64) if len(distinct) else np.zeros(0, dtype=np.int64)
    blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, dtype=bool)
    which = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    empty = blank[which]
    if empty.any():
        ends = np.concatenate([[0], np.cumsum(~empty)])[ends]
        which = which[~empty]
    return place[which], ends


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(0)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """[BUCKETS, WIDTH], each row of length one or zero; 2 MB whatever the input."""
    names = [f"v{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in slices(batches, TEXT_BYTES):
            word, ends = buckets_of(batch.column("text"))
            text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            for step in range(1, REACH + 1):
                a, b = word[:-step], word[step:]
                same = text[:-step] == text[step:]
                a, b = a[same], b[same]
                for k in range(NONZERO):
                    total += np.bincount(a * WIDTH + places[b, k], signs[b, k], BUCKETS * WIDTH)
                    total += np.bincount(b * WIDTH + places[a, k], signs[a, k], BUCKETS * WIDTH)
        total = total.reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(WIDTH))], names=["bucket", *names])

    summed = map_arrow(docs.select("text"), run, "bucket bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = np.zeros((BUCKETS, WIDTH))
    for row in summed.collect():
        found[row["bucket"]] = row[1:]
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the log of its length."""
    word, ends = buckets_of(texts)
    begins = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), 2 * WIDTH + 1), dtype=np.float32)
    some = np.flatnonzero(ends > begins)
    if len(some):
        n = (ends - begins)[some, None]
        mean = np.add.reduceat(vectors.take(word, axis=0), begins[some], axis=0, dtype=np.float32) / n
        square = np.add.reduceat(squares.take(word, axis=0), begins[some], axis=0, dtype=np.float32) / n
        out[some, :WIDTH], out[some, WIDTH:-1] = mean, np.sqrt(np.maximum(square - mean**2, 0))
    out[:, -1] = np.log1p(ends - begins)
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a good text, before the temperature."""
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.first_bias, 0)
        return (hidden @ self.second + self.second_bias)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam over EPOCHS passes; then the temperature of least loss on the rows that weren't used."""
    kept = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
    rest = ~kept
    rng = np.random.default_rng(0)
    share = np.clip(y.mean(), 0.001, 0.999) if len(y) else 0.5
    width = 2 * WIDTH + 1
    net = Network(np.zeros(width), np.ones(width), rng.standard_normal((width, HIDDEN)) * (2 / width) ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, 1)) * HIDDEN**-0.5, np.array([np.log(share / (1 - share))]))
    if len(set(y.tolist())) < 2:
        net.second[:] = 0
        return net
    net.centre, net.scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    z, y_ = (x[rest] - net.centre) / net.scale, y[rest, None]
    parts = [net.first, net.first_bias, net.second, net.second_bias]
    mean, square, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    steps = EPOCHS * -(-len(z) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for i in range(0, len(z), BATCH):
            rows = order[i : i + BATCH]
            t += 1
            pre = z[rows] @ net.first + net.first_bias
            hidden = np.maximum(pre, 0)
            d = (1 / (1 + np.exp(-np.clip(hidden @ net.second + net.second_bias, -30, 30))) - y_[rows]) / len(rows)
            dh = d @ net.second.T * (pre > 0)
            for p, g, m, s in zip(parts, [z[rows].T @ dh, dh.sum(axis=0), hidden.T @ d, d.sum(axis=0)], mean, square, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    if kept.any():
        raw = net.logits(x[kept])
        net.temperature = min(np.exp(np.linspace(np.log(0.3), np.log(10), 60)), key=lambda c: loss(raw / c, y[kept]))
    return net


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. ``labels`` has doc_id and quality (0 or 1)."""
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    chosen = usable.select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("y")).orderBy(F.xxhash64("__id"), "__id", "y").limit(TRAIN_ROWS)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = sent.value
        for batch in slices(batches, TEXT_BYTES):
            x = features(batch.column("text"), vectors, vectors**2)
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["order", "y", "x"])

    train = table(chosen)  # at most TRAIN_ROWS rows of two numbers
    joined = docs.join(F.broadcast(train), F.col("doc_id") == F.col("__id")).select(F.xxhash64("doc_id", "text").alias("order"), "y", "text")
    # rows of one id may be many; the first TRAIN_ROWS by hash train
    rows = map_arrow(joined, pooled, "order bigint, y double, x array<float>").orderBy("order", "y").limit(TRAIN_ROWS).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float32).reshape(-1, 2 * WIDTH + 1)
    net = fit(x, np.array([r["y"] for r in rows]))
    sent_net = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value, sent_net.value
        squares = vectors**2
        for batch in slices(batches, TEXT_BYTES):
            score = net.score(features(batch.column("text"), vectors, squares))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = map_arrow(docs.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")), run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
