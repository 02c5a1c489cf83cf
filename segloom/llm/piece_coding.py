"""SentencePiece encoding and decoding: the segmentation of a text with the highest sum of piece scores.

An Aho-Corasick automaton over the pieces reads the text once; at each byte it follows the output links to relax the
best score of that position. Characters that no piece has become byte pieces. The decoder joins pieces and gives the
text back exactly, but for ``▁`` in a text, which counts as a space.

Defined cases: a null text counts as empty and has no pieces; of segmentations with one score the one with the longer
last piece is taken, from right to left; texts of any length are read whole; repeated rows are encoded each by itself;
empty tables give no rows; other columns pass through, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read, slices, text_or_empty
from .subwords import SPACE, Batch, Pieces, char_ends, parts_of, pieces, spread, sums

NO_WAY = -np.inf
#: Bytes of text, and rows of piece ids, that a worker holds as arrays at a time; a longer text makes a slice of its own.
TEXT_BYTES, ROWS = 2 << 20, 500


def viterbi(batch: Batch, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct part: where its piece ids begin and end among the ids, which come last."""
    strings, automaton = batch.strings, model.automaton
    score = np.full(strings.slot[-1], NO_WAY)
    came = np.zeros(strings.slot[-1], dtype=np.int32)  # the piece that ends here, or minus the bytes of a character without one
    count = np.zeros(strings.slot[-1], dtype=np.int64)
    score[strings.slot[:-1]] = 0
    for i, state in automaton.read(strings):
        n = len(state)
        here = strings.slot[:n] + i + 1
        shortest = np.zeros(n, dtype=np.int64)
        for rows, node in automaton.outputs(state):
            piece = automaton.own[node]
            size = automaton.depth[node]
            gained = score[here[rows] - size] + model.score[piece]
            better = gained > score[here[rows]]
            at = here[rows[better]]
            score[at], came[at], count[at] = gained[better], piece[better], count[at - size[better]] + 1
            shortest[rows] = size
        width = char_ends(strings, i, n)
        bare = np.flatnonzero((width > 0) & (shortest != width))
        gained = score[here[bare] - width[bare]]
        better = gained > score[here[bare]]  # no piece has the character, so there is no other way
        at, size = here[bare[better]], width[bare[better]]
        score[at], came[at], count[at] = gained[better], -size, count[at - size] + size
    n = len(strings.length)
    ends = np.cumsum(count[strings.slot[:-1] + strings.length]) if n else np.zeros(0, dtype=np.int64)
    begins = ends - (count[strings.slot[:-1] + strings.length] if n else 0)
    ids = np.zeros(int(ends[-1]) if n else 0, dtype=np.int32)
    left, put, rows = strings.length.copy(), ends.copy(), np.arange(n)
    while len(rows := rows[left[rows] > 0]):
        piece = came[strings.slot[rows] + left[rows]]
        own = piece >= 0
        size = np.where(own, model.size[np.maximum(piece, 0)], -piece)
        plain = rows[own]
        put[plain] -= 1
        ids[put[plain]] = piece[own]
        bare, width = rows[~own], size[~own]
        put[bare] -= width
        if len(bare):
            ids[spread(put[bare], width)] = model.byte_ids[strings.data[spread(strings.start[bare] + left[bare] - width, width)]]
        left[rows] -= size
    return begins, ends, ids


def encode_texts(texts: pa.Array, model: Pieces) -> pa.ListArray:
    """The piece ids of each text."""
    batch = Batch(parts_of(texts))
    begins, ends, ids = viterbi(batch, model)
    sizes = (ends - begins)[batch.which]
    n = sums(sizes, batch.begins, batch.ends)
    flat = ids[spread(begins[batch.which], sizes)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))


def decode_ids(ids: pa.ListArray, model: Pieces) -> pa.Array:
    """The text of each list of piece ids; bytes that are no UTF-8 become U+FFFD."""
    ends = np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = model.raw.take(ids.flatten())
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, dtype=np.int64)
    places = pa.py_buffer(at[np.concatenate([[0], ends]).astype(np.int64)])
    raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places, data or pa.py_buffer(b"")])
    try:
        texts = raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
    return pc.utf8_slice_codeunits(pc.replace_substring(texts, SPACE, " "), 1).cast(pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds the piece ids of ``text``, an array of ints, and with ``decoded`` the text that these stand for.

    ``path`` is the model file, which every executor has. A worker holds arrays for TEXT_BYTES of text at a time.
    """

    def made(texts: pa.Array) -> list[pa.Array]:
        model = pieces(path)
        found = encode_texts(texts, model)
        return [found, *([decode_ids(found, model)] if decoded else [])]

    more = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return add_columns(df, text, made, more, lambda batches, name: slices(batches, TEXT_BYTES, name), keep_text)


def decode(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the piece ids in ``ids`` stand for."""

    def few_rows(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
        return (batch.slice(k, ROWS) for batch in batches for k in range(0, batch.num_rows, ROWS))

    return add_columns(df, ids, lambda lists: [decode_ids(lists, pieces(path))], {text: T.StringType()}, few_rows)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces, as their number and a hash of all ids, and whether they decode to its text."""
    hashed = F.xxhash64(F.translate(text_or_empty(), SPACE, " ")).alias("text_hash")  # comes back in the text's place
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text", hashed), model_path(), decoded="decoded", keep_text=False)
    same = F.xxhash64("decoded") == F.col("text_hash")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), same.alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; nothing is dropped."""
    return encode(docs, model_path()).withColumn("n_pieces", F.size("piece_ids").cast("long"))
