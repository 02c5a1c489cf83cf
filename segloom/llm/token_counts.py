"""Token counts at every prefix of a text, as the library gives them for a byte-pair model of SentencePiece.

Encoding a text by merges leaves a row of pieces in which each two neighbours, encoded alone, stay as they are; and
only one piece can end a prefix so that this holds. So the encoding of every prefix is that of a shorter one and one
piece more: ``count[p] = count[p - size] + 1``. An automaton names the pieces that end at each byte; of these the one
that may follow the shorter prefix's last piece is taken. Which pairs stay apart is looked up, and asked of the
library only the first time that a worker meets a pair. Parts of a text (see ``subwords``) don't interact, so the count
of any prefix of the text is a sum over whole parts and one entry of the last part's table. No prefix is encoded anew.

Defined cases: a null text counts as empty and has no tokens; ``▁`` in a text counts as a space, as in the library;
texts of any length are read whole; repeated rows are counted each by itself; empty tables give no rows; other columns
pass through, and columns with the names of results are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read, slices, text_or_empty
from .piece_coding import model_path
from .subwords import Batch, Pieces, char_ends, parts_of, pieces, spread, sums

LIMIT = 4096
#: Pairs that a worker remembers, 9 bytes each, and those that it holds apart until it sorts them in.
MEMO, RECENT = 4_000_000, 4096
#: Bytes of text that a worker holds as arrays at a time.
TEXT_BYTES = 2 << 20
#: The piece before the first one, and that of a character without a piece: whatever may follow it.
FREE = -1


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


NOTHING = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    by = np.argsort(keys, kind="stable")
    return keys[by], np.concatenate([a[1], b[1]])[by]


class Neighbours:
    """Which pieces stay as they are side by side: what the library makes of them without a ``▁`` in front."""

    def __init__(self, model: Pieces):
        import sentencepiece

        # the last value of a field in a serialised message holds: normalizer_spec (3) with add_dummy_prefix (3) off
        bare = _field(3, 2, _field(3, 0, _varint(0)))
        with open(model.path, "rb") as f:
            self.encode = sentencepiece.SentencePieceProcessor(model_proto=f.read() + bare).encode
        self.names = model.names
        self.whole = np.zeros(len(model.names), dtype=bool)
        self.whole[[i for i, ids in zip(model.plain, self.encode([model.names[i] for i in model.plain], num_threads=1), strict=True) if ids == [i]]] = True
        self.known = self.recent = NOTHING  # sorted keys of pairs, and whether they stay apart

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * len(self.names) + right
        apart, unknown = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
        for have, answers in (self.known, self.recent):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                apart[hit] = answers[at[hit]]
                unknown &= ~hit
        if unknown.any():
            new = np.unique(keys[unknown])
            pairs = [divmod(k, len(self.names)) for k in new.tolist()]
            found = self.encode([self.names[a] + self.names[b] for a, b in pairs], num_threads=1)
            answers = np.array([ids == list(pair) for ids, pair in zip(found, pairs, strict=True)])
            apart[unknown] = answers[np.searchsorted(new, keys[unknown])]
            self.recent = _merged(self.recent, (new, answers))
            # what is new goes into a small table, so that the large one is sorted seldom
            if len(self.recent[0]) > RECENT + len(self.known[0]) // 4:
                self.known = _merged(self.known if len(self.known[0]) < MEMO else NOTHING, self.recent)
                self.recent = NOTHING
        return apart


@lru_cache(maxsize=2)
def neighbours(path: str) -> Neighbours:
    return Neighbours(pieces(path))


def prefix_counts(batch: Batch, model: Pieces, apart: Neighbours) -> np.ndarray:
    """For each slot of the batch's distinct parts, the tokens of the prefix that ends there; -1 inside of a character."""
    strings, automaton = batch.strings, model.automaton
    count = np.full(strings.slot[-1], -1, dtype=np.int64)
    last = np.full(strings.slot[-1], FREE, dtype=np.int32)
    count[strings.slot[:-1]] = 0
    for i, state in automaton.read(strings):
        n = len(state)
        here = strings.slot[:n] + i + 1
        shortest = np.zeros(n, dtype=np.int64)
        open_ = np.ones(n, dtype=bool)
        for rows, node in automaton.outputs(state):
            shortest[rows] = automaton.depth[node]
            todo = open_[rows]
            rows, node = rows[todo], node[todo]
            piece, before = automaton.own[node], here[rows] - automaton.depth[node]
            fits = (count[before] >= 0) & apart.whole[piece]
            rows, piece, before = rows[fits], piece[fits], before[fits]
            left = last[before]
            fits = left == FREE
            fits[~fits] = apart(left[~fits], piece[~fits])
            rows, piece, before = rows[fits], piece[fits], before[fits]
            count[here[rows]], last[here[rows]] = count[before] + 1, piece
            open_[rows] = False
        width = char_ends(strings, i, n)
        bare = np.flatnonzero((width > 0) & (shortest != width))  # a character without a piece is as many tokens as bytes
        count[here[bare]] = count[here[bare] - width[bare]] + width[bare]
    return count


def count_texts(texts: pa.Array, limit: int, model: Pieces, apart: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text, and the characters of its longest prefix of at most ``limit`` tokens."""
    batch = Batch(parts_of(texts))
    table, strings = prefix_counts(batch, model, apart), batch.strings
    ends = table[strings.slot[:-1] + strings.length]
    chars = np.diff(np.concatenate([[0], np.cumsum(table >= 0)])[strings.slot]) - 1 if len(ends) else ends
    by_part, chars_by_part = ends[batch.which], chars[batch.which]
    tokens, fit = sums(by_part, batch.begins, batch.ends), sums(chars_by_part, batch.begins, batch.ends) - (batch.ends > batch.begins)
    for k in np.flatnonzero(tokens > limit):
        which = batch.which[batch.begins[k] : batch.ends[k]]
        before = np.cumsum(ends[which]) - ends[which]
        sizes = strings.length[which] + 1
        slots = spread(strings.slot[which], sizes)
        good = (table[slots] >= 0) & (table[slots] + np.repeat(before, sizes) <= limit)
        whole = table[slots] >= 0
        whole[np.cumsum(sizes) - sizes] = False  # the empty prefix of a part is the end of the one before
        fit[k] = max(int(whole[: np.flatnonzero(good)[-1] + 1].sum()) - 1, 0)
    return tokens, fit


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_tokens``, and ``n_chars_fit``: the characters of the longest prefix of at most ``limit`` tokens."""
    made = lambda texts: [pa.array(x, pa.int64()) for x in count_texts(texts, limit, pieces(path), neighbours(path))]
    more = {"n_tokens": T.LongType(), "n_chars_fit": T.LongType()}
    return add_columns(df, text, made, more, lambda batches, name: slices(batches, TEXT_BYTES, name), keep_text)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, model_path(), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chars_fit")
