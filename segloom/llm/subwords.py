"""Subword pieces of a SentencePiece model file, and the words of documents as a batch of distinct strings.

A text is cut at each space that follows another character. Every part stands for ``▁`` and its characters, spaces
as ``▁``: no piece has ``▁`` after another character, so no piece crosses such a cut. A batch's parts are encoded
once each, however often they occur.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .automaton import Automaton, Strings

SPACE = "▁"
NO_PIECE = -1


def parts_of(texts: pa.Array) -> pa.ListArray:
    """The parts of each text, strings without their first ``▁``; none for an empty or null text."""
    plain = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ").cast(pa.large_string())
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    space = raw == ord(" ")
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    full = np.diff(at) > 0
    cut[at[:-1][full]] = False  # a text's first character follows none
    before = np.concatenate([[0], np.cumsum(cut)])
    stops = np.sort(np.concatenate([np.flatnonzero(cut), at[1:][full]]))
    strings = pa.LargeStringArray.from_buffers(len(stops), pa.py_buffer(np.concatenate([[0], stops - before[stops]])), pa.py_buffer(raw[~cut])).cast(pa.string())
    ends = np.cumsum(before[at[1:]] - before[at[:-1]] + full)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), strings)


class Pieces:
    """The pieces of a model file, with an automaton over those that texts may hold."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError(f"{path} has pieces that cross words")
        self.names, self.plain = names, plain
        self.score = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        raw = [name.encode() for name in names]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw = pa.array(raw, pa.large_binary())
        self.automaton = Automaton({raw[i]: i for i in plain})


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Once for each Python worker."""
    return Pieces(path)


class Batch:
    """The parts of some texts: ``strings`` has the distinct ones, ``which`` each part's place among them, ``ends`` the texts' ends."""

    def __init__(self, parts: pa.ListArray, prefix: str = SPACE):
        flat = parts.flatten()
        coded = flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
        words = pc.replace_substring(coded.dictionary, " ", SPACE) if prefix else coded.dictionary
        words = pc.binary_join_element_wise(prefix, words, "").cast(pa.large_string())
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
        self.words = words
        self.strings = Strings(np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), at)
        self.which = self.strings.order[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else np.zeros(0, dtype=np.int64)
        sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes


def char_ends(strings: Strings, i: int, n: int) -> np.ndarray:
    """For the first ``n`` strings: the bytes of the character that ends with byte ``i``, or 0 where none ends there."""
    at = strings.start[:n] + i
    last = strings.length[:n] == i + 1
    after = strings.data[np.minimum(at + 1, len(strings.data) - 1)]
    ends = last | ((after & 0xC0) != 0x80)
    width = np.ones(n, dtype=np.int64)
    going = (strings.data[at] & 0xC0) == 0x80
    back = at
    while going.any():
        back = np.where(going, back - 1, back)
        width += going
        going = going & ((strings.data[back] & 0xC0) == 0x80)
    return np.where(ends, width, 0)


def sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of slices of ``values``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[begins]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``sizes[0]`` numbers, then those of ``starts[1]``, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
