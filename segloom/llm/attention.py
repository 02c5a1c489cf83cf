"""A causal self-attention model of one layer, in numpy: trained by gradient descent, scored in batches of windows.

Inputs are pieces: a frequent one has an embedding of its own, any other the sum of one for its row and one for its
column in a square of all others. The output is a softmax over groups, and within the wanted piece's group a softmax
over its members; in the last group, that of the square, over rows and then over the columns of the row. So every
piece has its own probability, from the same hidden state.

A window has 2 * STRIDE places. In training, windows lie side by side and every token is predicted from those before it
in its window. In scoring they are STRIDE apart and overlap: the second half is scored, so that each token of a text is
scored once, with STRIDE to 2 * STRIDE tokens of context.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np

STRIDE, WIDTH, HIDDEN = 8, 24, 48
PLACES = 2 * STRIDE
#: Groups of frequent pieces and members of each; rows and columns of the square of all others.
GROUPS, MEMBERS, SIDE = 32, 16, 179
OWN = GROUPS * MEMBERS
START = OWN + 2 * SIDE
#: Windows that are scored at a time; windows in the first step of training, in later ones at most, and how they grow.
AT_ONCE, BATCH, MOST, GROWTH, RATE = 512, 64, 512, 2, 0.01
BLOCK = 128  # tokens whose products are summed at a time
LAID_OUT = 1 << 15  # tokens of texts


@dataclass
class Weights:
    slots: np.ndarray  # own pieces, rows, columns, and one for the start of a text
    places: np.ndarray
    mix_in: np.ndarray  # to queries, keys and values
    mix_out: np.ndarray
    wide: np.ndarray
    wide_bias: np.ndarray
    narrow: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    inner: np.ndarray  # [GROUPS, WIDTH, MEMBERS]
    inner_bias: np.ndarray
    rows: np.ndarray
    rows_bias: np.ndarray
    columns: np.ndarray

    @classmethod
    def start(cls, share: Shares) -> Weights:
        rng = np.random.default_rng(0)
        some = lambda *shape: (rng.standard_normal(shape) * shape[-2] ** -0.5 * 0.5).astype(np.float32)
        flat = lambda x: np.log(x).astype(np.float32)
        slots = (rng.standard_normal((OWN + 2 * SIDE + 1, WIDTH)) * 0.1).astype(np.float32)
        return cls(
            slots, slots[:PLACES] * 0, some(WIDTH, 3 * WIDTH), some(WIDTH, WIDTH), some(WIDTH, HIDDEN), np.zeros(HIDDEN, dtype=np.float32), some(HIDDEN, WIDTH) * 0.1,
            some(WIDTH, GROUPS + 1) * 0.1, flat(share.groups), some(GROUPS, WIDTH, MEMBERS) * 0.1, flat(share.members), some(WIDTH, SIDE) * 0.1, flat(share.rows), some(WIDTH, SIDE) * 0.1,
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def filled(self, values: np.ndarray) -> Weights:
        """Weights of the same shapes, as views of ``values``."""
        made, at = [], 0
        for f in fields(self):
            old = getattr(self, f.name)
            made.append(values[at : at + old.size].reshape(old.shape))
            at += old.size
        return Weights(*made)


@dataclass
class Shares:
    """Where each piece belongs, and shares among all training tokens: of groups, of members of each, of rows, and the logs of
    those of the columns of each row, which stay as they are."""

    group: np.ndarray  # by piece; GROUPS for the square
    member: np.ndarray  # by piece: its place in the group, or row * SIDE + column
    groups: np.ndarray
    members: np.ndarray
    rows: np.ndarray
    log_columns: np.ndarray

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece and of the start, and the second slot of a piece in the square, -1 for others."""
        square = self.group == GROUPS
        row, column = np.divmod(self.member, SIDE)
        first, second = np.where(square, OWN + row, self.group * MEMBERS + self.member), np.where(square, OWN + SIDE + column, -1)
        return np.append(first, START).astype(np.int16), np.append(second, -1).astype(np.int16)


def embeddings(w: Weights, shares: Shares) -> np.ndarray:
    """The embedding of every piece, and that of the start as the last one."""
    first, second = shares.slots
    made = w.slots[first]
    square = np.flatnonzero(second >= 0)
    made[square] += w.slots[second[square]]
    return made


def side_by_side(begins: np.ndarray, ends: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """The first token of each window of texts that are slices of one row of tokens, and the text that it belongs to."""
    n = -(-(ends - begins) // stride)
    text = np.repeat(np.arange(len(n)), n)
    return begins[text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)), text


def inputs(ids: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at`` of windows, the piece before each (``start`` at a text's beginning), and which places there are."""
    there = (at >= begin[:, None]) & (at < end[:, None])
    before = ids.take(at - 1, mode="clip")
    return np.where(there & (at > begin[:, None]), before, start), there


_EARLIER = np.tril(np.ones((PLACES, PLACES), dtype=np.float32))
#: Logits within these need no maximum of their row subtracted before exp, which costs more than exp: no sum of a row over- or underflows.
BOUND = 60


def _bounded(x: np.ndarray) -> bool:
    return not x.size or bool(-BOUND < x.min() and x.max() < BOUND)


def _softmax(x: np.ndarray, shown: np.ndarray | None = None) -> np.ndarray:
    """Softmax over the last axis, in place, of the entries where ``shown`` is 1 and not 0."""
    if _bounded(x):
        np.exp(x, out=x)
        if shown is not None:
            x *= shown
    else:
        if shown is not None:
            x += (shown - 1) * np.float32(1e9)
        x -= x.max(axis=-1, keepdims=True)
        np.exp(x, out=x)
    total = x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)
    x *= (1 / total).reshape(*x.shape[:-1], 1)
    return x


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not _bounded(logits):
        logits -= logits.max(axis=-1, keepdims=True)
    found = logits.reshape(-1).take(np.arange(len(at)) * logits.shape[-1] + at)
    np.exp(logits, out=logits)
    return found - np.log(logits @ np.ones(logits.shape[-1], dtype=logits.dtype))


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their group, and where each group begins among them."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    return order, np.searchsorted(group[order], np.arange(GROUPS + 2))


class Room:
    """Arrays by name that are used again: with new ones, a quarter of a large step's time went into their pages."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, dtype=self.kind)
        return self.held[name][:n].reshape(shape)

    def with_ones(self, name: str, n: int) -> np.ndarray:
        """Rows of WIDTH values and a one, so that a product with a bias below the weights adds it, and gives its derivatives."""
        made = self(name, n, WIDTH + 1)
        made[:, WIDTH] = 1
        return made


class Scorer:
    """Queries, keys and values of all pieces and places made once, so that a window needs gathers, a few products and softmaxes."""

    def __init__(self, w: Weights, shares: Shares):
        self.w, self.shares = w, shares
        pieces = embeddings(w, shares)
        scale = np.ones(3 * WIDTH, dtype=np.float32)
        scale[:WIDTH] = WIDTH**-0.5
        mixed, place = pieces @ w.mix_in * scale, w.places @ w.mix_in * scale
        self.now = np.concatenate([mixed[:, :WIDTH], pieces], axis=1)  # a place that is scored: its query and itself
        self.now_place = np.concatenate([place[:, :WIDTH], w.places], axis=1)[STRIDE:]
        self.seen, self.key_place, self.value_place = mixed[:, WIDTH:].copy(), place[:, WIDTH : 2 * WIDTH], place[:, 2 * WIDTH :].copy()
        self.wide, self.out, self.rows = np.vstack([w.wide, w.wide_bias]), np.vstack([w.out, w.bias]), np.vstack([w.rows, w.rows_bias])
        self.inner = np.concatenate([w.inner, w.inner_bias[:, None]], axis=1)
        self.room = Room(w.slots.dtype)

    def log_shares(self, x: np.ndarray, bare: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of the pieces ``wanted``, STRIDE for each window.

        ``x`` has STRIDE inputs more, those before the first window's; windows follow each other, so each has its context
        in the one before it, but for ``bare`` ones, which have none.
        """
        w, room, n, size = self.w, self.room, len(bare), len(wanted)
        seen = self.seen.take(x, axis=0, out=room("seen", len(x), 2 * WIDTH), mode="clip")
        step, one = seen.strides
        windows = np.lib.stride_tricks.as_strided(seen, (n, PLACES, 2 * WIDTH), (STRIDE * step, step, one), writeable=False)
        now = self.now.take(x[STRIDE:], axis=0, out=room("now", size, 2 * WIDTH), mode="clip")
        now.reshape(n, STRIDE, 2 * WIDTH)[...] += self.now_place
        q = now[:, :WIDTH]
        a = np.matmul(q.reshape(n, STRIDE, WIDTH), windows[..., :WIDTH].transpose(0, 2, 1), out=room("a", n, STRIDE, PLACES))
        a.reshape(size, PLACES)[...] += np.matmul(q, self.key_place.T, out=room("a_place", size, PLACES))
        shown = room("shown", n, STRIDE, PLACES)
        shown[...] = _EARLIER[STRIDE:]
        shown[bare, :, :STRIDE] = 0
        a = _softmax(a, shown)
        c = np.matmul(a, windows[..., WIDTH:], out=room("c", n, STRIDE, WIDTH)).reshape(size, WIDTH)
        c += np.matmul(a.reshape(size, PLACES), self.value_place, out=room("c_place", size, WIDTH))
        y1, z1 = room.with_ones("y", size), room.with_ones("z", size)
        y, z = y1[:, :WIDTH], z1[:, :WIDTH]
        np.matmul(c, w.mix_out, out=y)
        y += now[:, WIDTH:]
        high = np.matmul(y1, self.wide, out=room("high", size, HIDDEN))
        np.maximum(high, 0, out=high)
        np.matmul(high, w.narrow, out=z)
        z += y
        order, begin = _by_group(self.shares.group.take(wanted))
        target = wanted.take(order)
        z1 = z1.take(order, axis=0, out=room("sorted", size, WIDTH + 1), mode="clip")
        member = self.shares.member.take(target)
        found = _log_share(np.matmul(z1, self.out, out=room("groups", size, GROUPS + 1)), self.shares.group.take(target))
        own, rest = slice(0, begin[GROUPS]), slice(begin[GROUPS], size)
        inner = room("members", begin[GROUPS], MEMBERS)
        for k in range(GROUPS):
            mine = slice(begin[k], begin[k + 1])
            np.matmul(z1[mine], self.inner[k], out=inner[mine])
        found[own] += _log_share(inner, member[own])
        if begin[GROUPS] < size:
            row, column = np.divmod(member[rest], SIDE)
            found[rest] += _log_share(z1[rest] @ self.rows, row)
            found[rest] += _log_share(z1[rest, :WIDTH] @ w.columns + self.shares.log_columns[row], column)
        logs = np.empty_like(found)
        logs[order] = found
        return logs


def _over_rows(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``x.T @ d``, BLOCK rows at a time: for BLAS many small products take three fifths of the time of a long one."""
    n = len(x) - len(x) % BLOCK
    made = np.matmul(x[:n].reshape(-1, BLOCK, x.shape[1]).transpose(0, 2, 1), d[:n].reshape(-1, BLOCK, d.shape[1])).sum(axis=0)
    return made + x[n:].T @ d[n:] if n < len(x) else made


def gradients(w: Weights, shares: Shares, x: np.ndarray, there: np.ndarray, wanted: np.ndarray, room: Room | None = None) -> tuple[float, Weights]:
    """Mean loss of the tokens that there are, and its derivatives, which hold until ``room`` is used again.

    ``x`` has pieces, the number of pieces for the start.
    """
    kind = w.slots.dtype
    room = room or Room(kind)
    flat_x = x.ravel()
    size, shape = len(flat_x), (*x.shape, WIDTH)
    one, two = (slot.take(flat_x) for slot in shares.slots)
    square = np.flatnonzero(two >= 0)
    h = w.slots.take(one, axis=0, out=room("h", size, WIDTH), mode="clip")
    h[square] += w.slots[two[square]]
    h.reshape(shape)[...] += w.places
    mix_in = w.mix_in.copy()
    mix_in[:, :WIDTH] *= kind.type(WIDTH**-0.5)
    mixed = np.matmul(h, mix_in, out=room("mixed", size, 3 * WIDTH)).reshape(*x.shape, 3 * WIDTH)
    q, k, v = mixed[..., :WIDTH], mixed[..., WIDTH : 2 * WIDTH], mixed[..., 2 * WIDTH :]
    a = _softmax(np.matmul(q, k.transpose(0, 2, 1), out=room("a", *x.shape, PLACES)), _EARLIER)
    c = np.matmul(a, v, out=room("c", *shape)).reshape(-1, WIDTH)
    y1, z1 = room.with_ones("y", size), room.with_ones("z", size)
    y, z = y1[:, :WIDTH], z1[:, :WIDTH]
    np.matmul(c, w.mix_out, out=y)
    y += h
    high = np.matmul(y1, np.vstack([w.wide, w.wide_bias]), out=room("high", size, HIDDEN))
    np.maximum(high, 0, out=high)
    np.matmul(high, w.narrow, out=z)
    z += y
    # from here on tokens that there are, in the order of the groups of the wanted pieces
    used = slice(None) if (full := there.all()) else np.flatnonzero(there.ravel())
    target = wanted.ravel()[used]
    order, begin = _by_group(shares.group.take(target))
    target, place = target.take(order), order if full else used.take(order)
    n = len(target)
    group, member = shares.group.take(target), shares.member.take(target)
    z1 = z1.take(place, axis=0, out=room("sorted", n, WIDTH + 1), mode="clip")

    def losses(logits: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        p = _softmax(logits)
        all_p, wanted_at = p.reshape(-1), np.arange(len(p)) * p.shape[1] + at
        found = all_p.take(wanted_at)
        all_p[wanted_at] = found - 1
        return -float(np.log(found + 1e-20).sum()), p

    flat = room("g", sum(getattr(w, f.name).size for f in fields(w)))
    g = w.filled(flat)
    loss, d = losses(np.matmul(z1, np.vstack([w.out, w.bias]), out=room("groups", n, GROUPS + 1)), group)
    dz = np.matmul(d, w.out.T, out=room("dz_sorted", n, WIDTH))
    g_out = _over_rows(z1, d)
    g.out[...], g.bias[...] = g_out[:-1], g_out[-1]
    inner, g_inner = np.concatenate([w.inner, w.inner_bias[:, None]], axis=1), np.zeros((GROUPS, WIDTH + 1, MEMBERS), dtype=kind)
    logits, more_dz = room("members", begin[GROUPS], MEMBERS), room("dz_members", begin[GROUPS], WIDTH)
    parts = [(j, slice(begin[j], begin[j + 1])) for j in range(GROUPS) if begin[j] < begin[j + 1]]
    for j, mine in parts:
        np.matmul(z1[mine], inner[j], out=logits[mine])
    more, d = losses(logits, member[: begin[GROUPS]])
    loss += more
    for j, mine in parts:
        np.matmul(z1[mine].T, d[mine], out=g_inner[j])
        np.matmul(d[mine], w.inner[j].T, out=more_dz[mine])
    dz[: begin[GROUPS]] += more_dz
    g.inner[...], g.inner_bias[...] = g_inner[:, :-1], g_inner[:, -1]
    rest = slice(begin[GROUPS], n)
    row, column = np.divmod(member[rest], SIDE)
    more, d_row = losses(z1[rest] @ np.vstack([w.rows, w.rows_bias]), row)
    again, d_column = losses(z1[rest, :WIDTH] @ w.columns + shares.log_columns[row], column)
    loss += more + again
    dz[rest] += d_row @ w.rows.T + d_column @ w.columns.T
    g_rows = z1[rest].T @ d_row
    g.rows[...], g.rows_bias[...], g.columns[...] = g_rows[:-1], g_rows[-1], z1[rest, :WIDTH].T @ d_column
    dz_sorted, dz = dz, room("dz", size, WIDTH)
    if not full:
        dz[...] = 0
    dz[place] = dz_sorted
    g.narrow[...] = _over_rows(high, dz)
    d_high = np.matmul(dz, w.narrow.T, out=room("d_high", size, HIDDEN))
    d_high *= high > 0
    dy = np.matmul(d_high, w.wide.T, out=room("dy", size, WIDTH))
    dy += dz
    g_wide = _over_rows(y1, d_high)
    g.wide[...], g.wide_bias[...] = g_wide[:-1], g_wide[-1]
    g.mix_out[...] = _over_rows(c, dy)
    dc = np.matmul(dy, w.mix_out.T, out=room("dc", size, WIDTH)).reshape(shape)
    d_mixed = room("d_mixed", *x.shape, 3 * WIDTH)
    da = np.matmul(dc, v.transpose(0, 2, 1), out=room("da", *a.shape))
    np.matmul(a.transpose(0, 2, 1), dc, out=d_mixed[..., 2 * WIDTH :])
    da -= np.einsum("wij,wij->wi", da, a)[..., None]
    da *= a
    np.matmul(da, k, out=d_mixed[..., :WIDTH])
    np.matmul(da.transpose(0, 2, 1), q, out=d_mixed[..., WIDTH : 2 * WIDTH])
    d_mixed = d_mixed.reshape(-1, 3 * WIDTH)
    g.mix_in[...] = _over_rows(h, d_mixed)
    g.mix_in[:, :WIDTH] *= kind.type(WIDTH**-0.5)
    dh = np.matmul(d_mixed, mix_in.T, out=room("dh", size, WIDTH))
    dh += dy
    g.places[...] = (np.ones(len(x), dtype=kind) @ dh.reshape(len(x), -1)).reshape(PLACES, WIDTH)
    g.slots[...] = 0
    for slot, rows in ((one, None), (two[square], square)):
        if len(slot):
            by = np.argsort(slot, kind="stable")
            ordered = slot.take(by)
            starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
            moved = dh.take(by if rows is None else rows[by], axis=0, out=room("moved", len(by), WIDTH), mode="clip")
            g.slots[ordered[starts]] += np.add.reduceat(moved, starts, axis=0)
    n = max(n, 1)
    flat /= n
    return loss / n, g


class Trainer:
    """Adam over windows in the order in which they come, mixed within what ``learn`` is given; rates fall from step to step."""

    def __init__(self, w: Weights, shares: Shares, rate: float = RATE):
        self.values = w.flat()
        self.w, self.shares, self.rate = w.filled(self.values), shares, rate
        self.mean, self.square, self.steps = np.zeros_like(self.values), np.zeros_like(self.values), 0
        self.room = Room(self.values.dtype)
        self.seen = 0  # tokens

    def learn(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> float:
        """One pass over the windows of some texts; the mean loss by token."""
        first, text = side_by_side(begins, ends, PLACES)
        order = np.random.default_rng(self.steps).permutation(len(first))
        total, i = 0.0, 0
        while i < len(order):
            chosen = order[i : i + min(MOST, BATCH + self.steps // GROWTH)]
            i += len(chosen)
            at = first[chosen][:, None] + np.arange(PLACES)
            x, there = inputs(ids, at, begins[text[chosen]], ends[text[chosen]], len(self.shares.group))
            loss, g = gradients(self.w, self.shares, x, there, ids[np.minimum(at, len(ids) - 1)], self.room)
            total += loss * int(there.sum())
            self._step(g.flat())
        self.seen += int((ends - begins).sum())
        return total / max(int((ends - begins).sum()), 1)

    def _step(self, g: np.ndarray) -> None:
        self.steps += 1
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.005 * (g * g - self.square)
        rate = self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 300) ** 0.5
        self.values -= rate * (self.mean / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.995**self.steps)) + 1e-6)


def score_texts(scorer: Scorer, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The natural log of each text's probability; LAID_OUT tokens, and the rest of the last text, are laid out at a time."""
    some = np.cumsum(ends - begins) // LAID_OUT
    edges = [*np.flatnonzero(np.diff(some, prepend=-1)), len(some)]
    return np.concatenate([np.zeros(0), *(_scored(scorer, ids, begins[a:b], ends[a:b]) for a, b in zip(edges, edges[1:]))])  # noqa: B905


def _scored(scorer: Scorer, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of one text or more; arrays of numbers by token are made for AT_ONCE windows at a time.

    The texts are laid out in blocks of STRIDE tokens, each text behind a block of starts. A block is scored with the one
    before it as its context; the blocks of starts are gone through too, and count nothing.
    """
    n = -(-(ends - begins) // STRIDE)
    stop = np.cumsum(n + 1)
    first = stop - n  # a text's first block
    sizes = ends - begins
    before = np.cumsum(sizes) - sizes
    tokens = np.arange(int(sizes.sum()))
    to = np.repeat(first * STRIDE - before, sizes) + tokens
    there = np.zeros(int(stop[-1]) * STRIDE, dtype=bool)
    there[to] = True
    wanted, x = np.zeros(len(there), dtype=ids.dtype), np.empty(len(there), dtype=ids.dtype)
    wanted[to] = ids[np.repeat(begins - before, sizes) + tokens]
    x[1:] = wanted[:-1]
    x.reshape(-1, STRIDE)[first - 1] = x[first[sizes > 0] * STRIDE] = len(scorer.shares.group)
    bare = np.zeros(len(there) // STRIDE + 1, dtype=bool)
    bare[first] = True
    total = np.zeros(len(there) // STRIDE + 1)
    for i in range(1, len(there) // STRIDE, AT_ONCE):
        last = min(i + AT_ONCE, len(there) // STRIDE)
        one = slice(i * STRIDE, last * STRIDE)
        logs = scorer.log_shares(x[(i - 1) * STRIDE : last * STRIDE], bare[i:last], wanted[one])
        logs[~there[one]] = 0
        total[i + 1 : last + 1] = logs.reshape(-1, STRIDE).sum(axis=1, dtype=np.float64)
    total = np.cumsum(total)
    return total[stop] - total[first]
