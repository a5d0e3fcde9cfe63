"""Adaptive context mixing and a range coder for token ids.

A stream of ids is cut into blocks.  Up to ``SET`` blocks that follow one
another are a set: they advance together, one id of each at a time, and share
one model, which starts fresh, so that a set is read by itself.  Before its
first block a set has the table of its ids and how often each occurs.  Inside a
set an id goes by its rank, the most frequent id first.

The distribution of the next id mixes three predictions: by order 2 (the id
last seen in the set after these two ids), by order 1 (after this one id), both
with weights that follow how often they were right at their present confidence,
and by order 0 (the table's counts).  The mixture's counts sum to a power of
two; they are laid out as order 2's part, order 1's and order 0's, and an id is
coded by one range-coder step in the first part that has it.

Sets advance together too, so that every numpy operation handles as many ids as
there are blocks, while the models of all sets stay small enough for a cache.
Where blocks of a set meet in a context, the last one's id is kept.  Weights
are brought up to date at fixed places of the block; predictions and
confidences after each id.

Coder state: ``range`` in [2^32, 2^48), 16-bit words out; carries are settled
at the end of a block.  Quotients of integers under 2^48 by floats are exact.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Blocks that share a model at most, and blocks that advance together, more or less.
SET = 256
TOGETHER = 2048
#: Bits of order-0 counts in all, or as many as the vocabulary has; of the mixture's weights; of the slots for contexts of a set.
ORDER_0 = 16
WEIGHT_BITS = 9
WEIGHTS = 1 << WEIGHT_BITS
SLOTS_1, SLOTS_2 = 13, 15
#: Bits of a prediction's confidence.
SURE_BITS = 4
SURE = (1 << SURE_BITS) - 1
#: What a confidence changes by, by (confidence, whether the prediction was right); one of 1 or less is given up for the id seen.
CHANGE = np.array([x for k in range(SURE + 1) for x in (-((k + 1) >> 1), int(k < SURE))], np.int32)
LOW, W16 = 32, 16
MASK, MIN, START = (1 << 32) - 1, 1 << 32, (1 << 48) - 1
#: Odd factors that spread two ranks over the slots.
SPREAD = np.array([-1640531535], np.int32), np.array([-2048144777], np.int32)
#: Larger vocabularies do not fit the mixture's counts.
VOCABULARY = 1 << 18


class Damaged(ValueError):
    """Bytes that are not what was written."""


def order_0_bits(vocabulary: int) -> int:
    if vocabulary > VOCABULARY:
        raise ValueError(f"a vocabulary has at most {VOCABULARY} ids")
    return max(ORDER_0, (vocabulary - 1).bit_length())


class Table:
    """A set's ids by rank, and the order-0 counts below and of each rank."""

    def __init__(self, ids: np.ndarray, seen: np.ndarray, bits: int):
        """ids ascend; seen tells how often each occurs."""
        order = np.argsort(-seen, kind="stable")
        self.ids = ids[order]
        below = np.cumsum(seen[order])
        # An id has a count of one and its share of the rest.
        end = below * ((1 << bits) - len(ids)) // below[-1] + np.arange(1, len(ids) + 1)
        self.below = np.r_[0, end[:-1]]
        self.count = end - self.below

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        rank = np.zeros(int(self.ids.max()) + 1, np.int32)
        rank[self.ids] = np.arange(len(self.ids), dtype=np.int32)
        return rank[ids]


def table_bytes(ids: np.ndarray, seen: np.ndarray) -> bytes:
    gaps = np.diff(ids, prepend=-1) - 1
    planes = np.concatenate([gaps, seen]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    packed = zlib.compress(planes.tobytes(), 6)
    return struct.pack("<II", len(ids), len(packed)) + packed


def table_of(data: bytes, vocabulary: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, how often each occurs, and the length of the table's bytes."""
    try:
        n, size = struct.unpack_from("<II", data)
        planes = np.frombuffer(zlib.decompress(data[8 : 8 + size]), np.uint8)
        flat = np.ascontiguousarray(planes.reshape(4, 2 * n).T).view("<u4").ravel().astype(np.int64)
    except (struct.error, zlib.error, ValueError) as e:
        raise Damaged("a set's table of ids") from e
    ids, seen = np.cumsum(flat[:n] + 1) - 1, flat[n:]
    if not n or ids[-1] >= vocabulary or seen.sum() != total:
        raise Damaged("a set's table of ids")
    return ids, seen, 8 + size


def refresh_places(longest: int) -> set[int]:
    """Where weights are brought up to date: 8, 16, 32, 64, 128, then every 256 ids."""
    return {x for x in (8, 16, 32, 64, 128) if x < longest} | set(range(256, longest, 256))


class Model:
    """The models of sets whose blocks are at the same place; of[b] is the set of block b."""

    def __init__(self, of: np.ndarray, tables: list[Table], bits: int, longest: int):
        n, sets = len(of), len(tables)
        self.bits = bits
        self.base_1, self.base_2 = of << SLOTS_1, of << SLOTS_2
        self.base_h1, self.base_h2 = of << SURE_BITS, of << (SURE_BITS + 1)
        # Prediction and confidence of each context.
        self.after_1, self.after_2 = np.zeros(sets << SLOTS_1, np.int32), np.zeros(sets << SLOTS_2, np.int32)
        # How often a prediction of a given confidence was right; what was looked at since the last time, times 2, and whether it was right.
        self.tried_1, self.tried_2 = np.full(sets << SURE_BITS, 16.0), np.full(sets << (SURE_BITS + 1), 16.0)
        self.right_1 = np.tile(np.linspace(0.2, 9.8, SURE + 1), sets)
        self.right_2 = np.tile(np.repeat(np.linspace(0.4, 13.6, SURE + 1), 2), sets)
        self.log_1, self.log_2 = np.zeros((longest, n), np.uint8), np.zeros((longest, n), np.uint8)
        self.below, self.count = (np.concatenate(x).astype(np.int32) for x in ([t.below for t in tables], [t.count for t in tables]))
        self.base_0 = np.cumsum([0, *(len(t.ids) for t in tables)])[of]
        self.last = np.zeros(n, np.int32)
        self.at_1, self.at_2 = self.base_1.copy(), self.base_2.copy()
        self.weigh()

    def weigh(self) -> None:
        self.share_1 = (self.right_1 * (480 / self.tried_1)).astype(np.int32)
        self.share_2 = (self.right_2 * (480 / self.tried_2)).astype(np.int32) + 1

    def refresh(self, since: int, t: int, m: int) -> None:
        """Weights from what was seen at places since to t; m blocks are still open."""
        for log, base, tried, right in ((self.log_1, self.base_h1, self.tried_1, self.right_1), (self.log_2, self.base_h2, self.tried_2, self.right_2)):
            found = np.bincount((log[since:t, :m] + (base[:m] << 1)).ravel(), minlength=2 * len(tried)).reshape(-1, 2)
            tried += found.sum(axis=1)
            right += found[:, 1]
        self.weigh()

    def predict(self, m: int) -> None:
        """The mixture for the next id of the first m blocks."""
        self.e_1, self.e_2 = self.after_1[self.at_1], self.after_2[self.at_2]
        self.p_1, self.p_2 = self.e_1 >> SURE_BITS, self.e_2 >> SURE_BITS
        # Confidences; that of order 2 with whether order 1 says the same, in which case it has no part.
        self.k_1, self.k_2 = self.e_1 & SURE, self.e_2 & SURE
        other = self.p_1 != self.p_2
        self.h_2 = self.k_2 + self.k_2 + other
        self.w_2 = self.share_2[self.base_h2[:m] + self.h_2]
        self.w_1 = (((WEIGHTS - self.w_2) * self.share_1[self.base_h1[:m] + self.k_1] >> WEIGHT_BITS) + 1) * other
        self.w_12 = self.w_1 + self.w_2
        self.w_0 = WEIGHTS - self.w_12

    def part(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Where x stands in the mixture, and its count."""
        at = self.base_0[:m] + x
        in_2, in_1 = self.p_2 == x, self.p_1 == x
        return self.parts(in_2, in_1, at)

    def parts(self, in_2: np.ndarray, in_1: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 2's part, order 1's, then order 0's for the rank at this place of the tables."""
        below, count = (self.w_12 << self.bits) + self.w_0 * self.below[at], self.w_0 * self.count[at]
        np.copyto(below, self.w_2 << self.bits, where=in_1)
        np.copyto(count, self.w_1 << self.bits, where=in_1)
        np.copyto(below, 0, where=in_2)
        np.copyto(count, self.w_2 << self.bits, where=in_2)
        return below, count

    def learn(self, x: np.ndarray, m: int, t: int) -> None:
        hit_1, hit_2 = self.p_1 == x, self.p_2 == x
        i_1, i_2 = self.k_1 + self.k_1 + hit_1, self.k_2 + self.k_2 + hit_2
        self.log_1[t, :m] = i_1
        self.log_2[t, :m] = self.h_2 + self.h_2 + hit_2
        fresh = x << SURE_BITS
        for after, at, e, i in ((self.after_1, self.at_1, self.e_1, i_1), (self.after_2, self.at_2, self.e_2, i_2)):
            e += CHANGE[i]
            np.copyto(e, fresh, where=(i & ~2) == 0)
            after[at] = e
        self.at_1 = self.base_1[:m] + (x & ((1 << SLOTS_1) - 1))
        mixed = x * SPREAD[0]
        mixed += self.last[:m] * SPREAD[1]
        mixed >>= 32 - SLOTS_2
        mixed &= (1 << SLOTS_2) - 1
        self.at_2 = self.base_2[:m] + mixed
        self.last = x

    def close(self, m: int) -> None:
        """From now on only the first m blocks are open."""
        self.at_1, self.at_2, self.last = self.at_1[:m], self.at_2[:m], self.last[:m]


def batches(sets: list[int]) -> list[list[int]]:
    """The places of blocks that advance together, longer sets of blocks never apart, about TOGETHER in each."""
    begin = [i for i in range(len(sets)) if not i or sets[i] != sets[i - 1]]
    parts = max(1, round(len(sets) / TOGETHER))
    out: list[list[int]] = []
    for low, high in zip(begin, [*begin[1:], len(sets)]):
        if not out or len(out) < parts and low * parts >= len(out) * len(sets):
            out.append([])
        out[-1] += range(low, high)
    return out


def by_length(part: list[int], sizes: list[int], sets: list[int]) -> tuple[list[int], np.ndarray, list[list[int]]]:
    """The part's blocks, longest first; their sets numbered from 0; the blocks of each set in order."""
    number: dict[int, int] = {}
    members: list[list[int]] = []
    for i in part:
        if sets[i] not in number:
            number[sets[i]] = len(members)
            members.append([])
        members[number[sets[i]]].append(i)
    part = sorted(part, key=lambda i: -sizes[i])
    return part, np.array([number[sets[i]] for i in part]), members


def open_blocks(sizes: np.ndarray, longest: int) -> list[int]:
    """For each place the number of blocks that reach it; sizes descend."""
    return np.searchsorted(-sizes, -np.arange(longest), "left").tolist()


def encode(blocks: list[np.ndarray], vocabulary: int, sets: list[int] | None = None) -> list[bytes]:
    """The coded words of each block (big-endian 16-bit), a set's table before its first block; blocks are not empty.

    sets has the number of each block's set, those of a set next to one another; by default each block is one.
    """
    sets = list(range(len(blocks))) if sets is None else sets
    bits, sizes = order_0_bits(vocabulary), [len(b) for b in blocks]
    out: list[bytes] = [b""] * len(blocks)
    for part in batches(sets) if blocks else []:
        part, of, members = by_length(part, sizes, sets)
        tables, heads = [], {}
        ranked: dict[int, np.ndarray] = {}
        for own in members:
            flat = np.concatenate([blocks[i] for i in own])
            seen = np.bincount(flat, minlength=1)
            ids = np.flatnonzero(seen)
            tables.append(Table(ids, seen[ids], bits))
            heads[own[0]] = table_bytes(ids, seen[ids])
            ranked.update(zip(own, np.split(tables[-1].ranks(flat), np.cumsum([sizes[i] for i in own])[:-1])))
        for i, words in zip(part, _encode([ranked[i] for i in part], of, tables, bits)):
            out[i] = heads.get(i, b"") + words
    return out


def _encode(blocks: list[np.ndarray], of: np.ndarray, tables: list[Table], bits: int) -> list[bytes]:
    n, longest = len(blocks), len(blocks[0])
    ranks = np.zeros((longest, n), np.int32)
    for k, b in enumerate(blocks):
        ranks[: len(b), k] = b
    open_at = open_blocks(np.array([len(b) for b in blocks]), longest)
    model, refresh, since = Model(of, tables, bits, longest), refresh_places(longest), 0
    low, width = np.zeros(n, np.int64), np.full(n, START, np.int64)
    # Two words an id at most.
    stride = longest * 2 + 8
    words, pos = np.zeros(n * stride, np.uint32), np.arange(n) * stride

    def put(i: np.ndarray) -> None:
        at, state = pos[i], low[i]
        words[at] = state >> LOW
        pos[i] = at + 1
        low[i] = (state & MASK) << W16

    m = n
    for t in range(longest):
        if open_at[t] < m:
            m = open_at[t]
            model.close(m)
        if t in refresh:
            model.refresh(since, t, m)
            since = t
        x = ranks[t, :m]
        model.predict(m)
        below, count = model.part(x, m)
        unit = width[:m] >> bits + WEIGHT_BITS
        low[:m] += unit * below
        unit *= count
        width[:m] = unit
        i = np.flatnonzero(unit < MIN)
        while len(i):
            put(i)
            wider = width[i] << W16
            width[i] = wider
            i = i[wider < MIN]
        model.learn(x, m, t)
    every = np.arange(n)
    for _ in range(3):
        put(every)
    words = words.reshape(n, stride)
    while (carry := words >> 16).any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
    return [words[k, : pos[k] - k * stride].astype(">u2").tobytes() for k in range(n)]


def decode(blocks: list[tuple[bytes, int]], vocabulary: int, sets: list[int] | None = None) -> list[np.ndarray]:
    """The ids of blocks given as (bytes as encode() gave them, number of ids)."""
    sets = list(range(len(blocks))) if sets is None else sets
    bits, sizes = order_0_bits(vocabulary), [s for _, s in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(blocks)
    for part in batches(sets) if blocks else []:
        part, of, members = by_length(part, sizes, sets)
        tables, coded = [], {i: blocks[i][0] for i in part}
        for own in members:
            ids, seen, size = table_of(coded[own[0]], vocabulary, sum(sizes[i] for i in own))
            tables.append(Table(ids, seen, bits))
            coded[own[0]] = coded[own[0]][size:]
        if any(len(c) < 6 or len(c) % 2 for c in coded.values()):
            raise Damaged("a block's length")
        for i, k, ranks in zip(part, of.tolist(), _decode([(coded[i], sizes[i]) for i in part], of, tables, bits)):
            out[i] = tables[k].ids[ranks].astype(np.int32)
    return out


@np.errstate(divide="ignore", invalid="ignore")  # a damaged block may run out of width
def _decode(blocks: list[tuple[bytes, int]], of: np.ndarray, tables: list[Table], bits: int) -> list[np.ndarray]:
    n, longest = len(blocks), blocks[0][1]
    open_at = open_blocks(np.array([s for _, s in blocks]), longest)
    coded = [np.frombuffer(b, ">u2") for b, _ in blocks]
    stride = max(map(len, coded)) + 4
    words = np.zeros((n, stride), np.uint16)
    for k, w in enumerate(coded):
        words[k, : len(w)] = w
    code = words[:, 0].astype(np.int64) << LOW | words[:, 1].astype(np.int64) << W16 | words[:, 2]
    words, pos, end = words.ravel(), np.arange(n) * stride + 3, np.arange(1, n + 1) * stride - 1
    model, refresh, since = Model(of, tables, bits, longest), refresh_places(longest), 0
    # The rank of every order-0 count.
    slots = np.concatenate([np.repeat(np.arange(len(t.ids), dtype=np.uint16 if bits <= 16 else np.int32), t.count) for t in tables])
    base = of << bits
    width = np.full(n, START, np.int64)
    ranks = np.zeros((longest, n), np.int32)
    m = n
    for t in range(longest):
        if open_at[t] < m:
            m = open_at[t]
            model.close(m)
        if t in refresh:
            model.refresh(since, t, m)
            since = t
        model.predict(m)
        unit = width[:m] >> bits + WEIGHT_BITS
        v = np.minimum((code[:m] / unit).astype(np.int32), (1 << bits + WEIGHT_BITS) - 1)
        begin = model.w_12 << bits
        in_2, in_12 = v < model.w_2 << bits, v < begin
        v -= begin
        np.copyto(v, 0, where=in_12)
        x = slots[base[:m] + (v / model.w_0).astype(np.int32)].astype(np.int32)
        below, count = model.parts(in_2, in_12, model.base_0[:m] + x)
        np.copyto(x, model.p_1, where=in_12)
        np.copyto(x, model.p_2, where=in_2)
        code[:m] -= unit * below
        unit *= count
        width[:m] = unit
        i = np.flatnonzero(unit < MIN)
        for _ in range(2):
            if not len(i):
                break
            here = np.minimum(pos[i], end[i])  # a damaged block may run on
            code[i] = code[i] << W16 | words[here]
            pos[i] = here + 1
            wider = width[i] << W16
            width[i] = wider
            i = i[wider < MIN]
        model.learn(x, m, t)
        ranks[t, :m] = x
    return [ranks[: blocks[k][1], k].copy() for k in range(n)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
