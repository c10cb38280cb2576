"""Adaptive context-mixing range coder for blocks of ids.

An id is coded as its rank, ids of a file ordered by frequency. In each block three predictions are mixed:

* order 2 and order 1: the id that last followed the same two ids, or the same id, in this block;
* order 0: how often ids of each class of ranks came in this block (a class holds ranks of alike frequency).

How much each prediction weighs is learnt in the block too, per state of confidence of the two orders: the range is
split as n2 : n1 : n0, counts of how often each was right in that state. A rank has the part of order 2 if that predicts
it, or else that of order 1, or else its share by order 0 of the rest; order 0 learns from the last kind only. One
range-coder step codes it. All state starts anew in each block, so a block is read without any other. Blocks advance in
step with each other as the lanes of numpy arrays.
"""

from __future__ import annotations

import zlib

import numpy as np

U64 = np.uint64
#: Slots of the tables of order 1 and 2 in a block.
_SLOTS1, _SLOTS2 = 1 << 9, 1 << 10
#: The sum of class shares, after how many ids classes are weighed anew, and counts looked through.
_SCALE, _EVERY, _RARELY = 1 << 20, 64, 128
#: Range coder: 16 bits leave once they are settled, and the range is at least 2^40.
_TOP, _LEAST = U64(1 << 48), U64(1 << 40)
_MOST = (1 << 64) - 1
#: Counts n0, n1, n2 lie in ten bits each and are halved, when they are looked through, if their sum has reached this.
_HALVE = 255
_FIELDS = 0x1FF | 0x1FF << 10 | 0x1FF << 20
_HIT0, _HIT1, _HIT2 = np.int32(2), np.int32(2 << 10), np.int32(2 << 20)


def classes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First rank and size of each class of n ranks: four of one rank, then two of each power of two."""
    edges = [0, 1, 2, 3]
    step = 4
    while edges[-1] < n:
        edges += [step, step + step // 2]
        step *= 2
    edges = [x for x in edges if x < n] + [n]
    return np.array(edges[:-1], np.int64), np.diff(np.array(edges, np.int64))


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """Counts of a new block, and the least ones, by confidence of order 2, confidence of order 1, and whether both predict the same (then order 1 has no part)."""
    out, least = np.zeros(32, np.int32), np.zeros(32, np.int32)
    for q in range(32):
        c2, c1, same = q >> 3, q >> 1 & 3, q & 1
        n2, n1 = 1 + 6 * c2 + 6 * same, 0 if same else 1 + 3 * c1
        out[q] = 12 | n1 << 10 | n2 << 20
        least[q] = 1 | (not same) << 10 | 1 << 20
    return out, least


class _Model:
    """State of many blocks at the same id; begin() gives what the next ids may be, learn() takes what they were."""

    def __init__(self, lanes: int, ranks: int, shares: np.ndarray):
        base, size = classes(ranks)
        self.base, self.size = base.astype(np.int32), size.astype(np.int32)
        self.lanes, self.k = lanes, len(base)
        #: Cells of classes lie by class, then lane.
        self.of_rank = np.repeat(np.arange(self.k) * lanes, size)
        self.lane = np.arange(lanes)
        self.seen = np.repeat(shares.astype(np.int32), lanes)
        self.each, self.offset = np.empty_like(self.seen), np.empty_like(self.seen)
        self.inner = np.empty((self.k - 1, lanes), np.int32)
        #: Slots of order 1 of all lanes, then those of order 2, and where each lane's begin.
        self.slots = np.empty(lanes * (_SLOTS1 + _SLOTS2), np.int32)
        self.slots.fill(0)  # which numpy asks large pages for, other than np.zeros
        self.at1, self.at2, self.atq = self.lane * _SLOTS1, lanes * _SLOTS1 + self.lane * _SLOTS2, (self.lane * 32).astype(np.int32)
        prior, self.least = _prior()
        self.counts = np.tile(prior, lanes)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.at = np.empty((2, lanes), np.int64)
        self.steps = 0

    def begin(self) -> None:
        if self.steps % _EVERY == 0:
            seen, each, offset = (x.reshape(self.k, -1) for x in (self.seen, self.each, self.offset))
            # Doubles round alike everywhere, so reading finds what writing found.
            unit = _SCALE / seen.sum(0, dtype=np.int64)
            start = np.zeros(self.lanes, np.int32)
            for k in range(self.k):
                if k:
                    self.inner[k - 1] = start
                np.maximum((seen[k] * (unit / self.size[k])).astype(np.int32), 1, out=each[k])
                #: A rank's start by order 0 is offset + rank * each.
                np.subtract(start, self.base[k] * each[k], out=offset[k])
                start += each[k] * self.size[k]
            self.whole = start
        if self.steps % _RARELY == 0:
            n = self.counts
            full = np.flatnonzero((n & 0x3FF) + (n >> 10 & 0x3FF) + (n >> 20) >= _HALVE)
            halved = n[full] >> 1 & _FIELDS
            # No count of a prediction that may be right falls to zero.
            least = self.least[full & 31]
            n[full] = halved + (least & ~(halved | halved >> 1 | halved >> 2 | halved >> 3 | halved >> 4 | halved >> 5 | halved >> 6 | halved >> 7 | halved >> 8))
        self.steps += 1
        np.add(self.at1, self.last & (_SLOTS1 - 1), out=self.at[0])
        np.add(self.at2, (self.before * np.int32(0x9E3B) + self.last * np.int32(0x85D)) >> 2 & (_SLOTS2 - 1), out=self.at[1])
        v = self.v = self.slots.take(self.at)
        self.sure = v & 3
        self.p = v >> 2
        self.p1, self.p2 = self.p
        self.q = self.atq + (self.sure[1] << 3 | self.sure[0] << 1 | (self.p1 == self.p2))
        n = self.n = self.counts.take(self.q)
        whole = self.whole
        self.n0, self.m1, self.m2 = n & 0x3FF, (n >> 10 & 0x3FF) * whole, (n >> 20) * whole
        self.both = self.m1 + self.m2
        self.total = self.n0 * whole + self.both

    def _place(self, rank: np.ndarray, offset: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.where(self.hit2, 0, np.where(self.hit1, self.m2, self.both + self.n0 * (offset + rank * each)))
        return start, np.where(self.hit2, self.m2, np.where(self.hit1, self.m1, self.n0 * each))

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval of each lane's rank starts, and how long it is."""
        cell = self.cell = self.of_rank.take(rank) + self.lane
        self.hit2 = self.p2 == rank
        self.hit1 = (self.p1 == rank) & ~self.hit2
        return self._place(rank, self.offset.take(cell), self.each.take(cell))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank whose interval holds each lane's value, and that interval."""
        self.hit2 = value < self.m2
        self.hit1 = (value < self.both) & ~self.hit2
        # Quotients are exact in doubles; those of lanes that are predicted are not used.
        rest = (np.maximum(value - self.both, 0) / self.n0).astype(np.int32)
        cell = self.cell = (self.inner <= rest).view(np.int8).sum(0, dtype=np.int8).astype(np.int64) * self.lanes + self.lane
        offset, each = self.offset.take(cell), self.each.take(cell)
        rank = ((rest - offset) / each).astype(np.int32)
        start, size = self._place(rank, offset, each)
        return np.where(self.hit2, self.p2, np.where(self.hit1, self.p1, rank)), start, size

    def learn(self, rank: np.ndarray) -> None:
        hit1, hit2, v, sure = self.hit1, self.hit2, self.v, self.sure
        gain = np.where(hit2, _HIT2, np.where(hit1, _HIT1, _HIT0))
        self.seen[self.cell] += gain & np.int32(2)
        self.counts[self.q] = self.n + gain
        self.slots[self.at] = np.where(self.p == rank, np.minimum(v + 1, v | 3), np.where(sure > 0, v - 1, rank << 2))
        self.before, self.last = self.last, rank


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    return ((low ^ (low + span)) < _TOP) | (span < _LEAST)


def _cut(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A range too short that straddles a bound ends at the bound."""
    return np.where((low ^ (low + span)) < _TOP, span, (U64(0) - low) & (_LEAST - U64(1)))


def _width(n: int) -> int:
    """n words of 16 bits or more, an odd number of cache lines, so that rows do not meet in the same sets."""
    return (-(-n // 32) | 1) * 32


def encode(ranks: np.ndarray, n_ranks: int, shares: np.ndarray) -> list[bytes]:
    """The code of each row of ranks (blocks by ids), n_ranks in all."""
    lanes, length = ranks.shape
    model = _Model(lanes, n_ranks, shares)
    low, span = np.zeros(lanes, U64), np.full(lanes, _MOST, U64)
    width = _width(length * 2 + 8)
    out, at = np.empty(lanes * width, np.uint16), np.arange(lanes) * width
    for rank in np.ascontiguousarray(ranks.T, np.int32):
        model.begin()
        start, size = model.interval(rank)
        unit = span // model.total.astype(U64)
        low += unit * start.astype(U64)
        span = unit * size.astype(U64)
        todo = np.flatnonzero(_settled(low, span))
        while len(todo):
            lo, sp = low[todo], span[todo]
            sp = _cut(lo, sp)
            where = at[todo]
            out[where] = (lo >> U64(48)).astype(np.uint16)
            at[todo] = where + 1
            lo, sp = lo << U64(16), sp << U64(16)
            low[todo], span[todo] = lo, sp
            todo = todo[_settled(lo, sp)]
        model.learn(rank)
    for j in range(4):  # the rest of low
        out[at + j] = (low >> U64(48 - 16 * j)).astype(np.uint16)
    return [out[i : j + 4].astype("<u2").tobytes() for i, j in zip(range(0, len(out), width), at.tolist())]


def decode(codes: list[bytes], length: int, n_ranks: int, shares: np.ndarray) -> np.ndarray:
    """The ranks of each block (blocks by ids)."""
    lanes = len(codes)
    model = _Model(lanes, n_ranks, shares)
    sizes = np.array([len(c) // 2 for c in codes])
    width = _width(int(sizes.max()) + 8)
    words = np.empty((lanes, width), np.uint16)
    words.fill(0)
    for row, code in zip(words, codes):
        row[: len(code) // 2] = np.frombuffer(code, "<u2", len(code) // 2)
    words = words.reshape(-1)
    at = np.arange(lanes) * width
    last = at + width - 1
    low, span = np.zeros(lanes, U64), np.full(lanes, _MOST, U64)
    code = np.zeros(lanes, U64)
    for j in range(4):
        code = code << U64(16) | words[at + j]
    at += 4
    out = np.empty((length, lanes), np.int32)
    for i in range(length):
        model.begin()
        total = model.total.astype(U64)
        unit = span // total
        rank, start, size = model.find(np.minimum((code - low) // unit, total - U64(1)).astype(np.int32))
        low += unit * start.astype(U64)
        span = unit * size.astype(U64)
        todo = np.flatnonzero(_settled(low, span))
        while len(todo):
            lo, sp = low[todo], span[todo]
            sp = _cut(lo, sp)
            where = at[todo]
            code[todo] = code[todo] << U64(16) | words.take(np.minimum(where, last[todo]))
            at[todo] = where + 1
            lo, sp = lo << U64(16), sp << U64(16)
            low[todo], span[todo] = lo, sp
            todo = todo[_settled(lo, sp)]
        model.learn(rank)
        out[i] = rank
    return out.T


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids).astype("<u4").tobytes())
