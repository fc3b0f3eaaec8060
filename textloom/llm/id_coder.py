"""Adaptive context-mixing range coder for token ids, many blocks at a time.

An id is coded as the one predicted by the two ids before it (order 2), else as the one predicted by
the id before it (order 1), else by its frequency (order 0). How much of the range each prediction
gets adapts within the block: to how often order 2 was right where it had done as well lately, and to
how often order 1 was right in its class. Order 2 learns within the block. Order 1 and the
frequencies come from a prior over the blocks that are coded together, which is kept beside them;
every block begins with it and with fresh adaptive state, so any block is decoded without the others.

numpy codes one id of every block of a group at each step. All arithmetic is on integers, the same on
every machine.
"""

from __future__ import annotations

import zlib
from zlib import crc32

import numpy as np

BLOCK = 1024
#: Slots of a block's order-2 table.
SLOTS = 512
#: Frequencies of ids add up to 2 ** ORDER_0; probabilities of predictions are in parts of 2 ** EVENT.
ORDER_0, EVENT, RATE = 20, 16, 5
#: Ids that come less often in a group predict no successor.
RARE = 4
#: Classes of order-1 predictions, by the share of times they hold in the whole group; grades of order 2.
CLASSES, GRADES = 8, 8
#: The coder's state has 64 bits and gives out 16 at a time.
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_U16, _U32, _U48, _ORDER_0, _LAST = (np.uint64(n) for n in (16, 32, 48, ORDER_0, (1 << ORDER_0) - 1))
_ALL, _EVENT, _STEP = np.uint32(1 << EVENT), np.uint32(EVENT), np.uint32((1 << EVENT - RATE) - 32)
#: Words that 32 steps may need at most.
_SPARE, _EVERY = 256, 32


class Prior:
    """What a group's blocks share: each id's frequency, most frequent successor and that one's class."""

    def __init__(self, used: np.ndarray, frequency: np.ndarray, successor: np.ndarray, share: np.ndarray):
        self.used, self.frequency, self.successor, self.share = used, frequency, successor, share
        self.width = np.zeros(1 << 16, np.uint64)
        self.width[used] = frequency
        self.begin = np.cumsum(self.width) - self.width
        #: The predicted id, and above its bits the class.
        self.next = np.zeros(1 << 16, np.int32)
        self.next[used] = successor.astype(np.int32) | share.astype(np.int32) << 16

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        """The prior of a group's ids, in order."""
        counts = np.bincount(ids, minlength=1 << 16)
        used = np.flatnonzero(counts)
        frequency = 1 + counts[used] * ((1 << ORDER_0) - len(used)) // max(1, len(ids))
        if len(used):
            frequency[np.argmax(frequency)] += (1 << ORDER_0) - frequency.sum()
        pairs = np.sort(ids[:-1].astype(np.uint32) << np.uint32(16) | ids[1:])
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(pairs)))
        first, then = (pairs[starts] >> np.uint32(16)).astype(np.int64), (pairs[starts] & np.uint32(0xFFFF)).astype(np.int64)
        order = np.argsort(times, kind="stable")  # of an id's successors the most frequent is written last
        best, most = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        best[first[order]], most[first[order]] = then[order], times[order]
        best[counts < RARE] = most[counts < RARE] = 0
        return cls(used, frequency, best[used], np.minimum(most[used] * CLASSES // counts[used], CLASSES - 1))

    def pack(self) -> bytes:
        columns = (np.diff(self.used, prepend=0), "<u2"), (self.frequency, "<u4"), (self.successor, "<u2"), (self.share, "u1")
        return zlib.compress(b"".join(column.astype(kind).tobytes() for column, kind in columns), 6)

    @classmethod
    def unpack(cls, packed: bytes) -> Prior:
        data = zlib.decompress(packed)
        n, at, columns = len(data) // 9, 0, []
        for kind, size in (("<u2", 2), ("<u4", 4), ("<u2", 2), ("u1", 1)):
            columns.append(np.frombuffer(data, kind, n, at).astype(np.int64))
            at += n * size
        return cls(np.cumsum(columns[0]), *columns[1:])

    def slots(self) -> np.ndarray:
        """The id that each part of the order-0 range belongs to."""
        return np.repeat(self.used.astype(np.uint16), self.frequency)


class _Model:
    """The state of a group of blocks."""

    def __init__(self, prior: Prior, lanes: int):
        self.prior = prior
        lane = np.arange(lanes)
        self.slot0, self.lane8 = lane * SLOTS, lane * 8
        #: The predicted id, and above its bits how well it did.
        self.table2 = np.zeros(lanes * SLOTS, np.int32)
        grades, classes = np.arange(GRADES), np.arange(CLASSES)
        self.chance2 = np.tile(((1 << EVENT) * (2 * grades + 1) // (2 * GRADES + 2)).astype(np.uint32), lanes)
        self.chance1 = np.tile(((1 << EVENT) * (2 * classes + 1) // (2 * CLASSES)).astype(np.uint32), lanes)
        self.last, self.mixed = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)

    def predict(self, m: int) -> None:
        """For the first m blocks: the predicted ids, and where the parts of order 2 and order 1 end."""
        last = self.last[:m]
        self.at2 = self.slot0[:m] + ((self.mixed[:m] ^ last * 40503) >> 3 & SLOTS - 1)
        entry2, entry1 = self.table2.take(self.at2).view(np.uint16), self.prior.next.take(last).view(np.uint16)
        self.p2, self.p1, self.grade = entry2[::2], entry1[::2], entry2[1::2]
        self.row2, self.row1 = self.lane8[:m] + self.grade, self.lane8[:m] + entry1[1::2]
        self.c2, self.c1 = self.chance2.take(self.row2), self.chance1.take(self.row1)
        #: No part is empty: chances stay between 31 and 2 ** EVENT - 900.
        self.end1 = self.c2 + np.maximum((_ALL - self.c2) * self.c1 >> _EVENT, 1)

    def ranges(self, x: np.ndarray, i2: np.ndarray, i1: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begin and width of each id's event, then those of the id within the event. i2 and i1: where order 2 and order 1 hold."""
        begin, width = self.end1.astype(np.uint64), (_ALL - self.end1).astype(np.uint64)
        begin[i2], width[i2] = 0, self.c2[i2]
        begin[i1], width[i1] = self.c2[i1], self.end1[i1] - self.c2[i1]
        first, share = self.prior.begin.take(x), self.prior.width.take(x)
        for where in (i2, i1):
            first[where], share[where] = 0, 1 << ORDER_0
        return begin, width, first, share

    def update(self, x: np.ndarray, i2: np.ndarray, i1: np.ndarray) -> None:
        m = len(x)
        c2, c1 = self.c2 - (self.c2 >> RATE), self.c1 - (self.c1 >> RATE)
        c2[i2] += _STEP
        c1[i1] += _STEP
        c1[i2] = self.c1[i2]
        self.chance2[self.row2], self.chance1[self.row1] = c2, c1
        entry = np.empty((m, 2), np.uint16)
        entry[:, 0], entry[:, 1] = x, self.grade >> 1
        entry[i2, 1] = np.minimum(self.grade[i2] + 1, GRADES - 1)
        self.table2[self.at2] = entry.view(np.int32).ravel()
        np.multiply(self.last[:m], 30011, out=self.mixed[:m])
        self.last[:m] = x


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with the longest first, and how many of them still go on at each step."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")


def _settled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose first 16 bits can go, and their ranges, cut where they are too small and those bits aren't settled."""
    apart = low ^ (low + span)
    where = np.flatnonzero((apart < TOP) | (span < BOTTOM))
    low, span = low[where], span[where]
    cut = np.flatnonzero(apart[where] >= TOP)
    span[cut] = (np.uint64(0) - low[cut]) & (BOTTOM - np.uint64(1))
    return where, span


def encode_blocks(blocks: list[np.ndarray]) -> tuple[bytes, list[bytes]]:
    """The packed prior, and the coded bytes of each block of at most BLOCK ids below 65,536."""
    prior = Prior.of(np.concatenate(blocks) if blocks else np.zeros(0, np.uint16))
    lengths = np.array([len(b) for b in blocks], np.int64)
    order, live = _order(lengths)
    n, steps = len(blocks), len(live)
    ids = np.zeros((n, steps), np.uint16)
    for lane, k in enumerate(order):
        ids[lane, : lengths[k]] = blocks[k]
    ids = np.ascontiguousarray(ids.T)
    model, low, span = _Model(prior, n), np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    out, at = np.zeros((n, steps // 2 + 2 * _SPARE), "<u2"), np.zeros(n, np.int64)
    for i in range(steps):
        if i % _EVERY == 0 and out.shape[1] - at.max() < _SPARE:
            out = np.pad(out, ((0, 0), (0, steps // 2 + _SPARE)))
        m = int(live[i])
        x = ids[i, :m]
        model.predict(m)
        is2, is1 = x == model.p2, x == model.p1
        i2, i1 = np.flatnonzero(is2), np.flatnonzero(is1 & ~is2)
        begin, width, first, part = model.ranges(x, i2, i1)
        share = span[:m] >> _U16
        width *= share
        begin *= share
        width >>= _ORDER_0
        first *= width
        begin += first
        width *= part
        low[:m] += begin
        span[:m] = width
        model.update(x, i2, i1)
        lanes, a, b = None, low[:m], width
        while True:
            where, b = _settled(a, b)
            if not len(where):
                break
            lanes, a = where if lanes is None else lanes[where], a[where]
            to = at[lanes]
            out[lanes, to] = a >> _U48
            at[lanes] = to + 1
            a, b = a << _U16, b << _U16
            low[lanes], span[lanes] = a, b
    last = low + (np.uint64(1 << 32) - np.uint64(1))  # 32 bits of it name a number in the range
    for shift in (_U48, _U32):
        out[np.arange(n), at] = (last >> shift) & np.uint64(0xFFFF)
        at += 1
    coded: list[bytes] = [b""] * n
    for lane, k in enumerate(order):
        coded[k] = out[lane, : at[lane]].tobytes() if lengths[k] else b""
    return prior.pack(), coded


def decode_blocks(packed: bytes, coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block; any of a group's blocks can be decoded with its prior."""
    prior = Prior.unpack(packed)
    slots = prior.slots()
    sizes = np.array(lengths, np.int64)
    order, live = _order(sizes)
    n, steps = len(coded), len(live)
    data = np.zeros((n, max(map(len, coded), default=0) // 2 + 8), "<u2")
    for lane, k in enumerate(order):
        data[lane, : len(coded[k]) // 2] = np.frombuffer(coded[k], "<u2")
    model, low, span = _Model(prior, n), np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    value, at = np.zeros(n, np.uint64), np.full(n, 4, np.int64)
    for k in range(4):
        value = value << _U16 | data[:, k]
    ids = np.zeros((steps, n), np.uint16)
    for i in range(steps):
        m = int(live[i])
        model.predict(m)
        share = span[:m] >> _U16
        ahead = value[:m] - low[:m]
        # What lies beyond the parts of order 2 and order 1 has its place there by order 0.
        rest, past = model.end1 * share, (_ALL - model.end1) * share >> _ORDER_0
        spot = (ahead - rest) // np.maximum(past, np.uint64(1))
        x = slots.take(np.minimum(spot, _LAST).astype(np.int64))
        early = np.flatnonzero(ahead < rest)
        second = ahead[early] < model.c2[early] * share[early]
        i2, i1 = early[second], early[~second]
        x[i2], x[i1] = model.p2[i2], model.p1[i1]
        begin, width, first, part = model.ranges(x, i2, i1)
        width *= share
        begin *= share
        width >>= _ORDER_0
        first *= width
        begin += first
        width *= part
        low[:m] += begin
        span[:m] = width
        ids[i, :m] = x
        model.update(x, i2, i1)
        lanes, a, b = None, low[:m], width
        while True:
            where, b = _settled(a, b)
            if not len(where):
                break
            lanes, a = where if lanes is None else lanes[where], a[where]
            to = np.minimum(at[lanes], data.shape[1] - 1)  # a damaged block may ask for more than there is
            value[lanes] = value[lanes] << _U16 | data[lanes, to]
            at[lanes] = to + 1
            a, b = a << _U16, b << _U16
            low[lanes], span[lanes] = a, b
    ids = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * n
    for lane, k in enumerate(order):
        out[k] = ids[lane, : sizes[k]]
    return out


def checksum(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u2").tobytes())
