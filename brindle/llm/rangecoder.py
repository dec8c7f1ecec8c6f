"""Adaptive context-mixing range coder for token ids, blocks in step.

Each block is coded on its own: its models start afresh and its ids have a checksum. An id's
probability is a mix of three predictions: of order 2 and of order 1, by tables keyed by the last two ids and the
last one, which learn within the block, and of order 0, by a prior that all blocks share (``prior`` counts
it; without one all ids are alike). The shares of the mix adapt within the block, apart by the tables'
confidence and by whether they agree. What the tables foretell is coded by its share, any other id by the rest's share times
its prior. All arithmetic is on integers, so decoding repeats it exactly. The coder keeps 64-bit
``low`` and ``range``, carries into words that are out, and moves 32 bits at a time.

A NumPy operation works on the same position of all blocks at once ("lanes"), on both tables in one
array, into arrays that stay. A lane whose block has ended runs on unread.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block; bits of a table index, of a share, of the prior; most lanes.
BLOCK, TABLE_BITS, PROB, PRIOR, LANES = 4096, 7, 12, 18, 2048
#: The least share of a table's prediction; what the share of one that holds gains; how fast shares move.
_LEAST, _GAIN, _RATE = 16, (1 << PROB) - 96, 4
#: A table's entry is a prediction and, above 16 bits, its confidence of 0 to 3 in these units (order 2, order 1).
_UNITS = np.array([[8], [2]], np.uint32)
_U = np.uint64
_WORD = _U(32)
_FULL = _U(1 << 32)
_PROB, _PRIOR, _LAST = _U(PROB), _U(PRIOR), _U((1 << PRIOR) - 1)
_ONE, _TWO, _HALF, _LOW = np.uint32(0x9E3779B1), np.uint32(0x2545F491), np.uint32(16), np.uint32(0xFFFF)
_INDEX, _GAINED, _FLOOR, _SLOW = np.uint32(32 - TABLE_BITS), np.uint32(_GAIN), np.int32(_LEAST), np.int32(_RATE)
#: First shares by confidence, of order 2 and of order 1.
_FIRST = ((16, 400, 1600, 3200), (16, 100, 400, 1000))


class Corrupt(ValueError):
    pass


def prior(ids: np.ndarray) -> np.ndarray:
    """Shares of all ids in 2 ** PRIOR by their number; one at least for each that occurs."""
    counts = np.bincount(ids, minlength=1 << 16).astype(np.int64)
    if not len(ids):
        return np.full(1 << 16, 1 << (PRIOR - 16), np.uint32)
    occurs = counts > 0
    freq = occurs + counts * ((1 << PRIOR) - int(occurs.sum())) // len(ids)
    freq[counts.argmax()] += (1 << PRIOR) - int(freq.sum())
    return freq.astype(np.uint32)


class _Models:
    """Predictions, shares and prior of ``n`` lanes; of pairs of rows the first is order 2, the second order 1."""

    def __init__(self, n: int, freq: np.ndarray | None):
        freq = prior(np.zeros(0, np.int64)) if freq is None else freq
        self.freq = freq.astype(_U)
        self.start = np.cumsum(self.freq) - self.freq
        self.table = np.zeros(2 * n << TABLE_BITS, np.uint32)
        self.base = (np.arange(2 * n) << TABLE_BITS).reshape(2, n)
        c2, c1, agree = (a.ravel() for a in np.indices((4, 4, 2)))
        f2, f1 = np.array(_FIRST[0])[c2], np.where(agree, _LEAST, np.array(_FIRST[1])[c1])
        self.shares = np.tile((f2 | np.minimum(f1, _GAIN - f2 + _LEAST) << 16).astype(np.uint32), n)
        self.lane, self.own = np.arange(n), np.arange(n) << 5
        self.prev, self.mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.entry, self.pred, self.conf, self.share, self.goal = (np.zeros((2, n), np.uint32) for _ in range(5))
        self.key, self.at, self.pick = np.zeros((2, n), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.unit, self.most = np.repeat(_UNITS, n, axis=1), np.repeat(2 * _UNITS, n, axis=1)
        self.flat = self.key.reshape(-1)
        self.state = np.zeros(n, np.uint32)
        self.agree, self.told = np.zeros(n, bool), np.zeros(n, bool)
        self.same, self.hit = np.zeros((2, n), bool), np.zeros((2, n), bool)
        self.order = np.zeros(n, np.uint8)
        self.rest = np.zeros(n, _U)
        # of order 0, 1, 2: what an id adds to low, and the range it leaves
        self.add, self.wide = np.zeros((3, n), _U), np.zeros((3, n), _U)
        self.low_add, self.range = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)

    def predict(self) -> None:
        """Sets what the tables foretell, and the ranges and starts of the three orders; order 0's is that of all its ids."""
        np.multiply(self.prev, _TWO, out=self.goal[0])
        np.add(self.goal[0], self.mixed, out=self.goal[0])
        np.multiply(self.prev, _ONE, out=self.mixed)
        self.goal[1] = self.mixed
        np.right_shift(self.goal, _INDEX, out=self.goal)
        np.add(self.base, self.goal, out=self.key)
        self.table.take(self.key, out=self.entry, mode="clip")
        np.bitwise_and(self.entry, _LOW, out=self.pred)
        np.right_shift(self.entry, _HALF, out=self.conf)
        np.add(self.conf[0], self.conf[1], out=self.state)
        np.equal(self.pred[0], self.pred[1], out=self.agree)
        np.add(self.state, self.agree, out=self.state)
        np.add(self.own, self.state, out=self.at)
        self.shares.take(self.at, out=self.state, mode="clip")
        np.bitwise_and(self.state, _LOW, out=self.share[0])
        np.right_shift(self.state, _HALF, out=self.share[1])
        r, unit = self.rest, self.wide[0]
        np.right_shift(self.range, _PROB, out=unit)
        np.multiply(unit, self.share[0], out=self.wide[2])
        np.multiply(unit, self.share[1], out=self.wide[1])
        self.add[1] = self.wide[2]
        np.add(self.wide[1], self.wide[2], out=self.add[0])
        np.left_shift(unit, _PROB, out=r)
        np.subtract(r, self.add[0], out=r)
        np.right_shift(r, _PRIOR, out=r)

    def choose(self) -> None:
        """Picks of the three orders the one that each lane codes by ``hit``."""
        np.logical_or(self.hit[0], self.hit[1], out=self.told)
        np.add(self.hit[0].view(np.uint8), self.told.view(np.uint8), out=self.order)
        np.multiply(self.order, len(self.lane), out=self.pick, casting="unsafe", dtype=np.int64)
        np.add(self.pick, self.lane, out=self.pick)
        self.add.take(self.pick, out=self.low_add, mode="clip")
        self.wide.take(self.pick, out=self.range, mode="clip")

    def learn(self, ids: np.ndarray) -> None:
        """Adapts to ``ids``; ``hit`` is set."""
        np.equal(self.pred, ids, out=self.same)
        np.multiply(self.hit, _GAINED, out=self.goal)
        # an arithmetic shift: towards the goal, in whole numbers
        goal, share = self.goal.view(np.int32), self.share.view(np.int32)
        np.add(goal, _FLOOR, out=goal)
        np.subtract(goal, share, out=goal)
        np.right_shift(goal, _SLOW, out=goal)
        np.add(share, goal, out=share)
        np.left_shift(self.share[1], _HALF, out=self.state)
        np.bitwise_or(self.state, self.share[0], out=self.state)
        self.shares[self.at] = self.state
        # the newest id, more sure by a step if it was foretold
        np.minimum(self.conf, self.most, out=self.conf)
        np.multiply(self.conf, self.same, out=self.conf)
        np.add(self.conf, self.unit, out=self.conf)
        np.left_shift(self.conf, _HALF, out=self.conf)
        np.bitwise_or(self.conf, ids, out=self.conf)
        self.table[self.flat] = self.conf.reshape(-1)
        self.prev[:] = ids


def _encode_lanes(ids: np.ndarray, sizes: np.ndarray, freq: np.ndarray | None) -> list[bytes]:
    """Codes of the rows of ``ids`` [lanes, BLOCK], of which ``sizes`` ids count."""
    n = len(ids)
    m = _Models(n, freq)
    low = np.zeros(n, _U)
    few = np.zeros(n, bool)
    # an id takes at most PROB + PRIOR bits
    room = int(sizes.max()) + 16
    out, starts = np.zeros(n * room, np.uint32), np.arange(n) * room
    pos = starts.copy()
    codes: list[bytes] = [b""] * n
    columns = np.ascontiguousarray(ids.T)
    x, place, first = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.zeros(n, _U)
    ends = set(sizes.tolist())
    for t in range(int(sizes.max())):
        x[:] = place[:] = columns[t]
        m.predict()
        np.equal(m.pred, x, out=m.hit)
        np.greater(m.hit[1], m.hit[0], out=m.hit[1])
        m.start.take(place, out=first, mode="clip")
        np.multiply(first, m.rest, out=first)
        np.add(m.add[0], first, out=m.add[0])
        m.freq.take(place, out=first, mode="clip")
        np.multiply(first, m.rest, out=m.wide[0])
        m.choose()
        np.add(low, m.low_add, out=low)
        np.less(low, m.low_add, out=few)
        at, back = few.nonzero()[0], 1
        while len(at):
            k = pos[at] - back
            out[k] += np.uint32(1)
            at = at[out[k] == 0]
            back += 1
        np.less(m.range, _FULL, out=few)
        at = few.nonzero()[0]
        l, p = low[at], pos[at]
        out[p] = l >> _WORD
        pos[at] = p + 1
        low[at] = l << _WORD
        m.range[at] <<= _WORD
        m.learn(x)
        for i in np.flatnonzero(sizes == t + 1) if t + 1 in ends else ():
            tail = np.array([int(low[i]) >> 32, int(low[i]) & 0xFFFFFFFF], np.uint32)
            codes[i] = np.concatenate([out[starts[i] : pos[i]], tail]).astype("<u4").tobytes()
    return codes


def _decode_lanes(codes: list[np.ndarray], sizes: np.ndarray, freq: np.ndarray | None) -> np.ndarray:
    n = len(codes)
    m = _Models(n, freq)
    symbols = np.repeat(np.arange(1 << 16, dtype=np.uint32), m.freq.astype(np.int64))
    room = max(map(len, codes)) + 2
    data = np.zeros((n, room), np.uint32)
    for i, c in enumerate(codes):
        data[i, : len(c)] = c
    # the code less low
    code = (data[:, 0].astype(_U) << _WORD) | data[:, 1]
    # a lane that has ended may read on
    data, pos = data.reshape(-1), np.arange(n) * room + 2
    few, place, left, value = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
    x, found = np.zeros(n, np.uint32), np.zeros((3, n), np.uint32)
    ids = np.zeros((int(sizes.max()), n), np.uint16)
    for t in range(int(sizes.max())):
        m.predict()
        np.less(code, m.add[1], out=m.hit[0])
        np.less(code, m.add[0], out=few)
        np.greater(few, m.hit[0], out=m.hit[1])
        np.subtract(code, m.add[0], out=left)
        np.floor_divide(left, m.rest, out=value)
        np.minimum(value, _LAST, out=value)
        place[:] = value
        symbols.take(place, out=found[0], mode="clip")
        place[:] = found[0]
        found[1], found[2] = m.pred[1], m.pred[0]
        m.start.take(place, out=value, mode="clip")
        np.multiply(value, m.rest, out=value)
        np.add(m.add[0], value, out=m.add[0])
        m.freq.take(place, out=value, mode="clip")
        np.multiply(value, m.rest, out=m.wide[0])
        m.choose()
        found.take(m.pick, out=x, mode="clip")
        np.subtract(code, m.low_add, out=code)
        np.less(m.range, _FULL, out=few)
        at = few.nonzero()[0]
        p = pos[at]
        code[at] = (code[at] << _WORD) | data.take(p, mode="clip")
        pos[at] = p + 1
        m.range[at] <<= _WORD
        ids[t] = x
        m.learn(x)
    return ids.T


def encode(ids: np.ndarray, freq: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """Blocks (ids, crc32 of the ids as little-endian uint32, code) of an array of ids under 65536; ``freq`` is a prior."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of 65536 and more don't fit the coder")
    if freq is not None and (freq == 0).take(ids).any():
        raise ValueError("the prior lacks an id")
    blocks = []
    for at in range(0, len(ids), BLOCK * LANES):
        part = ids[at : at + BLOCK * LANES]
        n = -(-len(part) // BLOCK)
        grid = np.zeros(n * BLOCK, np.uint16)
        grid[: len(part)] = part
        sizes = np.full(n, BLOCK)
        sizes[-1] = len(part) - (n - 1) * BLOCK
        for i, code in enumerate(_encode_lanes(grid.reshape(n, BLOCK), sizes, freq)):
            own = part[i * BLOCK : i * BLOCK + sizes[i]]
            blocks.append((int(sizes[i]), zlib.crc32(own.astype("<u4").tobytes()), code))
    return blocks


def decode(blocks: list[tuple[int, int, bytes]], freq: np.ndarray | None = None) -> np.ndarray:
    """The ids of blocks, with the prior that coded them; raises Corrupt where a checksum fails."""
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        sizes = np.array([blocks[i][0] for i in part])
        if len(part) and sizes[0]:
            got = _decode_lanes([np.frombuffer(blocks[i][2], "<u4") for i in part], sizes, freq)
            for row, i in enumerate(part):
                found[i] = got[row, : sizes[row]].astype(np.uint32)
                if zlib.crc32(found[i].astype("<u4").tobytes()) != blocks[i][1]:
                    raise Corrupt(f"checksum of block {i}")
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
