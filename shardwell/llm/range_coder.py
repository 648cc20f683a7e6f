"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: models start afresh and a CRC-32 of its ids closes it. Inside a block the
ids are cut into `lanes` equal stretches that are coded in step, one id of each stretch at a time, by
range coders of their own over models they share. One step is a handful of numpy operations on all
lanes.

Predictions: order 2 and order 1 each name the id last seen after their context, with a confidence
of 0 to 7; order 0 tells how frequent the id that order 2 names has been, in four levels. An
algebraic-sigmoid mixer turns these three and whether the orders agree into the odds of "order 2 is
right", "order 1 is right" and "neither"; hit counts by confidence and level and the mixer's weights
adapt as the block goes on. After "neither" order 0 codes the id: adaptive frequencies of ids seen so
far with an escape to a plain id. Only +, -, x, / and square roots are used, all exact in IEEE
arithmetic, so any machine reads what another wrote.

Range coder: 64-bit low and range, 32-bit words out, no carries (a range that straddles a word is
cut at it).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
MOST_LANES, LANE_IDS = 4096, 64
HASH_BITS, TOP_CONFIDENCE = 18, 7
REFRESH = 16
_U, _32 = np.uint64, np.uint64(32)
_WORD = _U(0xFFFFFFFF)
_FULL = _U(0xFFFFFFFFFFFFFFFF)
_LEVELS = 4
_STATES = _LEVELS * 2 * 8 * 8


def _stretch(p):
    t = 2 * p - 1
    return t / np.sqrt(1 - t * t)


def _squash(x):
    return 0.5 + 0.5 * x / np.sqrt(1 + x * x)


class Models:
    """All adaptive state of a block; the same calls in the same order on both sides."""

    def __init__(self, size: int, lanes: int):
        self.size, self.bits = size, max(16, int(size).bit_length() + 1)
        self.total = 1 << self.bits
        self.first, self.second = np.zeros(size + 1, np.int32), np.zeros(1 << HASH_BITS, np.int32)  # guess x 8 + confidence
        self.last, self.before = np.full(lanes, size, np.int32), np.full(lanes, size, np.int32)
        self.seen = np.zeros(size, np.int64)
        self.events = np.zeros((_STATES, 3), np.int64)
        start = np.arange(8, dtype=np.float64)
        self.hits = np.stack([0.2 + start, 2.0 + 0 * start], 1)  # right, wrong by confidence, order 2
        self.hits_first = self.hits.copy()
        self.hits_zero = np.stack([0.5 + 0.5 * np.arange(_LEVELS), 2.0 + 0 * np.arange(_LEVELS)], 1)  # by order 0's level of what order 2 names
        self.level = np.zeros(size, np.int32)
        self.weights = np.array([[0.6, 0.3, 0.0, 0.0], [0.7, 0.5, 0.0, 0.0]])  # apart, agreeing
        self.held: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        """Take in what was coded since the last time."""
        k = np.arange(_STATES)
        level, agree, k2, k1 = k >> 7, (k >> 6) & 1, (k >> 3) & 7, k & 7
        e = self.events.astype(np.float64)
        right2 = self.hits[:, 0] / self.hits.sum(1)
        right1 = self.hits_first[:, 0] / self.hits_first.sum(1)
        right0 = self.hits_zero[:, 0] / self.hits_zero.sum(1)
        s2, s1, s0 = (_stretch(np.clip(r, 0.001, 0.999))[c] for r, c in ((right2, k2), (right1, k1), (right0, level)))
        inputs = np.stack([s2, np.where(agree == 1, s1, -s1), s0, np.ones(_STATES)], 1)
        n = e.sum(1)
        if n.any():
            p = _squash((self.weights[agree] * inputs).sum(1))
            slope = ((e[:, 0] - n * p) / (n.sum() + 1.0))[:, None] * inputs
            for a in (0, 1):
                self.weights[a] += np.clip(2.0 * slope[agree == a].sum(0), -0.5, 0.5)
            for c in range(8):
                self.hits[c] = self.hits[c] * 0.9 + [e[k2 == c, 0].sum(), e[k2 == c, 1:].sum()]
                apart = (k1 == c) & (agree == 0)
                self.hits_first[c] = self.hits_first[c] * 0.9 + [e[apart, 1].sum() + e[(k1 == c) & (agree == 1), 0].sum(), e[apart, 2].sum() + e[(k1 == c) & (agree == 1), 2].sum()]
            for c in range(_LEVELS):
                self.hits_zero[c] = self.hits_zero[c] * 0.9 + [e[level == c, 0].sum(), e[level == c, 1:].sum()]
            self.events[:] = 0
        p2 = np.clip(_squash((self.weights[agree] * inputs).sum(1)), 0.0005, 0.995)
        p1 = np.where(agree == 1, 0.0, np.clip(right1, 0.001, 0.99)[k1])
        f2 = np.maximum(1, np.floor(p2 * (self.total - 64))).astype(np.int64)
        f1 = np.where(agree == 1, 0, np.maximum(1, np.floor((self.total - f2 - 32) * p1))).astype(np.int64)
        self.event_low = np.stack([0 * f2, f2, f2 + f1], 1).astype(_U).ravel()
        self.event_size = np.stack([f2, f1, self.total - f2 - f1], 1).astype(_U).ravel()
        self.edge_one, self.edge_two = f2.astype(_U), (f2 + f1).astype(_U)
        for ids in self.held:
            self.seen += np.bincount(ids, minlength=self.size)
        self.held = []
        there = self.seen > 0
        room, most = self.total - int(there.sum()) - max(1, self.total >> 12), int(self.seen.sum())
        share = np.where(there, 1 + self.seen * room // max(most, 1), 0)
        self.id_size = share.astype(_U)
        edge = np.cumsum(share)
        self.id_low = (edge - share).astype(_U)
        self.escape_low = int(edge[-1])
        self.id_of = None
        self.level = there.astype(np.int32) + (self.seen * 1024 > most) + (self.seen * 64 > most)

    def lookup(self) -> np.ndarray:
        """Id at each point of the order-0 interval; `size` for the escape. Only readers need it."""
        if self.id_of is None:
            self.id_of = np.full(self.total, self.size, np.int32)
            self.id_of[: self.escape_low] = np.repeat(np.arange(self.size, dtype=np.int32), self.id_size.astype(np.int64))
        return self.id_of

    def predict(self, n: int):
        """Of the first n lanes: state, guesses, and what update needs."""
        last, before = self.last[:n], self.before[:n]
        slot = (last.astype(np.uint32) * np.uint32(0x9E3779B1) + before.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)
        two, one = self.second[slot], self.first[last]
        g2, g1, k2, k1 = two >> 3, one >> 3, two & 7, one & 7
        return self.level[g2] * np.int32(128) + (g1 == g2) * np.int32(64) + k2 * 8 + k1, g2, g1, (slot, two, k2, last, one, k1)

    def update(self, n: int, ids: np.ndarray, event: np.ndarray, state: np.ndarray, g2: np.ndarray, g1: np.ndarray, kept) -> None:
        slot, two, k2, last, one, k1 = kept
        fresh = ids << 3
        for table, at, old, k, g in ((self.second, slot, two, k2, g2), (self.first, last, one, k1, g1)):
            table[at] = np.where(g == ids, old + (k < TOP_CONFIDENCE), np.where(k > 0, old - k + (k >> 1), fresh))
        self.before, self.last = self.last, self.before
        self.last[:n] = ids
        self.events += np.bincount(state * 3 + event, minlength=3 * _STATES).reshape(_STATES, 3)


def _steps(n: int) -> tuple[int, int]:
    lanes = int(min(MOST_LANES, max(1, n // LANE_IDS)))
    return lanes, -(-n // lanes) if n else 0


def _lay(n: int, lanes: int, steps: int) -> np.ndarray:
    """Length of each lane: full ones first."""
    return np.clip(n - np.arange(lanes) * steps, 0, steps)


def _due(step: int) -> bool:
    return step % REFRESH == 0 or step in (1, 2, 4, 8)


def encode(ids: np.ndarray, size: int) -> bytes:
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= size):
        raise ValueError("id outside the vocabulary")
    n = len(ids)
    lanes, steps = _steps(n)
    lengths = _lay(n, lanes, steps)
    models = Models(size, lanes)
    laid = np.zeros((steps, lanes), np.int32)
    laid.T.flat[:n] = ids
    low, span = np.zeros(lanes, _U), np.full(lanes, _FULL)
    out, used = np.zeros((lanes, steps + 4), np.uint32), np.zeros(lanes, np.int64)
    shift = _U(models.bits)

    def emit(at):
        """Lanes whose range has fallen below a word give out their top word."""
        lo = low[at]
        straddles = (lo ^ (lo + span[at] - _U(1))) >> _32 != 0
        if straddles.any():
            cut = at[straddles]
            span[cut] = _U(1 << 32) - (low[cut] & _WORD)
        nonlocal out
        if used[at].max() >= out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        out[at, used[at]] = (lo >> _32).astype(np.uint32)
        used[at] += 1
        low[at] = lo << _32
        span[at] <<= _32

    def put(at, start, width):
        if at is None:
            unit = span[: len(start)] >> shift
            low[: len(start)] += start * unit
            span[: len(start)] = now = width * unit
            short = np.flatnonzero(now < _U(1 << 32))
        else:
            unit = span[at] >> shift
            low[at] += start * unit
            now = width * unit
            span[at] = now
            short = at[now < _U(1 << 32)]
        if len(short):
            emit(short)

    for step in range(steps):
        if step and _due(step):
            models.refresh()
        live = int(np.searchsorted(-lengths, -step, "left")) if step >= lengths[-1] else lanes
        x = laid[step, :live]
        state, g2, g1, kept = models.predict(live)
        event = np.where(x == g2, 0, 2 - (x == g1))
        case = state * 3 + event
        put(None, models.event_low[case], models.event_size[case])
        miss = np.flatnonzero(event == 2)
        if len(miss):
            y = x[miss]
            width = models.id_size[y]
            new = width == 0
            start = models.id_low[y]
            if new.any():
                start[new], width[new] = models.escape_low, models.total - models.escape_low
            put(miss, start, width)
            if new.any():
                put(miss[new], y[new].astype(_U), np.ones(int(new.sum()), _U))
        models.update(live, x, event, state, g2, g1, kept)
        models.held.append(x)
    for lane in range(lanes if n else 0):  # two words settle each lane
        v = int(low[lane])
        if used[lane] + 2 > out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        out[lane, used[lane] : used[lane] + 2] = v >> 32, v & 0xFFFFFFFF
        used[lane] += 2
    words = out[np.arange(out.shape[1]) < used[:, None]] if n else np.zeros(0, np.uint32)
    counts = zlib.compress(used.astype("<u4").tobytes(), 1) if n else b""
    return MAGIC + struct.pack("<IQIII", size, n, lanes, zlib.crc32(ids.astype("<u4").tobytes()), len(counts)) + counts + words.astype("<u4").tobytes()


def decode(blob: bytes) -> np.ndarray:
    """Ids of a block, or ValueError if it doesn't hold what was written."""
    if bytes(blob[:4]) != MAGIC:
        raise ValueError("not a block of this format")
    size, n, lanes, crc, packed = struct.unpack_from("<IQIII", blob, 4)
    at = 4 + struct.calcsize("<IQIII")
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    try:
        used = np.frombuffer(zlib.decompress(blob[at : at + packed]), "<u4").astype(np.int64)
    except zlib.error as e:
        raise ValueError("damaged block") from e
    words = np.concatenate([np.frombuffer(blob, "<u4", offset=at + packed), np.zeros(4, "<u4")]).astype(_U)
    place = np.cumsum(used) - used
    lengths = _lay(n, lanes, steps)
    models = Models(size, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, _FULL)
    code = words[place] << _32 | words[place + 1]
    place = place + 2
    shift, top = _U(models.bits), _U(models.total - 1)
    out = np.zeros((steps, lanes), np.int32)
    end = len(words) - 1

    def settle(at):
        lo = low[at]
        straddles = (lo ^ (lo + span[at] - _U(1))) >> _32 != 0
        if straddles.any():
            cut = at[straddles]
            span[cut] = _U(1 << 32) - (low[cut] & _WORD)
        code[at] = code[at] << _32 | words[np.minimum(place[at], end)]
        place[at] += 1
        low[at] = lo << _32
        span[at] <<= _32

    for step in range(steps):
        if step and _due(step):
            models.refresh()
        live = int(np.searchsorted(-lengths, -step, "left")) if step >= lengths[-1] else lanes
        state, g2, g1, kept = models.predict(live)
        unit = span[:live] >> shift
        point = np.minimum((code[:live] - low[:live]) // unit, top)
        event = (point >= models.edge_one[state]).astype(np.int32) + (point >= models.edge_two[state])
        case = state * 3 + event
        low[:live] += models.event_low[case] * unit
        now = models.event_size[case] * unit
        span[:live] = now
        short = np.flatnonzero(now < _U(1 << 32))
        if len(short):
            settle(short)
        x = np.where(event == 0, g2, g1)
        miss = np.flatnonzero(event == 2)
        if len(miss):
            unit = span[miss] >> shift
            point = np.minimum((code[miss] - low[miss]) // unit, top)
            y = models.lookup()[point.astype(np.int64)]
            new = y == size
            some = new.any()
            z = np.where(new, 0, y) if some else y
            start, width = models.id_low[z], models.id_size[z]
            if some:
                start[new], width[new] = models.escape_low, models.total - models.escape_low
            low[miss] += start * unit
            now = width * unit
            span[miss] = now
            short = miss[now < _U(1 << 32)]
            if len(short):
                settle(short)
            if some:
                at = miss[new]
                unit = span[at] >> shift
                plain = np.minimum((code[at] - low[at]) // unit, top)
                low[at] += plain * unit
                span[at] = unit
                short = at[unit < _U(1 << 32)]
                if len(short):
                    settle(short)
                y[new] = np.minimum(plain.astype(np.int32), size - 1)
            x[miss] = y
        out[step, :live] = x
        models.update(live, x, event, state, g2, g1, kept)
        models.held.append(x)
    ids = out.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of a block fails")
    return ids
