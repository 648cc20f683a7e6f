"""Minimal perfect hashing of 64-bit keys in numpy, with values beside it.

Level by level, keys that fall alone on a bit of a fresh bit array are settled there; the rest go to
the next level. A key's index is the number of set bits before its own, over all levels. After
`LEVELS` levels the few keys left (identical ones excepted, there are none as a rule) are listed.
"""

from __future__ import annotations

import struct

import numpy as np

from .textkit import U64, mix

GAMMA, LEVELS, BLOCK = 2.0, 40, 512


def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(bits)


class PerfectHash:
    """Built over distinct keys; `index` gives each key its own number below n, any other key some number or -1."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int], rest: np.ndarray):
        self.levels, self.sizes, self.rest = levels, sizes, rest
        self.base, self.ranks, seen = [], [], 0
        for bits in levels:
            ones = np.concatenate([[0], np.cumsum(np.unpackbits(bits).reshape(-1, BLOCK).sum(1, dtype=np.int64))])
            self.base.append(seen)
            self.ranks.append(ones)
            seen += int(ones[-1])
        self.settled = seen

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], np.asarray(keys, U64)
        while len(left) and len(levels) < LEVELS:
            bits = max(64, int(GAMMA * len(left)))
            at = _slot(left, len(levels), bits)
            alone = np.bincount(at.astype(np.int64), minlength=-(-bits // BLOCK) * BLOCK) == 1
            levels.append(np.packbits(alone))
            sizes.append(bits)
            left = left[~alone[at]]
        return cls(levels, sizes, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, U64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(open_):
                break
            at = _slot(keys[open_], level, size).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            place = at[hit]
            if len(place):
                block = place // BLOCK
                rows = np.unpackbits(bits.reshape(-1, BLOCK // 8)[block], axis=1)
                before = (rows * (np.arange(BLOCK) < (place % BLOCK)[:, None])).sum(1)
                out[open_[hit]] = self.base[level] + self.ranks[level][block] + before
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.settled + at[same]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest)) + b"".join(struct.pack("<QQ", s, len(b)) for s, b in zip(self.sizes, self.levels, strict=True))
        return head + b"".join(b.tobytes() for b in self.levels) + self.rest.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        count, rest = struct.unpack_from("<II", blob)
        shape = [struct.unpack_from("<QQ", blob, 8 + 16 * i) for i in range(count)]
        at, levels = 8 + 16 * count, []
        for _, length in shape:
            levels.append(np.frombuffer(blob, np.uint8, length, at))
            at += length
        return cls(levels, [s for s, _ in shape], np.frombuffer(blob, U64, rest, at))


class Shard:
    """A perfect hash over first line hashes that indexes an array of second hashes (fingerprints), of counts and of keepers. Lines that share a first hash with another line are listed beside it."""

    def __init__(self, table: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, others: np.ndarray):
        self.table, self.prints, self.counts, self.keepers, self.others = table, prints, counts, keepers, others

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        h1, first = np.unique(np.asarray(h1, U64), return_index=True)
        rest = np.setdiff1d(np.arange(len(h2)), first)
        counts = np.minimum(counts, 2**32 - 1)
        others = np.array([(h2[i], keepers[i], counts[i]) for i in rest], [("print", U64), ("keeper", np.int64), ("count", np.uint32)])
        table = PerfectHash.build(h1)
        at = table.index(h1)
        arrays = [np.empty(len(h1), kind) for kind in (U64, np.uint32, np.int64)]
        for to, values in zip(arrays, (h2[first].astype(U64), counts[first], keepers[first]), strict=True):
            to[at] = values
        return cls(table, *arrays, others)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Found or not, count, keeper of each line."""
        at = self.table.index(h1)
        if not len(self.prints):
            return np.zeros(len(at), bool), np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        h2, safe = np.asarray(h2, U64), np.maximum(at, 0)
        found, count, keeper = (at >= 0) & (self.prints[safe] == h2), self.counts[safe], self.keepers[safe]
        for other in self.others:  # none, but for a line in some 10^10 of a shard's
            hit = ~found & (h2 == other["print"])
            found, count, keeper = found | hit, np.where(hit, other["count"], count), np.where(hit, other["keeper"], keeper)
        return found, count, keeper

    def dump(self) -> bytes:
        table = self.table.dump()
        return struct.pack("<QQQ", len(table), len(self.prints), len(self.others)) + table + self.prints.tobytes() + self.counts.tobytes() + self.keepers.tobytes() + self.others.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        t, n, m = struct.unpack_from("<QQQ", blob)
        at = 24 + t
        others = np.frombuffer(blob, [("print", U64), ("keeper", np.int64), ("count", np.uint32)], m, at + 20 * n)
        return cls(PerfectHash.load(blob[24:at]), np.frombuffer(blob, U64, n, at), np.frombuffer(blob, np.uint32, n, at + 8 * n), np.frombuffer(blob, np.int64, n, at + 12 * n), others)
