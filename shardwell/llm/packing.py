"""Packing documents into windows of tokens by non-negative least squares.

1. Every document is tokenised once; ids and counts go to a table in the shared folder.
2. A document gives whole windows and a remainder. The histogram of remainders of all documents (one
   number for each length below the window) reaches the driver, which lists shallow combinations of
   lengths that fill the window exactly (all pairs and triples of lengths that occur), solves for repeat
   counts x >= 0 with A x near the histogram, and rounds them.
3. Tasks realise the plan on their own documents, in shards of about `SHARD_IDS` ids: each takes its
   share of every combination's count (its fraction rounded up or down by a number that depends on shard and
   combination, so that the shares of all shards add up to the plan), then what else its remainders allow. What is left is packed
   greedily end to end, cut where a window is full. The last, partial stretch is cut into powers of
   two, which need no padding.

A sequence never crosses shards, so tasks need nothing from each other, and a rerun of a lost task
gives the same sequences.

Defined results: null text counts as empty (its end id only); null and repeated doc_ids pack like
others; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, query, text_of, written
from .textkit import U64, mix, pieces
from .tokens import WordEncoder, default_tokenizer

WINDOW, END_ID = 2048, 1
SHARD_IDS = 4_000_000
ROUNDS = 200
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, of lengths that occur."""
    there = np.flatnonzero(histogram[:window] > 0)
    there = there[there > 0]
    has = np.zeros(window + 1, bool)
    has[there] = True
    small = there[2 * there <= window]
    pairs = small[has[window - small]]
    out = [np.stack([pairs, window - pairs, 0 * pairs], 1)]
    a, b = np.meshgrid(there, there, indexing="ij")
    good = (a <= b) & (a + 2 * b <= window)
    a, b = a[good], b[good]
    c = window - a - b
    keep = (c >= b) & has[np.clip(c, 0, window)]
    out.append(np.stack([a[keep], b[keep], c[keep]], 1))
    return np.concatenate(out).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: x >= 0 that brings A x near the histogram."""
    m = len(combos)
    if not m:
        return np.zeros(0)
    size = len(histogram)
    target = histogram.astype(np.float64).copy()
    target[0] = 0

    def forward(x):
        y = sum(np.bincount(combos[:, k], x, minlength=size) for k in range(3))
        y[0] = 0
        return y

    def back(y):
        y = y.copy()
        y[0] = 0
        return y[combos].sum(1)

    v = np.ones(m)
    for _ in range(20):
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = z = np.zeros(m)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(forward(z) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and rounded repeat counts, the largest first. Combinations whose count rounds to none come last: they serve what rounding leaves."""
    combos = combinations(histogram, window)
    x = np.round(solve(combos, histogram)).astype(np.int64)
    order = np.argsort(-x, kind="stable")
    return combos[order].astype(np.int32), x[order]


def shares(counts: np.ndarray, share: float, shard: int) -> np.ndarray:
    """Whole counts of one shard. Over shards they come to counts x shares: what is left below one goes up with just that chance, told by a hash of shard and combination."""
    exact = counts * share
    drawn = (mix(np.arange(len(counts)).astype(U64) + U64(shard * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) / (1 << 53)
    return np.floor(exact + drawn).astype(np.int64)


def arrange(sizes: np.ndarray, combos: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of one shard: document, start, length, sequence, offset. counts: how often this shard is to take each combination."""
    number = 0
    whole, rest = sizes // window, sizes % window
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            yield int(d), k * window, window, number, 0
            number += 1
    order = np.argsort(rest, kind="stable")
    edge = np.searchsorted(rest[order], np.arange(window + 1))
    free, ends = edge[:-1].tolist(), edge[1:].tolist()
    free[0] = ends[0]
    begin = (whole * window).tolist()
    for planned in (True, False):
        for combo, limit in _ready(combos, counts, free, ends, planned):
            parts = [p for p in combo if p]
            most = min((ends[p] - free[p]) // parts.count(p) for p in parts)
            for _ in range(min(most, limit) if planned else most):
                at = 0
                for p in parts:
                    d = int(order[free[p]])
                    free[p] += 1
                    yield d, begin[d], p, number, at
                    at += p
                number += 1
    left = [int(order[j]) for p in range(window - 1, 0, -1) for j in range(free[p], ends[p])]
    room, total = window, int(sum(rest[left])) if left else 0
    tail = total % window
    full = total - tail
    done = 0
    for d in left:
        at, size = begin[d], int(rest[d])
        while size:
            if done == full and room == window and tail:  # only the partial stretch is left: powers of two, the largest first
                room = 1 << (tail.bit_length() - 1)
                tail -= room
                target = room
            elif room == window:
                target = window
            take = min(size, room)
            yield d, at, take, number, target - room
            at, size, room = at + take, size - take, room - take
            if done < full:
                done += take
            if not room:
                number, room = number + 1, window


def _ready(combos: np.ndarray, counts: np.ndarray, free: list[int], ends: list[int], planned: bool, step: int = 8192) -> Iterator[tuple[list[int], int]]:
    """Combinations whose lengths are there just now, some at a time; planned: those only that have a count."""
    for a in range(0, len(combos), step):
        there = np.array(ends) - np.array(free) > 0
        there[0] = True  # no part
        some = there[combos[a : a + step]].all(axis=1) & (counts[a : a + step] > 0 if planned else True)
        yield from zip(combos[a : a + step][some].tolist(), counts[a : a + step][some].tolist(), strict=True)


def _tokenise(path: str, end_id: int, id_type):
    def go(batches):
        encoder = WordEncoder.load(path)
        for whole in batches:
            for batch in pieces(whole):
                ids, per = encoder.encode(batch.column("text"), end_id)
                raw, edge = memoryview(ids.astype(id_type).tobytes()), np.cumsum(per) * np.dtype(id_type).itemsize
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(per, pa.int64()), pa.array([bytes(raw[a:b]) for a, b in zip([0, *edge[:-1].tolist()], edge.tolist(), strict=True)], pa.binary())], ["doc_id", "n", "ids"])

    return go


def _pack(sent, documents_in_all: int, window: int, id_type):
    def go(batches):
        base, shard, held = TaskContext.get().partitionId() << 36, 0, 0
        docs, sizes, ids = [], [], []

        def flush():
            per = np.array(sizes, np.int64)
            first = np.cumsum(per) - per
            flat = np.frombuffer(b"".join(ids), id_type).astype("<u4")
            raw = memoryview(flat.tobytes())
            rows = list(arrange(per, sent.value[0], shares(sent.value[1], len(per) / max(documents_in_all, 1), base + shard), window))
            d, start, length, seq, offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5))
            at = first[d] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([docs[i] for i in d.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, per[d], base + (shard << 16) + seq, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs += batch.column("doc_id").to_pylist()
            sizes += batch.column("n").to_pylist()
            ids += batch.column("ids").to_pylist()
            held += sum(batch.column("n").to_pylist())
            if held >= SHARD_IDS:
                yield flush()
                # a long document may fill more sequences than one shard's numbers
                shard += 1 + held // (window << 4)
                docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield flush()

    return go


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; see the module."""
    path = tokenizer or default_tokenizer()
    kind = "<u2" if WordEncoder.load(path).size <= 1 << 16 else "<u4"
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    tokens = written(base.mapInArrow(_tokenise(path, end_id, kind), "doc_id long, n long, ids binary"), "tokens")
    histogram = np.zeros(window, np.int64)
    for row in tokens.groupBy((F.col("n") % window).alias("rest")).count().collect():  # a number below the window for each row
        histogram[row["rest"]] = row["count"]
    combos, counts = plan(histogram, window)
    sent = docs.sparkSession.sparkContext.broadcast((combos, counts))  # as many as triples of lengths below the window at most
    return tokens.mapInArrow(_pack(sent, int(histogram.sum()), window, kind), PIECES)


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
