"""Whole batches of texts as flat numpy arrays: words, hashes and shingles without a Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOADS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 64


def give_back() -> None:
    """In a Python worker, let freed memory go back to the system: workers wait between tasks and stages, and several share an executor's memory."""
    if TaskContext.get() is None:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # another C library has no mallopt
        for option, value in _MALLOC.items():
            ctypes.CDLL(None).mallopt(option, value)


#: glibc's numbers of M_MMAP_THRESHOLD, M_TRIM_THRESHOLD and M_ARENA_MAX.
_MALLOC = {-3: 2 << 20, -1: 8 << 20, -8: 2}
give_back()


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = run[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(run, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def binary16(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Keys of 16 bytes from two halves."""
    both = np.stack([first.view(U64), second.view(U64)], axis=1)
    at = np.arange(0, 16 * len(first) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(both.astype(">u8").tobytes())])


def lists_of(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given numbers of items, one after another in data."""
    at = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unlisted(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Items of binary values in a row, and where each value begins (one more at the end)."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), (at - at[0]) // size


class Words:
    """Maximal runs of bytes that are not ASCII white space.

    `start`, `end`: byte places; `first`: index of each text's first word (one more at the end);
    `hash`: 64 bits of each word, A-Z lower-cased when `fold`.
    """

    def __init__(self, column: pa.Array, fold: bool = True, hashes: bool = True):
        self.bytes, self.at = flat(column)
        n = len(self.bytes)
        inside = ~_SPACE[self.bytes]
        cut = self.at[(self.at > 0) & (self.at < n)]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[cut] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[cut - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        if hashes:
            self.hash = span_hash(_FOLD[self.bytes] if fold else self.bytes, self.start, self.end)

    def doc(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes: its length and its 8-byte words go one after another through a mixing step, so no two patterns of bytes cancel. Long spans go to xxh3."""
    size = end - start
    if not len(start):
        return np.zeros(0, U64)
    words = first_bytes(data)
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64((salt * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF))
    h = mix((h ^ (words[start] & _LOADS[np.minimum(size, 8)])) * U64(0xC2B2AE3D27D4EB4F))
    done, open_ = 8, np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    while len(open_):
        chunk = words[start[open_] + done] & _LOADS[np.minimum(size[open_] - done, 8)]
        h[open_] = mix((h[open_] ^ chunk) * U64(0xC2B2AE3D27D4EB4F))
        done += 8
        open_ = open_[size[open_] > done]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = mix(np.array([xxhash.xxh3_64_intdigest(raw[a:b], salt) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], U64))
    return h


def first_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return eights(padded)


def eights(padded: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, but for the last eight places."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of equal size hold equal bytes; a and b have eight bytes to spare at the end."""
    u, v = eights(a), eights(b)
    same = ((u[at_a] ^ v[at_b]) & _LOADS[np.minimum(size, 8)]) == 0
    open_ = np.flatnonzero(same & (size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(open_):
        same[open_] = ((u[at_a[open_] + done] ^ v[at_b[open_] + done]) & _LOADS[np.minimum(size[open_] - done, 8)]) == 0
        done += 8
        open_ = open_[same[open_] & (size[open_] > done)]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[i] = np.array_equal(a[at_a[i] : at_a[i] + size[i]], b[at_b[i] : at_b[i] + size[i]])
    return same


def run_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` items, by doubling. Ends of texts are not minded."""
    have, out, rest = 1, None, length
    part, size = h, 0
    while rest:
        if rest & 1:
            if out is None:
                out, size = part, have
            else:
                n = len(h) - size - have + 1
                out = mix(out[: max(n, 0)] * U64(0xFF51AFD7ED558CCD) + part[size : size + max(n, 0)])
                size += have
        rest >>= 1
        if rest:
            n = max(len(part) - have, 0)
            part = mix(part[:n] * U64(0xC2B2AE3D27D4EB4F) + part[have : have + n])
            have *= 2
    return out


def runs(words: Words, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the row of each. whole: a text of 1 to k-1 words counts as one run."""
    n, h, doc = len(words.hash), words.hash, words.doc()
    if n >= k:
        out = np.full(n - k + 1, k, U64)
        for i in range(k):
            out *= U64(0xFF51AFD7ED558CCD)
            out += h[i : n - k + 1 + i]
        good = doc[: n - k + 1] == doc[k - 1 :]
        out, of = mix(out[good]), doc[: n - k + 1][good]
    else:
        out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if whole:
        short = np.flatnonzero((words.count > 0) & (words.count < k))
        if len(short):
            extra = []
            for d in short:
                x = U64(words.count[d])
                for v in h[words.first[d] : words.first[d + 1]]:
                    x = U64((int(x) * 0xFF51AFD7ED558CCD + int(v)) & 0xFFFFFFFFFFFFFFFF)
                extra.append(x)
            out, of = np.concatenate([out, mix(np.array(extra, U64))]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of
