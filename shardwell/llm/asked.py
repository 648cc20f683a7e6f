"""Which keys are asked for, as a bit table small enough for every task: a first pass over texts without a join. A bit that another key sets costs work, not correctness."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import U64, mix

LEAST_BITS, MOST_BITS, PER_KEY = 1 << 10, 1 << 27, 8


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(U64)) % U64(bits)).astype(np.int64)


def asked_table(keys: DataFrame) -> np.ndarray:
    """keys: one long column. Eight bits for each row, MOST_BITS (16 MB) at most; 16 tasks give one compressed table each to the driver."""
    name = keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_KEY * keys.count()).bit_length()))

    def fill(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                held = np.zeros(bits, bool) if held is None else held
                held[_places(np.asarray(batch.column(name)), bits)] = True
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.coalesce(16).mapInArrow(fill, "bits binary").collect():
        out |= np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    return out


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys, 8 * len(table))
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
