"""SimHash fingerprints, and all pairs within a Hamming radius by permuted block tables.

Terms are word pairs (with marks at both ends of a text) and runs of five words; each occurrence of
a term votes with the term's weight on every bit, +w where the term's hash has a one, -w where it has
a zero. The sign of the sum is the fingerprint's bit; a tie or a text without words gives zero.

Defined results: null text counts as empty; texts without words have the fingerprint of all zeros;
equal texts have equal fingerprints; "next" goes by descending doc_id, null ids last and ties by
text; an empty table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, query, text_of, width, written
from .textkit import U64, Words, mix, pieces, runs

BITS = 256
#: Hamming radius of a search, over 64 bits.
RADIUS = 3
PAIR_WEIGHT, FIVE_WEIGHT = 1, 2
_EDGE = np.array([0x51ED270B9F652295, 0xA3EC647659359ACD], U64)
_BYTE_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, with a mark before the first and after the last of each text."""
    full = np.flatnonzero(words.count)
    size = words.count + 1
    size[words.count == 0] = 0
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    left_at = words.first[:-1][doc] + at - 1
    left = np.where(at > 0, words.hash[left_at] if len(full) else U64(0), _EDGE[0])
    end = at == words.count[doc]
    right = np.where(end, _EDGE[1], words.hash[np.minimum(left_at + 1, max(len(words.hash) - 1, 0))] if len(full) else U64(0))
    return mix(left * U64(0xC2B2AE3D27D4EB4F) + right), doc


def votes(column: pa.Array, bits: int = BITS) -> np.ndarray:
    """Texts x bits sums of signed votes."""
    words = Words(column)
    n = len(column)
    total = np.zeros((n, bits), np.float32)
    for (terms, doc), weight in ((_pairs(words), PAIR_WEIGHT), (runs(words, 5), FIVE_WEIGHT)):
        if not len(terms):
            continue
        for w in range(bits // 64):
            x = mix(terms + U64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            for b in range(8):
                slot = doc * 256 + ((x >> U64(8 * b)) & U64(255)).astype(np.int64)
                seen = np.bincount(slot, minlength=n * 256).reshape(n, 256).astype(np.float32)
                at = w * 64 + b * 8
                total[:, at : at + 8] += weight * (seen @ _BYTE_SIGNS)
    return total


def fingerprints(column: pa.Array, bits: int = BITS) -> np.ndarray:
    """Texts x bits/8 bytes. Texts go in small groups, as the vote tables take 256 numbers for each."""
    batch = pa.record_batch([column], ["text"])
    parts = [np.packbits(votes(p.column(0), bits) > 0, axis=1) for x in pieces(batch, most=1 << 20) for p in (x.slice(i, 512) for i in range(0, x.num_rows, 512))]
    return np.concatenate(parts) if parts else np.zeros((0, bits // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1 - np.unpackbits(a ^ b, axis=1).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many (or all) first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _strings(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes().hex() for p in prints], pa.string())


_ROW = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])


def _compare(ids: list, texts: list[str], own: np.ndarray, bits: int, part: int) -> pa.RecordBatch:
    """Each text but the last against its edited form and the text after it; own: fingerprints of all."""
    import hashlib

    new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    changed, n = fingerprints(pa.array(new, pa.string()), bits), len(new)
    return pa.RecordBatch.from_arrays([
        pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), _strings(own[:-1]), _strings(changed), pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:])), pa.nulls(n, pa.string()),
    ], schema=_SCHEMA)


def _walk(bits: int):
    """Rows come in order; each is compared with the one after it. The first and last text of a part are passed on, to be joined with its neighbours."""

    def edge(kind, part, doc_id, text):
        return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": doc_id, "text": text}], schema=_SCHEMA)

    def go(batches):
        part, last = TaskContext.get().partitionId(), None
        for whole in batches:
            for batch in pieces(whole):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                own = fingerprints(batch.column("text"), bits)
                if last is None:
                    yield edge(1, part, ids[0], texts[0])
                else:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
                last = ids[-1], texts[-1], own[-1:]
                if len(ids) > 1:
                    yield _compare(ids, texts, own, bits, part)
        if last is not None:
            yield edge(2, part, *last[:2])

    return go


def _seams(bits: int):
    def go(batches):
        for batch in batches:
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                yield _compare([i, None], [a, b], fingerprints(pa.array([a, b]), bits), bits, -1)

    return go


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of each text, of its edited form and likenesses; see the module for the order.

    One range shuffle by id; each part walks its rows in order. Only the first and last text of each
    part travel once more.
    """
    n = width(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]
    placed = base.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    rows = written(placed.mapInArrow(_walk(bits), _ROW), "simhash")
    firsts = rows.filter("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = rows.filter("kind = 2").select("part", "doc_id", "text")
    parts = sorted(r["part"] for r in lasts.select("part").collect())  # one number for each part
    out = rows.filter("kind = 0").drop("kind", "part", "text")
    if not parts:
        return out
    follow = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next_part int")
    seams = lasts.join(F.broadcast(follow), "part").join(firsts, "next_part").select("doc_id", "text", "next_text")
    return out.unionByName(written(seams.mapInArrow(_seams(bits), _ROW), "seams").drop("kind", "part", "text"))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, fingerprint (binary)."""

    def go(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([p.tobytes() for p in fingerprints(batch.column("text"), bits)], pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(go, "doc_id long, fingerprint binary")


def block_tables(prints: int, radius: int, bits: int = 64) -> tuple[list[int], list[list[int]]]:
    """Masks of the blocks, and of each table's front as the numbers of its blocks, for so many fingerprints: the fewest blocks whose fronts leave about one fingerprint for each value."""
    blocks = radius + 2
    while bits * (blocks - radius) / blocks < min(math.log2(max(prints, 1)), bits - radius - 1) and blocks < bits:
        blocks += 1
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return masks, [list(c) for c in itertools.combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a query's fingerprint and a different one at most `radius` bits apart: asked, found (long, 64 bits), distance.

    queries, prints: one long column each. Permuted block tables: bits are cut into more blocks than the
    radius; a pair within it agrees on at least blocks - radius of them, so one table is made for each
    choice of that many blocks, in which fingerprints meet by the bits of these blocks. Equal fingerprints
    are taken once (their documents share the fingerprint as class id), so a large group of copies gives
    one entry. A pair is given out by the first table in which it meets. With more fingerprints there are
    more blocks, so that fronts stay long enough to tell fingerprints apart.
    """
    asked, held = (df.select(F.col(df.columns[0]).alias("fp")).filter("fp IS NOT NULL").distinct() for df in (queries, prints))
    held = written(held, "fingerprints")
    masks, tables = block_tables(held.count(), radius)
    fronts = [_signed(sum(masks[j] for j in c)) for c in tables]
    entries = lambda df, name: df.select(F.col("fp").alias(name), F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("front")) for t, m in enumerate(fronts)])).alias("e")).select(name, "e.t", "e.front")
    differ = F.col("asked").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(fronts)])
    a, b = entries(asked, "asked").alias("a"), entries(held, "found").alias("b")
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.front") == F.col("b.front")) & (F.bit_count(differ) <= radius) & (F.col("asked") != F.col("found")) & (first == F.col("a.t")))
    return met.select("asked", "found", F.bit_count(differ).alias("distance"))


def near_counts(out: DataFrame, asked) -> DataFrame:
    """out with `near_fingerprints`: for rows that are asked for, how many other fingerprints of the table are within RADIUS bits of the first 64 of theirs; null for other rows."""
    print_of = F.conv(F.substring("fingerprint", 1, 16), 16, -10).cast("long")
    asked = F.coalesce(asked, F.lit(False))
    own = out.filter(asked).withColumn("asked", print_of)
    found = within_radius(own.select("asked"), out.select(print_of)).groupBy("asked").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(found, "asked", "left").withColumn("near_fingerprints", F.coalesce("n", F.lit(0))).drop("asked", "n")
    return own.unionByName(out.filter(~asked).withColumn("near_fingerprints", F.lit(None).cast("long")))


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    """Rows whose id is divisible by 50 are queries against all rows' fingerprints."""
    return near_counts(with_next(documents(spark, sf_dir)), F.col("doc_id") % 50 == 0)
