"""Token-id files: whole documents in ascending id order, in blocks of the context-mixing range coder.

A file is a Parquet container of self-contained blocks (Spark writes and reads it wherever the store
is). A block's bytes: magic, lengths, a zlib-packed table of document ids and id counts, and a coded
payload with the CRC-32 of its ids; `part` and `block` columns order them, `before` and `n_ids` hold how many
ids of the part stand before the block and in it. A document longer than a block goes on in the next ones.

Defined results: null text counts as empty and has its end id only; null doc_ids come last; rows
that share a doc_id are written each, in the order of their texts' hashes; an empty table gives an
empty file; other columns are not read. A damaged block raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .range_coder import decode, encode
from .runtime import documents, prepare, query, shared_dir, text_of, width, written
from .textkit import pieces
from .tokens import WordEncoder, default_tokenizer

MAGIC = b"IDF1"
BLOCK_IDS = 2_000_000
END_ID = 2
_NO_ID = -(2**63)
FILE_SCHEMA = "part int, block int, before long, n_ids long, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def pack_block(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, goes_on: bool, size: int) -> bytes:
    """goes_on: the first document began in an earlier block."""
    table = zlib.compress(np.concatenate([docs.astype("<i8"), sizes.astype("<i8")]).tobytes(), 6)
    return MAGIC + struct.pack("<QQB", len(docs), len(table), goes_on) + table + encode(ids, size)


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    if data[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, length, goes_on = struct.unpack_from("<QQB", data, 4)
    at = 4 + struct.calcsize("<QQB")
    table = np.frombuffer(zlib.decompress(data[at : at + length]), "<i8")
    ids = decode(data[at + length :])
    if table[n:].sum() != len(ids):
        raise ValueError("a block's table and its ids differ")
    return ids, table[:n], table[n:], bool(goes_on)


def _writer(path: str, end_id: int, block_ids: int):
    def go(batches):
        encoder, part = WordEncoder.load(path), TaskContext.get().partitionId()
        held, docs, sizes, count, block, before, goes_on = [], [], [], 0, 0, 0, False

        def full(ids, docs, sizes, goes_on):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack_block(ids, np.array(docs, np.int64), np.array(sizes, np.int64), goes_on, encoder.size)], pa.binary())], schema=_ARROW)

        for whole in batches:
            for batch in pieces(whole):
                ids, per = encoder.encode(batch.column("text"), end_id)
                held.append(ids.astype(np.uint32))
                docs += batch.column("doc_id").fill_null(_NO_ID).to_pylist()
                sizes += per.tolist()
                count += len(ids)
                while count >= block_ids:
                    flat = np.concatenate(held)
                    edges = np.cumsum(sizes)
                    k = int(np.searchsorted(edges, block_ids))  # the document that fills the block
                    inside = block_ids - (int(edges[k - 1]) if k else 0)
                    yield full(flat[:block_ids], docs[: k + 1], [*sizes[:k], inside], goes_on)
                    block, before = block + 1, before + block_ids
                    rest = sizes[k] - inside
                    docs, sizes = (docs[k:], [rest, *sizes[k + 1 :]]) if rest else (docs[k + 1 :], sizes[k + 1 :])
                    goes_on = rest > 0
                    held, count = [flat[block_ids:]], count - block_ids
        if docs:
            yield full(np.concatenate(held), docs, sizes, goes_on)

    return go


def write_ids(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts to the folder `to`: one range shuffle by id, then one pass."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    placed = base.repartitionByRange(width(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(_writer(tokenizer or default_tokenizer(), end_id, block_ids), FILE_SCHEMA).write.option("compression", "none").parquet(to)


_PIECE = "part int, block int, nth int, doc_id long, at long, ids_here long, crc long, goes_on boolean, last boolean"


def _reader(batches):
    """One row for each document in each block; crc covers the ids of this block only."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, docs, sizes, goes_on = unpack_block(batch.column("data")[r].as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            edge = np.cumsum(sizes)
            begin = edge - sizes
            n = len(docs)
            part, block, before = (batch.column(c)[r].as_py() for c in ("part", "block", "before"))
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()),
                pa.array([None if d == _NO_ID else d for d in docs.tolist()], pa.int64()), pa.array(before + begin), pa.array(sizes),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), edge.tolist(), strict=True)], pa.int64()),
                pa.array([goes_on] + [False] * (n - 1) if n else [], pa.bool_()), pa.array([False] * (n - 1) + [True] if n else [], pa.bool_()),
            ], ["part", "block", "nth", "doc_id", "at", "ids_here", "crc", "goes_on", "last"])


def _shift(crc: int, length: int) -> int:
    """crc32 register after `length` zero bytes, by repeated squaring of the one-bit operator."""
    op = [0xEDB88320, *[1 << k for k in range(31)]]

    def times(m, v):
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= m[k]
        return out

    bits = 8 * length
    while bits:
        if bits & 1:
            crc = times(op, crc)
        op = [times(op, m) for m in op]
        bits >>= 1
    return crc


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two stretches in a row from those of each."""
    return _shift(first, second_bytes) ^ second


def _joined(batches):
    """Pieces of a document that runs over several blocks come as lists in order."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            crc = 0
            for k, x in enumerate(row["pieces"]):
                crc = x["crc"] if not k else crc_join(crc, x["crc"], 4 * x["ids_here"])
            rows.append((row["doc_id"], row["at"], sum(x["ids_here"] for x in row["pieces"]), crc, row["part"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "at", "n_tokens", "ids_crc32", "part"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Every block is decoded and its checksum tested."""
    prepare(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    total, starts = 0, []
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect():  # one row for each part
        starts.append((row["part"], total))
        total += row["ids"]
    found = written(files.select("part", "block", "before", "data").mapInArrow(_reader, _PIECE), "read-ids")
    begin = F.broadcast(spark.createDataFrame(starts, "part int, begin long"))  # two numbers for each part
    cut = F.col("goes_on") | F.col("last")  # may be part of a longer document
    single = found.filter(~cut).select("doc_id", "at", F.col("ids_here").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "part")
    w = W.partitionBy("part").orderBy("block", "nth")
    grouped = found.filter(cut).withColumn("n", F.sum((~F.col("goes_on")).cast("int")).over(w))
    joined = grouped.groupBy("part", "n").agg(F.array_sort(F.collect_list(F.struct("block", "ids_here", "crc"))).alias("pieces"), F.min("at").alias("at"), F.first("doc_id").alias("doc_id"))
    whole = joined.mapInArrow(_joined, "doc_id long, at long, n_tokens long, ids_crc32 long, part int")
    both = single.unionByName(whole).join(begin, "part")
    return both.select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path)
    return read_ids(spark, path)
