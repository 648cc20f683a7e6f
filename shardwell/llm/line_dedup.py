"""Line dedup with a sharded minimal perfect hash.

1. Lines' keys are hashed twice (2 x 64 bits), once for each text; hashes and places of lines that are
   long enough go to a table, texts don't.
2. All distinct line hashes are counted by document (a partial aggregation comes first, so a very common
   line is a few rows) and dealt over shards. Each shard becomes one blob: a minimal perfect hash over the
   first hash, and arrays of second hash (the fingerprint), count and keeper (largest document id) beside
   it, whatever the count is.
3. Documents send their lines' hashes, packed by shard, to the blobs and probe the arrays: a line whose
   count is large enough goes, except in its keeper. Lines themselves never travel. A partition gets the
   blob first and its packets after it, and loads it once; a shard whose lines stand very often is
   dealt over several partitions, each with a copy of its blob.
4. The places of dropped lines go back to their documents.

Defined results: null or empty text is one empty line; rows that share a doc_id count as one
document, and each of them loses lines by its own text; a null doc_id counts as one document too and
keeps a line only if no other id holds it; an empty table gives an empty result; other columns of
docs are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import Shard
from .runtime import documents, query, text_of, width, written
from .textkit import _FOLD, _SPACE, flat, pieces, span_hash

SHARD_KEYS = 200_000
#: Lines in a packet; lines of a shard that one copy of its blob is asked for.
PACKET_LINES, ASKED_LINES = 200_000, 1_000_000
_NO_ID = -(2**63)
_HASHED = "id long, mark long, a array<long>, b array<long>, place array<int>"
_PACKET = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("id", pa.binary()), ("mark", pa.binary())])
_PACKET_SQL = "shard int, salt int, blob binary, a binary, b binary, doc binary, place binary, id binary, mark binary"


def line_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts in order: row, place in the text, start and end of the key, its code points; and the bytes, A-Z lower-cased."""
    data, at = flat(column)
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    start = np.concatenate([at[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.where(last, at[row + 1], np.append(start[1:], 0) - 1)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    solid = np.append(np.flatnonzero(~_SPACE[data]), len(data))
    left = solid[np.searchsorted(solid, start)]
    right = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    empty = left >= end
    left, right = np.where(empty, start, left), np.where(empty, start, right)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return row, place, left, right, points[right] - points[left], _FOLD[data]


def _hash(least_chars: int):
    names = ("id", "mark", "a", "b", "place")

    def go(batches):
        for whole in batches:
            for batch in pieces(whole):
                row, place, left, right, size, low = line_keys(batch.column("text"))
                good = size >= least_chars
                row, place, left, right = row[good], place[good], left[good], right[good]
                edge = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = (span_hash(low, left, right).view(np.int64), span_hash(low, left, right, 1).view(np.int64), place.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *(pa.ListArray.from_arrays(edge, pa.array(x)) for x in lists)], names)

    return go


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """keys: a, b (hashes), count, keeper. One row for each shard: shard, lines (with repeats), blob. A shard holds about SHARD_KEYS distinct hashes."""

    def build(table: pa.Table) -> pa.Table:
        a, b, count, keeper = (table.column(c).to_numpy() for c in ("a", "b", "count", "keeper"))
        blob = Shard.build(a.view(np.uint64), b.view(np.uint64), count, keeper).dump()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "lines": pa.array([int(count.sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, lines long, blob binary")


def _packets(shards: int, salts, packet_lines: int):
    def flush(held):
        ids, marks = (np.concatenate(x) for x in zip(*((h[0], h[1]) for h in held), strict=True))
        first = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        a, b, place = (np.concatenate([h[k] for h in held]) for k in (2, 3, 5))
        doc = np.concatenate([h[4] + f for h, f in zip(held, first, strict=True)])
        shard = a % shards
        order = np.lexsort((doc, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[s] : cuts[s + 1]]
            docs, at = np.unique(doc[own], return_inverse=True)
            rows.append((s, int(a[own[0]] ^ ids[docs[0]]) % int(salts.value[s]), None, a[own].tobytes(), b[own].tobytes(), at.astype(np.int32).tobytes(), place[own].tobytes(), ids[docs].tobytes(), marks[docs].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKET, strict=True)], schema=_PACKET)

    def pack(batches):
        held, lines = [], 0
        for batch in batches:
            edge = np.asarray(batch.column("a").offsets)
            if edge[-1] == edge[0]:
                continue
            a, b, place = (np.asarray(batch.column(c).flatten()) for c in ("a", "b", "place"))
            held.append((np.asarray(batch.column("id")), np.asarray(batch.column("mark")), a, b, np.repeat(np.arange(batch.num_rows), np.diff(edge)), place.astype(np.int32)))
            lines += len(a)
            if lines >= packet_lines:
                yield flush(held)
                held, lines = [], 0
        if lines:
            yield flush(held)

    return pack


def _probe(least_docs: int):
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("places", pa.list_(pa.int32()))])

    def go(batches):
        shard = None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("blob")[k].is_valid:
                    shard = Shard.load(batch.column("blob")[k].as_py())
                    continue
                a, b, doc, place, ids, marks = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("a", np.uint64), ("b", np.uint64), ("doc", np.int32), ("place", np.int32), ("id", np.int64), ("mark", np.int64)))
                found, count, keeper = shard.probe(a, b)
                drop = found & (count >= least_docs) & (keeper != ids[doc])
                if drop.any():
                    doc, place = doc[drop], place[drop]
                    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[new]]), pa.array(marks[doc[new]]), pa.ListArray.from_arrays(pa.array([*new, len(doc)], pa.int32()), pa.array(place))], schema=schema)

    return go


def _without(with_text: bool):
    def cut(batches):
        for batch in batches:
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            total, gone, kept = [], [], []
            for text, drop in zip(texts, places, strict=True):
                total.append(text.count("\n") + 1)
                gone.append(0)
                if drop:
                    lines, drop = text.split("\n"), set(drop)
                    gone[-1] = len(drop)
                    text = "\n".join(line for i, line in enumerate(lines) if i not in drop)
                kept.append(text)
            out = {"doc_id": batch.column("doc_id"), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept])}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(kept)} if with_text else {}))

    return cut


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, with_text: bool = True, shard_keys: int = SHARD_KEYS, packet_lines: int = PACKET_LINES, asked_lines: int = ASKED_LINES) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept_sha256 and, with_text, kept_text. The last three parameters size the work, not the result."""
    spark = docs.sparkSession
    n = width(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    base = base.withColumns({"id": F.coalesce("doc_id", F.lit(_NO_ID)), "mark": F.xxhash64("text")})
    hashed = written(base.select("id", "mark", "text").mapInArrow(_hash(least_chars), _HASHED), "line-hashes")
    shards = max(n, (hashed.agg(F.sum(F.size("a"))).first()[0] or 0) // shard_keys + 1)
    seen = hashed.select("id", F.explode(F.array_distinct(F.arrays_zip("a", "b"))).alias("line")).select("id", "line.a", "line.b")
    counted = seen.groupBy("a", "b").agg(F.count_distinct("id").alias("count"), F.max("id").alias("keeper"))
    blobs = written(build_shards(counted, shards), "line-shards")
    salts = np.ones(shards, np.int32)
    for row in blobs.filter(F.col("lines") > asked_lines).select("shard", "lines").collect():  # two numbers for a shard
        salts[row["shard"]] = -(-row["lines"] // asked_lines)
    packets = hashed.mapInArrow(_packets(shards, spark.sparkContext.broadcast(salts), packet_lines), _PACKET_SQL)
    copies = blobs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("lines") / asked_lines), F.lit(1)).cast("int") - 1)))
    asked = copies.select("shard", "salt", "blob", *[F.lit(None).cast("binary").alias(c) for c in _PACKET.names[3:]]).union(packets)
    drops = asked.repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull()).mapInArrow(_probe(least_docs), "id long, mark long, places array<int>")
    drops = drops.groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    joined = base.join(drops, ["id", "mark"], "left")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "places").mapInArrow(_without(with_text), schema)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, line, place, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", ORACLE)
def op3_line_dedup(spark, sf_dir):
    return line_dedup(documents(spark, sf_dir), with_text=False)
