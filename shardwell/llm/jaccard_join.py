"""N-gram Jaccard join by vertical partitioning: exact links between documents' sets of word shingles.

1. Every text becomes a set of hashed shingles. Equal sets are one class from here on, told apart by
   128 bits (copies cost one row each). A class has its size and a digest: one parity bit for each of
   about as many places as it has shingles.
2. The global order has rare shingles first: a count sketch over all shingles of all documents tells
   how far a shingle's count stands out of the load that any place of the sketch has; equals go by
   hash. Any order is right, a good one is cheap.
3. The order is cut into fragments. Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of
   each: these are posted and meet within their fragment by shingle. Postings of a task meet there
   first, and one of them stands for the others, so a shingle that very many sets hold is no single
   task's work.
4. In each meeting all sets are first tried against one hub. Links make components; only sets of
   different components that meet are tried against each other after that, so a large group of near
   copies costs a number of pairs near its size, and no link between components is lost.
5. Trying a pair: the digests give the least number of shingles that differ, which rules nearly all
   unlinked pairs out; for the others overlaps are counted by fragment, where the members' segments
   meet the hub's, and summed for each pair.

Defined results: null text and texts without words have an empty set and stand alone; shorter texts
than the shingle are one shingle; copies are linked with each other; repeated doc_ids are rows of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asked import asked_table, holds
from .components import components
from .runtime import documents, map_rows, passing_tables, query, text_of, width, written
from .textkit import U64, Words, binary16, lists_of, mix, pieces, runs, unlisted

SHINGLE, PERCENT = 5, 80
SKETCH_BITS, SKETCH_PARTS = 22, 16
FRAGMENTS = 8
#: Bits of a digest, by the size of its set.
LEAST_DIGEST, MOST_DIGEST = 64, 1 << 16
#: Postings that a task holds and lets meet before it gives them out.
HELD = 1 << 19
#: Members of a hub whose segments meet the hub's in one group.
GROUP = 512
_CLASS_SHIFT = U64(57)
_LOW = U64((1 << 57) - 1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column)
    h, of = runs(words, k, whole=True)
    edge = np.searchsorted(of, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent 64-bit keys of each set."""
    size = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate([np.zeros(0, U64), *sets])
    first = np.cumsum(size) - size
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([np.zeros(1, U64), np.cumsum(mix(total ^ U64(salt)), dtype=U64)])
        out.append(mix(run[first + size] - run[first]).view(np.int64))
    return size, *out


def digest(s: np.ndarray) -> np.ndarray:
    """Parity, at each place, of the number of shingles that fall there. Two sets differ in at least as many shingles as their digests differ in bits."""
    bits = min(MOST_DIGEST, max(LEAST_DIGEST, 1 << max(0, len(s) - 1).bit_length()))
    return np.packbits((np.bincount((mix(s) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Bits in which digests differ; the longer one is folded to the shorter one's size first."""
    x, at_x = unlisted(a, np.uint8)
    y, at_y = unlisted(b, np.uint8)
    size_x, size_y = np.diff(at_x), np.diff(at_y)
    out = np.zeros(len(a), np.int64)
    for u, v in set(zip(size_x.tolist(), size_y.tolist(), strict=True)):
        rows = np.flatnonzero((size_x == u) & (size_y == v))
        p, q = x[at_x[rows][:, None] + np.arange(u)], y[at_y[rows][:, None] + np.arange(v)]
        while p.shape[1] != q.shape[1]:
            if p.shape[1] > q.shape[1]:
                p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
            else:
                q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
        out[rows] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


_SETS = "doc_id long, mark long, other long, n long, k1 long, cid binary, digest binary, part int, salt int, counts binary"


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("cid", pa.binary()), ("digest", pa.binary()), ("part", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def go(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), k)
                size, k1, k2 = set_keys(sets)
                np.add.at(sketch, (np.concatenate([np.zeros(0, U64), *sets]) >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n = batch.num_rows
                digests = pa.array([digest(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.int64()) for c in ("doc_id", "mark", "other")), pa.array(size), pa.array(k1), binary16(k1, k2), digests, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], schema=schema)
        if sketch.any():
            salt = TaskContext.get().partitionId() >> 8
            for p, x in enumerate(np.split(sketch, SKETCH_PARTS)):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:7]), pa.array([p], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], schema=schema)

    return go


def sum_sketch(batches):
    """One row for each part and salt."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for p, salt, x in zip(batch.column("part").to_pylist(), batch.column("salt").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            have = total.setdefault((p, salt), np.zeros(len(counts), np.uint32))
            np.minimum(have.astype(np.int64) + counts, 2**32 - 1, out=have, casting="unsafe")
    for (p, salt), x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["part", "salt", "counts"])


def count_classes(counts: np.ndarray, load: float) -> np.ndarray:
    """How far a place's count stands out of the usual load, in its deviations: two classes to an octave, 0 to 63."""
    excess = (counts - load) / np.sqrt(load + 1)
    return np.minimum(63, np.floor(2 * np.log2(np.maximum(excess, 1)))).astype(np.uint8)


def _classify(load: float):
    def go(batches):
        for batch in batches:
            for p, x in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
                classes = count_classes(counts, load)
                mass = np.bincount(classes, counts, minlength=64)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([classes.tobytes()], pa.binary()), pa.array([mass.tolist()], pa.list_(pa.float64()))], ["part", "classes", "mass"])

    return go


class Order:
    """The global order: class of a shingle's estimated count, then its hash; and cuts into fragments of about equal mass."""

    def __init__(self, classes: np.ndarray, mass: np.ndarray, fragments: int = FRAGMENTS):
        self.classes = classes
        run = np.concatenate([[0], np.cumsum(mass)])
        goal = np.arange(1, fragments) / fragments * run[-1]
        at = np.clip(np.searchsorted(run, goal, "right") - 1, 0, 63)
        inside = (goal - run[at]) / np.maximum(mass[at], 1)
        self.cuts = (at.astype(U64) << _CLASS_SHIFT) + (np.clip(inside, 0, 1) * float(1 << 57)).astype(U64)

    def ranked(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """Sets as sorted places in the order."""
        return [np.sort((self.classes[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << _CLASS_SHIFT) | (mix(s) & _LOW)) for s in sets]


def global_order(sketches: DataFrame, shingles: int) -> Order:
    """From the tasks' sketches (part, salt, counts). A byte for each place of the sketch reaches the driver."""
    table = "part int, salt int, counts binary"
    summed = sketches.repartition(4 * SKETCH_PARTS, "part", "salt").mapInArrow(sum_sketch, table)
    classify = _classify(shingles / (1 << SKETCH_BITS))
    classified = summed.withColumn("salt", F.lit(0)).repartition(SKETCH_PARTS, "part").mapInArrow(lambda batches: classify(sum_sketch(batches)), "part int, classes binary, mass array<double>")
    classes, mass = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8), np.zeros(64)
    for row in classified.collect():  # SKETCH_PARTS rows
        classes[row["part"]] = np.frombuffer(bytes(row["classes"]), np.uint8)
        mass += np.array(row["mass"])
    return Order(classes.ravel(), mass)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that a partner must at least have with a set of n."""
    return -(-percent * n // 100)


def _possible(n, pos, hub_n, hub_pos, percent: int) -> np.ndarray:
    """Sizes allow the link, and so does what can follow a first common shingle at these places."""
    small, large = np.minimum(n, hub_n), np.maximum(n, hub_n)
    most = 1 + np.minimum(n - pos - 1, hub_n - hub_pos - 1)
    return (small * 100 >= large * percent) & (most * (100 + percent) >= (n + hub_n) * percent)


#: kind 0: a posting; 1: one that also stands for others, which have met it in their task; 2: such an other one. hub: the set to be tried against, if a link is possible.
_POSTED = "tok long, cid long, n long, pos long, kind int, hub long"
_ROWS = pa.schema([("tok", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("kind", pa.int32()), ("hub", pa.int64())])
_KEYS = ("tok", "cid", "n", "pos", "kind")


def _rows(rows: dict[str, np.ndarray], hub: np.ndarray, has: np.ndarray):
    for a in range(0, len(has), 1 << 16):
        b = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[k][b], f.type) for k, f in zip(_KEYS, _ROWS, strict=False)), pa.array(hub[b], pa.int64(), mask=~has[b])], schema=_ROWS)


def _groups(rows: dict[str, np.ndarray], percent: int):
    """Of rows in order of tok, pos, cid, kind (descending): without repeats; the place of each one's first row of the same shingle, which has the fewest rarer shingles of its own and so is nearest to what the others share; and whether a link with it is possible."""
    same = np.zeros(len(rows["tok"]), bool)
    same[1:] = (rows["tok"][1:] == rows["tok"][:-1]) & (rows["cid"][1:] == rows["cid"][:-1]) & (rows["n"][1:] == rows["n"][:-1])
    rows = {k: v[~same] for k, v in rows.items()}
    new = np.concatenate([[True], rows["tok"][1:] != rows["tok"][:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = np.arange(len(first)) != first
    able = own & (rows["cid"] != rows["cid"][first]) & _possible(rows["n"], rows["pos"], rows["n"][first], rows["pos"][first], percent)
    return rows, first, own, able


def _post(order, k: int, percent: int):
    def go(batches):
        done: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            rows = dict(zip(("tok", "cid", "n", "pos"), (np.concatenate(c) for c in zip(*held, strict=True)), strict=True))
            at = np.lexsort((rows["cid"], rows["pos"], rows["tok"]))
            rows = {c: v[at] for c, v in rows.items()} | {"kind": np.zeros(len(at), np.int64)}
            rows, first, own, able = _groups(rows, percent)
            rows["kind"][own] = 2
            rows["kind"][first[own]] = 1
            yield from _rows(rows, rows["cid"][first], able)
            held.clear()

        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), k)
                _, k1, k2 = set_keys(sets)
                mine = [i for i, (s, c) in enumerate(zip(sets, zip(k1.tolist(), k2.tolist(), strict=True), strict=True)) if len(s) and not (c in done or done.add(c))]
                if len(done) > 1 << 20:
                    done.clear()
                if not mine:
                    continue
                ranked = order.value.ranked([sets[i] for i in mine])
                n = np.array([len(r) for r in ranked])
                p = n - _least(n, percent) + 1
                held.append((np.concatenate([r[:x] for r, x in zip(ranked, p.tolist(), strict=True)]).view(np.int64), np.repeat(k1[mine], p), np.repeat(n, p), np.concatenate([np.arange(x) for x in p.tolist()])))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return go


def _meet(percent: int):
    """Rows come sorted by tok, pos, cid, kind (descending). Those of shingles with two sets or more stay, each with the first of its shingle as hub where a link is possible."""

    def go(batches):
        carried, given, kept = None, False, None  # the open shingle's first row, whether it was given out, and the last row seen
        for batch in batches:
            hub = batch.column("hub")
            rows = {c: np.asarray(batch.column(c)).astype(np.int64) for c in _KEYS}
            met = rows["kind"] == 2
            if met.any():
                has = np.asarray(hub.is_valid())
                yield from _rows({c: v[met] for c, v in rows.items()}, np.asarray(hub.fill_null(0))[met], has[met])
            rows = {c: v[~met] for c, v in rows.items()}
            if not len(rows["tok"]):
                continue
            if kept is not None and all(kept[c] == rows[c][0] for c in ("tok", "cid", "n")):
                rows = {c: v[1:] for c, v in rows.items()}
                if not len(rows["tok"]):
                    continue
            kept = {c: v[-1] for c, v in rows.items()}
            if carried is not None:
                rows = {c: np.concatenate([carried[c], v]) for c, v in rows.items()}
            rows, first, own, able = _groups(rows, percent)
            stays = own | (rows["kind"] == 1)
            stays[first[own]] = True
            if carried is not None and given:
                stays[0] = False  # it went out before
            yield from _rows({c: v[stays] for c, v in rows.items()}, rows["cid"][first][stays], able[stays])
            at = first[-1]
            given = bool(stays[at]) or (given and carried is not None and at == 0)
            carried = {c: v[at : at + 1] for c, v in rows.items()}

    return go


def _near(percent: int):
    """Pairs whose digests allow the link."""

    def go(batches):
        for batch in batches:
            n = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            far = differing(batch.column("digest_a"), batch.column("digest_b"))
            yield batch.filter(pa.array((n - far) * (100 + percent) >= 2 * percent * n)).select(["a", "b", "n_a", "n_b"])

    return go


def _tried(pairs: DataFrame, classes: DataFrame, percent: int, what: str) -> DataFrame:
    """Pairs x, y of first key halves as pairs a, b of classes with their sizes, without those that sizes or digests rule out."""
    side = lambda key, s: classes.select(F.col("k1").alias(key), F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"digest_{s}"))
    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").filter((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") != F.col("b")))
    return written(both.select("a", "b", "n_a", "n_b", "digest_a", "digest_b").mapInArrow(_near(percent), "a binary, b binary, n_a long, n_b long"), what)


def _segments(order, k: int, asked):
    schema = pa.schema([("cid", pa.binary()), ("frag", pa.int32()), ("toks", pa.binary())])

    def go(batches):
        done: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in pieces(whole):
                sets = shingle_sets(batch.column("text"), k)
                _, k1, k2 = set_keys(sets)
                mine = [i for i in np.flatnonzero(holds(asked.value, k1)).tolist() if len(sets[i]) and not ((c := (int(k1[i]), int(k2[i]))) in done or done.add(c))]
                if not mine:
                    continue
                ranked = order.value.ranked([sets[i] for i in mine])
                sizes = np.array([np.diff(np.concatenate([[0], np.searchsorted(r, order.value.cuts), [len(r)]])) for r in ranked])
                of, frag = np.nonzero(sizes)
                yield pa.RecordBatch.from_arrays([binary16(k1[mine][of], k2[mine][of]), pa.array(frag.astype(np.int32)), lists_of(np.concatenate(ranked), sizes[of, frag])], schema=schema)

    return go


def _count(batches):
    """Rows of a hub, salt and fragment come together, the hub's own segment first: the overlap of each member's segment with it."""
    last, own = None, np.zeros(0, U64)
    for batch in batches:
        if not batch.num_rows:
            continue
        toks, at = unlisted(batch.column("toks"), U64)
        hub, _ = unlisted(batch.column("a"), "S16")
        key = np.stack([hub, np.asarray(batch.column("frag")).astype("S16"), np.asarray(batch.column("salt")).astype("S16")], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        is_hub = np.asarray(batch.column("b").is_null())
        shared = np.zeros(batch.num_rows, np.int64)
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
            if last is None or (key[i] != last).any():
                last, own = key[i], np.zeros(0, U64)
            while i < j and is_hub[i]:
                own = toks[at[i] : at[i + 1]].copy()
                i += 1
            if i < j and len(own):
                part = toks[at[i] : at[j]]
                hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
                run = np.concatenate([[0], np.cumsum(hit)])
                shared[i:j] = np.diff(run[at[i : j + 1] - at[i]])
        keep = pa.array(~is_hub & (shared > 0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(shared)], ["a", "b", "n_a", "n_b", "shared"]).filter(keep)


def _first_half(key: str):
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def verified(pairs: DataFrame, base: DataFrame, order, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b, n_a, n_b) that link, with their overlap: partial overlaps by fragment, summed for each pair."""
    spark = pairs.sparkSession
    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).select(_first_half("cid").alias("key"))
    asked = spark.sparkContext.broadcast(asked_table(asked))
    segments = base.mapInArrow(_segments(order, k, asked), "cid binary, frag int, toks binary")
    segments = written(segments.dropDuplicates(["cid", "frag"]), "segments")
    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts")), "hubs", narrow=True)
    own = hubs.join(segments, hubs["a"] == segments["cid"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "frag", F.lit(None).cast("binary").alias("b"), F.lit(0).cast("long").alias("n_a"), F.lit(0).cast("long").alias("n_b"), "toks")
    members = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = members.join(segments, members["b"] == segments["cid"]).select("a", "salt", "frag", "b", "n_a", "n_b", "toks")
    dealt = own.unionByName(members).repartition(width(spark), "a", "salt", "frag").sortWithinPartitions("a", "salt", "frag", F.col("b").asc_nulls_first())
    summed = dealt.mapInArrow(_count, "a binary, b binary, n_a long, n_b long, shared long").groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return written(summed.filter(F.col("shared") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent), "links")


def _cross(met: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y (first key halves) of sets of different components that meet where a link is possible: first components, then their sets."""
    own = met.select("tok", "cid", "n", "pos").join(labels.select(_first_half("v").alias("cid"), "label"), "cid", "left")
    own = own.withColumn("label", F.coalesce("label", F.to_binary(F.lpad(F.hex("cid"), 16, "0"), F.lit("hex"))))
    mixed = own.groupBy("tok").agg(F.min("label").alias("u"), F.max("label").alias("v")).filter("u <> v").select("tok")
    own = written(own.join(mixed, "tok", "left_semi"), "mixed-meetings")
    groups = own.groupBy("tok", F.col("label").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"))
    near = F.least(F.col("n") - F.col("pos"), F.col("reach")) * (100 + percent) >= (F.col("n") + F.col("low")) * percent  # as _possible has it, for the best of the other component's sets
    sides = own.join(groups, "tok").filter((F.col("label") < F.col("other")) & near & (F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent))
    right = own.select("tok", F.col("label").alias("other"), F.col("cid").alias("cid_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    small, large = F.least("n", "n_b"), F.greatest("n", "n_b")
    most = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    cross = sides.join(right, ["tok", "other"]).filter((small * 100 >= large * percent) & (most * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent))
    return cross.select(F.least("cid", "cid_b").alias("x"), F.greatest("cid", "cid_b").alias("y")).distinct()


def _placed(base: DataFrame, k: int, percent: int) -> DataFrame:
    """base: doc_id, text, mark, other. One row for each of its rows: doc_id, mark, other, n (set size), label (of its component, or of its class)."""
    spark = base.sparkSession
    with passing_tables(spark) as kept:
        both = written(base.mapInArrow(_sets(k), _SETS), "sets")
        sets = both.filter("part IS NULL").select("doc_id", "mark", "other", "n", "k1", "cid", "digest")
        order = global_order(both.filter("part IS NOT NULL").select("part", "salt", "counts"), sets.agg(F.sum("n")).first()[0] or 0)
        order = spark.sparkContext.broadcast(order)
        classes = written(sets.filter("n > 0").dropDuplicates(["cid"]).select("k1", "cid", "n", "digest"), "classes")
        posted = base.mapInArrow(_post(order, k, percent), _POSTED)
        dealt = posted.repartition(width(spark), F.when(F.col("kind") == 2, F.xxhash64("cid")).otherwise(F.col("tok"))).sortWithinPartitions("tok", "pos", "cid", F.desc("kind"))
        met = written(dealt.mapInArrow(_meet(percent), _POSTED).drop("kind"), "meetings")
        alike = classes.groupBy("k1").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("k1").alias("x"), F.col("k1").alias("y"))  # different sets with one first half
        star = met.filter("hub IS NOT NULL").select(F.col("hub").alias("x"), F.col("cid").alias("y")).distinct().union(alike)
        links = verified(_tried(star, classes, percent, "hub-pairs"), base, order, k, percent)
        labels = components(links)
        tried = star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        cross = _tried(_cross(met, labels, percent).join(tried, ["x", "y"], "left_anti"), classes, percent, "cross-pairs")
        if not cross.isEmpty():
            labels = components(links.select("a", "b").union(verified(cross, base, order, k, percent).select("a", "b")))
        return kept(written(sets.join(labels, F.col("cid") == F.col("v"), "left").select("doc_id", "mark", "other", "n", F.coalesce("label", "cid").alias("label")), "placed"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """mark and other tell rows apart by id and text."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), text_of(f"`{text_col}`")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("mark"), F.xxhash64(F.lit(1), text).alias("other"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    placed = _placed(_base(docs, id_col, text_col), k, percent)
    # written, so that the join's sides are plain exchanges and a label with very many rows can be split over tasks
    lowest = written(placed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("lowest")), "lowest")
    out = placed.filter("n > 0").join(lowest, "label").select("doc_id", F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"))
    return out.unionByName(placed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, all columns as they were: that of the smallest id, null ids last, then by a hash of the text; of rows that repeat id and text, one. Rows without words all stay.

    Rows are told by id and text, so null and repeated ids do no harm. Only rows of components with several rows are shuffled.
    """
    spark = docs.sparkSession
    placed = _placed(_base(docs, id_col, text_col), k, percent).filter("n > 0")
    several = written(placed.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "other")).alias("first")).filter("m > 1"), "several")
    met = written(placed.join(several, "label").select("mark", "other", ((F.col("mark") == F.col("first.mark")) & (F.col("other") == F.col("first.other"))).alias("stays")).distinct(), "met")
    table = spark.sparkContext.broadcast(asked_table(met.select("mark")))
    names, mark = docs.columns, f"mark-{uuid.uuid4().hex}"
    doc_id, text = F.col(f"`{id_col}`").cast("long"), text_of(f"`{text_col}`")
    marked = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(doc_id, text).alias(mark))

    def part(inside: bool) -> DataFrame:
        def go(batches):
            for batch in batches:
                yield batch.filter(pa.array(holds(table.value, np.asarray(batch.column(mark))) == inside))

        return map_rows(marked, go)

    own = part(True).withColumns({f"{mark}-2": F.xxhash64(F.lit(1), text), f"{mark}-row": F.struct(*[F.col(f"`{c}`") for c in names])}).select(F.col(f"`{mark}`").alias("mark"), F.col(f"`{mark}-2`").alias("other"), F.col(f"`{mark}-row`").alias("row"))
    joined = own.join(met, ["mark", "other"], "left")
    nth = F.row_number().over(W.partitionBy("mark", "other").orderBy(F.lit(0)))
    kept = joined.withColumn("nth", F.when(F.col("stays"), nth).otherwise(1)).filter("nth = 1 AND coalesce(stays, true)").select("row.*")
    return part(False).select(*[F.col(f"`{c}`") for c in names]).union(kept)


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))
