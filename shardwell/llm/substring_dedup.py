"""Substring dedup by collinear chaining.

1. Seeds: of every `WINDOW` runs of `K` words in a row the one with the smallest hash, so two texts
   that share K + WINDOW - 1 words in a row share a seed.
2. Seeds meet by hash, packed for the shuffle; a partition's seeds are held in memory by its task, some
   20 bytes for each, and so are a partition's links of pairs after that. Up to `FEW` holders of a seed are matched each with each. Where more hold it, all
   are matched with the text of smallest key, and the seed is made longer: those that go on with the
   same 12 words are a group of their own, within it those that go on with the same 24, and within that
   those that go on with the same `LEAST` words; a group of up to FEW is again matched each with each, a
   larger one with its smallest key. So texts that share `LEAST` words exactly are always linked by a
   text with all of them, and a seed that very many texts hold stays linear. Seeds that more than `HOT`
   texts may hold don't meet in a task: the same groups, smallest keys and pairs are made by aggregations
   and joins that combine and split them.
3. Matches of a pair of documents that follow each other without a break are blocks; chains of blocks
   that go up in both documents are scored with a cost for each word passed over, the best predecessor
   coming from a Fenwick tree of prefix maxima. Chains are taken best first, each block once, and parted
   where more than `GAP` words lie between two blocks. Chains of fewer than `CHAINED` words in blocks are
   given up.
4. Chains fetch the words between their blocks and around them; these are aligned word by word. Where a
   chain as a whole is not alike it is parted at its worst gap, until every part is; ends are extended,
   over changed, added and missing words and as far as they go; parts of at least `LEAST` matched words
   and `IDENTITY` are passages.
5. The rest of the seeds that more than FEW texts hold: their holders form classes, one for each text of
   smallest key that passages found so far lead to at that place. All holders of different classes are
   held against each other by digests of the words on both sides: a passage of `LEAST` matched words
   leaves half of those outside the seed on one side of it, with all that may be amiss. Pairs that digests
   don't rule out are held against each other by the words beside the seed, as far as a passage of twice
   the length can reach: the most that match in order must leave room for a passage in both texts. Pairs
   whose words, extended as in 4, surely hold one join their classes and are aligned by that seed alone;
   of two classes that are joined no other pair is looked at. The rest goes through 3 and 4, there without
   CHAINED. However many texts hold a seed, so, two that
   share a passage of `LEAST` words over it have a row or are in one class. Not looked for: longer
   passages with more amiss than that on both sides of each common seed, and those that go on out of sight
   with less than `OPEN` of the words there matching beside each common seed. Digests are
   compared for all pairs of classes: work that grows with the square of the texts that hold a common
   phrase, in blocks of `BLOCK` that are dealt over tasks.

Rows are a function of the table: they don't depend on how it is dealt over partitions.

Defined results: null or short texts have no passages; words are compared with A-Z lower-cased;
repeats within one document are not reported; rows that repeat doc_id and text are one row; other
columns are not read; an empty table gives an empty result. Null doc_ids are carried as null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asked import asked_table, holds
from .jaccard_join import SKETCH_BITS, SKETCH_PARTS, sum_sketch
from .runtime import documents, query, text_of, width, written
from .textkit import U64, Words, mix, pieces, run_hash

K, WINDOW = 6, 3
LEAST, IDENTITY = 50, 0.8
SKIP_COST = 0.1
#: Holders of a seed that are matched each with each; words that the longer seed goes on with.
FEW, LONGER = 6, (12, 24)
#: Holders of a seed that a task takes together.
HOT = 1_000_000
#: Words between blocks at which a chain is parted, and words in blocks that a chain must have.
GAP, CHAINED = 256, 9
#: Bits of a digest, holders in a block, and how far two places of a hub may lie apart that passages over one seed lead to.
DIGEST, BLOCK, DRIFT = 256, 2048, 64
#: Bits of a digest of all words in sight on one side.
PARITIES = 4096


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of x[i : i + w] for each i, by doubling."""
    have, out = 1, x
    while 2 * have <= w:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(x) - w + 1], out[w - have : len(x) - w + 1 + w - have]) if have < w else out


def seeds(words: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place (word in its text) of each text's seeds. A run that a text repeats counts as another seed each time, so that its first stands for the first elsewhere, the second for the second."""
    n, doc = len(words.hash), words.doc()
    none = np.zeros(0, np.int64)
    if n < k + window - 1:
        return none.view(U64), none, none
    h = run_hash(words.hash, k)
    low = _slide(h, window, np.minimum)
    low[doc[: len(low)] != doc[k + window - 2 :]] = 0  # windows over the end of a text
    padded = np.concatenate([np.zeros(window - 1, U64), low, np.zeros(window - 1, U64)])
    at = np.flatnonzero((h == _slide(padded, window, np.maximum)) & (h > 0))
    row, h = doc[at], h[at]
    order = np.lexsort((at, h, row))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])[: len(order)]
    place = np.arange(len(order))
    nth = np.empty(len(order), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    h = np.where(nth > 0, mix(h + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), h)
    return h, row, at - words.first[row]


def going_on(words: Words, at: np.ndarray, row: np.ndarray, kinds: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each (length, bits) some bits, never all zero, of the run of `length` words from each word `at`, as `run_hash` has it; 0 where the text ends sooner. Runs share their halves."""
    whole = [np.flatnonzero(at + length <= words.first[row + 1]) for length, _ in kinds]
    have, part, done, runs = 1, words.hash, [0] * len(kinds), [None] * len(kinds)
    while have <= max(length for length, _ in kinds):
        for i, (length, _) in enumerate(kinds):
            if length & have:
                own = part[at[whole[i]] + done[i]]
                runs[i] = own if runs[i] is None else mix(runs[i] * U64(0xFF51AFD7ED558CCD) + own)
                done[i] += have
        n = max(len(part) - have, 0)
        part = mix(part[:n] * U64(0xC2B2AE3D27D4EB4F) + part[have : have + n])
        have *= 2
    out = []
    for i, (_, bits) in enumerate(kinds):
        some = np.zeros(len(at), np.uint32)
        some[whole[i]] = np.maximum(runs[i] >> U64(64 - bits), U64(1)).astype(np.uint32)
        out.append(some)
    return out


def _goings(least: int) -> tuple[tuple[int, int], ...]:
    return (K + LONGER[0], 16), (K + LONGER[1], 16), (least, 24)


#: Seeds of a batch that meet in one partition, in order of their hash: keys of the texts, then for each seed the number of its text, its hash, how it goes on (long, longer, least) and its place. Bytes of equal weight stand together, which compresses better.
_POST = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("seeds", pa.binary())])
_POST_SQL = "part int, n int, keys binary, seeds binary"
_PLANES = (("row", 4), ("seed", 5), ("long", 2), ("longer", 2), ("least", 3), ("pos", 4))


def _planes(columns: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(columns[c].astype("<u8").view(np.uint8).reshape(-1, 8)[:, b]).tobytes() for c, width_ in _PLANES for b in range(width_))


def _unplaned(data: bytes, n: int) -> dict[str, np.ndarray]:
    raw, out, at = np.frombuffer(data, np.uint8).reshape(-1, n), {}, 0
    for c, width_ in _PLANES:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width_] = raw[at : at + width_].T
        out[c] = x.view("<u8").ravel()
        at += width_
    return out


def _cell(h: np.ndarray) -> np.ndarray:
    """Place of a seed in the sketch that counts seeds."""
    return (mix(h) >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _is_hot(h: np.ndarray, hot) -> np.ndarray:
    if hot is None:
        return np.zeros(len(h), bool)
    at = _cell(h)
    return (hot.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _count_seeds(batches):
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for whole in batches:
        for batch in pieces(whole):
            np.add.at(sketch, _cell(seeds(Words(batch.column("text")))[0]), 1)
    salt = TaskContext.get().partitionId() >> 8
    for p, x in enumerate(np.split(sketch, SKETCH_PARTS)):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["part", "salt", "counts"])


def hot_cells(base: DataFrame, most: int) -> np.ndarray | None:
    """A bit for each place of the sketch whose seeds more than `most` texts may hold; None where so few texts can't."""
    if base.count() <= most:
        return None
    table = "part int, salt int, counts binary"
    summed = base.select("text").mapInArrow(_count_seeds, table).repartition(4 * SKETCH_PARTS, "part", "salt").mapInArrow(sum_sketch, table)
    summed = summed.withColumn("salt", F.lit(0)).repartition(SKETCH_PARTS, "part").mapInArrow(sum_sketch, table)
    hot = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), bool)
    for row in summed.collect():  # SKETCH_PARTS rows, packed
        hot[row["part"]] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint32) > most
    return np.packbits(hot.ravel()) if hot.any() else None


def common_of(seed: np.ndarray, least: np.ndarray, few: int = FEW) -> np.ndarray:
    """Rows of seeds that more than few rows hold, but for those whose holders all go on with the same `least` words: these all have their hub."""
    order = np.argsort(seed, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], seed[order][1:] != seed[order][:-1]]))
    size = np.diff(np.append(begin, len(seed)))
    low, high = np.minimum.reduceat(least[order], begin), np.maximum.reduceat(least[order], begin)
    return order[np.repeat((size > few) & ((low != high) | (low == 0)), size)]


_HOT_ROW = "seed long, long int, longer int, least int, key long, pos int"


def _post_hot(least: int, hot):
    """Seeds of hot places as plain rows."""

    def go(batches):
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                h, row, pos = seeds(words)
                here = _is_hot(h, hot)
                h, row, pos = h[here], row[here], pos[here]
                at = words.first[row] + pos
                keys = np.asarray(batch.column("key"))
                going = [g.astype(np.int32) for g in going_on(words, at, row, _goings(least))]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(g) for g in going), pa.array(keys[row]), pa.array(pos.astype(np.int32))], ["seed", "long", "longer", "least", "key", "pos"])

    return go


def hot_common(rows: DataFrame, few: int = FEW) -> DataFrame:
    """What `common_of` gives: seed, key, pos."""
    groups = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("low"), F.max("least").alias("high"))
    return rows.join(groups.filter((F.col("n") > few) & ((F.col("low") != F.col("high")) | (F.col("low") == 0))), "seed").select("seed", "key", "pos")


def hot_links(rows: DataFrame, few: int = FEW) -> DataFrame:
    """What `links` gives, from rows of seeds that no task could take together: key, hub, pos, hub_pos."""
    alive, out = rows, None
    columns = ["seed", "long", "longer", "least"]
    for depth in range(len(columns)):
        own = columns[: depth + 1]
        alive = alive.filter(f"{own[-1]} > 0") if depth else alive
        groups = written(alive.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("hub")).filter("n > 1"), "hot-groups")
        joined = alive.join(groups, own)
        star = joined.filter(F.col("n") > few).select("key", F.col("hub.key").alias("hub"), "pos", F.col("hub.pos").alias("hub_pos"))
        each = joined.filter(F.col("n") <= few).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("key", "pos"))).alias("held"))  # few at most
        after = lambda a, i: F.transform(F.slice("held", i + 2, few), lambda b: F.struct(b.key.alias("key"), a.key.alias("hub"), b.pos.alias("pos"), a.pos.alias("hub_pos")))
        pairs = each.select(F.explode(F.flatten(F.transform("held", after))).alias("p")).select("p.*")
        found = star.union(pairs).filter("key <> hub")
        out = found if out is None else out.union(found)
        alive = joined.filter(F.col("n") > few).select(*columns, "key", "pos")
    return out


def _pack_hot(parts: list[int]):
    def go(batches):
        for batch in batches:
            yield from _packets(*(np.asarray(batch.column(c)) for c in ("key", "hub", "pos", "hub_pos")), parts)

    return go


def _post(parts: list[int], least: int, hot=None):
    names = ("row", "h", "long", "longer", "least", "pos")

    def go(batches):
        for whole in batches:
            for batch in pieces(whole, most=1 << 22):
                found, before = [], 0
                for piece in pieces(batch):  # arrays of this size are used again, larger ones are fresh pages each time
                    words = Words(piece.column("text"))
                    h, row, pos = seeds(words)
                    cold = ~_is_hot(h, hot)
                    h, row, pos = h[cold], row[cold], pos[cold]
                    if len(h):
                        found.append((row + before, h, *going_on(words, words.first[row] + pos, row, _goings(least)), pos))
                    before += piece.num_rows
                if not found:
                    continue
                columns = dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))
                h = columns.pop("h")
                part = ((h >> U64(40)) % U64(len(parts))).astype(np.int64)
                columns["seed"] = h & U64((1 << 40) - 1)
                order = np.argsort(part.astype(U64) << U64(40) | columns["seed"], kind="stable")
                columns = {c: v[order] for c, v in columns.items()}
                edge = np.searchsorted(part[order], np.arange(len(parts) + 1))
                keys, out = np.asarray(batch.column("key")), []
                for n, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    if a < b:
                        mine = {c: v[a:b] for c, v in columns.items()}
                        texts, mine["row"] = np.unique(mine["row"], return_inverse=True)
                        out.append((parts[n], b - a, keys[texts].tobytes(), _planes(mine)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _POST, strict=True)], schema=_POST)

    return go


def _within(rows: np.ndarray, new: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, hub) among rows, which stand in groups that begin where `new`: each with each in groups of up to few, else with the group's first; and the rows of the larger groups."""
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.concatenate([begin, [len(rows)]]))[group]
    small = size <= few
    a, b = [rows[~small]], [rows[begin[group]][~small]]
    for d in range(1, few):
        i = np.flatnonzero(small[d:] & (group[d:] == group[: len(group) - d])) + d
        a.append(rows[i])
        b.append(rows[i - d])
    return np.concatenate(a), np.concatenate(b), rows[~small]


def links(seed: np.ndarray, key: np.ndarray, pos: np.ndarray, *going: np.ndarray, few: int = FEW) -> list[np.ndarray]:
    """key, hub, pos, hub_pos of all links; hub is the smaller key of the two. going: how each seed goes on, for longer and longer runs; 0 where the text ends."""
    order = np.argsort(seed, kind="stable")
    same = seed[order][1:] == seed[order][:-1]
    rows = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(1 + len(going)):
        held = (seed, *going[:depth])
        rows = rows[held[-1][rows] > 0] if depth else rows
        if not len(rows):
            break
        rows = rows[np.lexsort((pos[rows], key[rows], *(h[rows] for h in reversed(held))))]
        new = np.ones(len(rows), bool)
        new[1:] = np.any([h[rows][1:] != h[rows][:-1] for h in held], axis=0)
        a, b, rows = _within(rows, new, few)
        found.append((a, b))
    if not found:
        return [key[:0], key[:0], pos[:0], pos[:0]]
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    a, b = np.where(key[a] >= key[b], a, b), np.where(key[a] >= key[b], b, a)
    good = key[a] != key[b]
    return [key[a][good], key[b][good], pos[a][good], pos[b][good]]


#: Links that a partition of seeds sends to one where pairs are chained: pairs of texts, how many links each has, and their places.
_LINKS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("hubs", pa.binary()), ("counts", pa.binary()), ("pos", pa.binary()), ("hub_pos", pa.binary())])
_LINKS_SQL = "part int, keys binary, hubs binary, counts binary, pos binary, hub_pos binary"
#: Links, or holders of a common seed: seeds, keys, pos.
_MET_SQL = _LINKS_SQL + ", seeds binary"


_MET = _LINKS.append(pa.field("seeds", pa.binary()))


def _common(batches):
    for batch in batches:
        for keys, pos, held in zip(*(batch.column(c).to_pylist() for c in ("keys", "pos", "seeds")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(held, np.int64)), pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(pos, np.int32))], ["seed", "key", "pos"])


def _meet(parts: list[int]):
    """All seeds of a partition."""

    def go(batches):
        held = []
        for batch in batches:
            for part, n, keys, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "keys", "seeds")), strict=True):
                x = _unplaned(packed, n)
                held.append((x["seed"] | U64((part & 0xFFFFFF) << 40), np.frombuffer(keys, np.int64)[x["row"].astype(np.int64)], x["pos"].astype(np.int32), x["long"].astype(np.uint16), x["longer"].astype(np.uint16), x["least"].astype(np.uint32)))
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        del held
        found = links(*columns)
        at = common_of(columns[0], columns[5])
        for i in range(0, len(at), 1 << 18):
            own = at[i : i + (1 << 18)]
            row = {"keys": columns[1][own], "pos": columns[2][own], "seeds": columns[0][own]}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name].tobytes()] if f.name in row else [None], f.type) for f in _MET], schema=_MET)
        del columns
        for batch in _packets(*found, parts):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], schema=_MET)

    return go


def _packets(key: np.ndarray, hub: np.ndarray, pos: np.ndarray, hub_pos: np.ndarray, parts: list[int]):
    """Links without repeats, packed by the partition where their pair is chained."""
    if len(key):
        part = (mix(key.view(U64) * U64(0x9E3779B97F4A7C15) ^ hub.view(U64)) % U64(len(parts))).astype(np.int64)
        order = np.lexsort((hub_pos, pos, hub, key, part))
        key, hub, pos, hub_pos, part = (c[order] for c in (key, hub, pos, hub_pos, part))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (hub[1:] != hub[:-1]) | (pos[1:] != pos[:-1]) | (hub_pos[1:] != hub_pos[:-1])
        key, hub, pos, hub_pos, part = (c[fresh] for c in (key, hub, pos, hub_pos, part))
        edge = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
        for n, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if a < b:
                first, count = _pairs(key[a:b], hub[a:b])
                row = (key[a:b][first], hub[a:b][first], count.astype(np.int32), pos[a:b], hub_pos[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([parts[n]], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in row)], schema=_LINKS)


def _pairs(key: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair begins in rows sorted by key, hub, and how many rows it has."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (hub[1:] != hub[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(key)))


def _names(spark, n: int) -> list[int]:
    """A number that hash partitioning sends to each of n partitions."""
    found = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found)]


class PrefixMax:
    """Fenwick tree of (value, index) maxima over prefixes."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, index: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, index)
            at += at & -at

    def get(self, before: int) -> tuple[float, int]:
        """Maximum over places below `before`."""
        out = (float("-inf"), -1)
        while before:
            if self.best[before][0] > out[0]:
                out = self.best[before]
            before -= before & -before
        return out


def blocks(x: np.ndarray, y: np.ndarray, k: int = K) -> tuple[list[int], list[int], list[int]]:
    """Anchors (k words from word x of one text and y of the other match) that follow each other without a break on one diagonal, as blocks: start in both and length."""
    order = np.lexsort((x, y - x))
    x, y = x[order].astype(np.int64), y[order].astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (y[1:] - x[1:] != y[:-1] - x[:-1]) | (x[1:] - x[:-1] > k)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(x)) - 1
    return x[at].tolist(), y[at].tolist(), (x[last] - x[at] + k).tolist()


def chains(x: list[int], y: list[int], size: list[int], k: int = K, cost: float = SKIP_COST) -> list[list[int]]:
    """Chains of blocks, each as indices in order, best first, no block twice.

    A block may follow one whose last anchor starts before it in both texts. Score: the words of each
    block, less `cost` for each word of both texts from one block's last anchor to the next block beyond k.
    """
    ends = [(a + n - k, b + n - k) for a, b, n in zip(x, y, size, strict=True)]
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    closing = sorted(range(len(x)), key=lambda i: ends[i])
    places = sorted({b for _, b in ends})
    tree = PrefixMax(len(places))
    score, back = [0.0] * len(x), [-1] * len(x)
    closed = 0
    for i in order:
        while closed < len(closing) and ends[closing[closed]][0] < x[i]:
            w = closing[closed]
            tree.put(bisect_left(places, ends[w][1]), score[w] + cost * sum(ends[w]), w)
            closed += 1
        value, j = tree.get(bisect_left(places, y[i]))
        gain = value - cost * (x[i] + y[i] - 2 * k) if j >= 0 else 0
        score[i] = size[i] + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    out, used = [], [False] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (-score[i], x[i], y[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def parted(x: list[int], y: list[int], size: list[int], gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Blocks of a chain without what overlaps, parted where more than `gap` words of a text lie between them."""
    out: list[list[tuple[int, int, int]]] = []
    i = j = None
    for p, q, n in zip(x, y, size, strict=True):
        if i is None or p - i > gap or q - j > gap:
            out.append([])
        else:
            over = max(i - p, j - q, 0)
            p, q, n = p + over, q + over, n - over
            if n <= 0:
                continue
        out[-1].append((p, q, n))
        i, j = p + n, q + n
    return out


def _chain(least: int = CHAINED):
    schema = pa.schema([("key", pa.int64()), ("hub", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("size", pa.list_(pa.int32()))])

    def chained(key, hub, x, y):
        x, y, size = blocks(x, y)
        for c in chains(x, y, size):
            for part in parted([x[i] for i in c], [y[i] for i in c], [size[i] for i in c]):
                if sum(n for *_, n in part) >= least:
                    yield key, hub, *map(list, zip(*part, strict=True))

    def go(batches):
        held = []
        for batch in batches:
            for keys, hubs, counts, pos, hub_pos in zip(*(batch.column(c).to_pylist() for c in _LINKS.names[1:]), strict=True):
                counts = np.frombuffer(counts, np.int32)
                held.append((np.repeat(np.frombuffer(keys, np.int64), counts), np.repeat(np.frombuffer(hubs, np.int64), counts), np.frombuffer(pos, np.int32), np.frombuffer(hub_pos, np.int32)))
        if not held:
            return
        key, hub, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        order = np.lexsort((y, x, hub, key))
        key, hub, x, y = (c[order] for c in (key, hub, x, y))
        first, count = _pairs(key, hub)
        if len(first):  # blocks of a chain don't share words, so all have no more words than the links
            step = np.minimum(np.diff(x, append=x[-1:] + K), K)
            step[first[1:] - 1] = K
            enough = np.add.reduceat(step, first) >= least
            first, count = first[enough], count[enough]
        rows = []
        for a, n in zip(first.tolist(), count.tolist(), strict=True):
            rows += chained(int(key[a]), int(hub[a]), x[a : a + n], y[a : a + n])
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return go


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Most words of a and b that match in order."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if not len(a) or not len(b):
        return 0
    at: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    state = whole = (1 << len(b)) - 1  # a bit is 0 where one more word of b matches
    for w in a.tolist():
        if u := state & at.get(w, 0):
            state = (state + u | state - u) & whole
    return len(b) - state.bit_count()


def alike(x: list[int], y: list[int], size: list[int], between: list[int], identity: float = IDENTITY) -> list[tuple[int, int]]:
    """Parts (first and last block) of a chain that are alike as a whole; `between` has the words that match in each gap. What is not alike is parted at the gap with most words amiss."""
    run = [0]
    for n, m in zip(size, [*between, 0], strict=True):
        run.append(run[-1] + n + m)
    amiss = [max(x[i + 1] - x[i] - size[i], y[i + 1] - y[i] - size[i]) - between[i] for i in range(len(between))]
    out, todo = [], [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        count = run[b] - run[a] + size[b]
        whole = max(x[b] + size[b] - x[a], y[b] + size[b] - y[a])
        if count >= identity * whole or a == b:
            out.append((a, b))
        else:
            worst = max(range(a, b), key=lambda i: (amiss[i], -i))
            todo += [(worst + 1, b), (a, worst)]
    return out


#: Words fetched on both sides of a chain at first; a passage that goes on beyond is fetched again with REACH_MORE times as many.
REACH, REACH_MORE = 32, 16
#: Words that may be amiss in a row where a passage is extended.
AMISS = 13


def extend(u: list[int], v: list[int], have: int = 0, size: int = 0) -> tuple[int, int, int]:
    """Words to go on in u and v, past words that were changed, put in or left out, with at most one in five amiss at the place it stops, and the matching ones; what is before has `have` of `size` words right."""
    i = j = hit = 0
    best = (0, 0, 0)
    while True:
        n, run, look = min(len(u) - i, len(v) - j), 0, 16
        while run < n and u[i + run : i + min(run + look, n)] == v[j + run : j + min(run + look, n)]:  # length of the equal run
            run, look = min(run + look, n), look * 4
        while run < n and u[i + run] == v[j + run]:
            run += 1
        i, j, hit = i + run, j + run, hit + run
        if hit > best[2] and (have + hit) * 5 >= 4 * (size + max(i, j)):
            best = (i, j, hit)
        p, q = u[i : i + AMISS], v[j : j + AMISS]
        if not p or not q or max(i, j) - hit > AMISS + (have + hit) // 4:
            return best
        if held := set(p).intersection(q):
            last, end = len(p) - 1, len(q) - 1
            near = min(
                ((max(x, y) * 2 * AMISS + abs(x - y), x, y) for x, w in enumerate(p) if w in held for y, z in enumerate(q) if w == z and (x == y or x == last or y == end or p[x + 1] == q[y + 1])),
                default=None,
            )
        if not held or near is None:
            return best
        i, j = i + near[1], j + near[2]


def passages(x, y, size, gaps_a, gaps_b, more, least: int = LEAST, identity: float = IDENTITY):
    """(start, end, other start, other end, matching words) of a chain's passages; None for a passage that goes on beyond the words in sight.

    gaps_a, gaps_b: words of both texts before the first block, between blocks and after the last; more:
    whether the texts have more words before (a, b) and after (a, b). Ends are extended by what is itself
    alike; where that gives fewer than `least` words, by all that leaves the whole alike.
    """
    between = [matched(a, b) for a, b in zip(gaps_a[1:-1], gaps_b[1:-1], strict=True)]
    for first, last in alike(x, y, size, between, identity):
        count = sum(size[first : last + 1]) + sum(between[first:last])
        s, t, e, u = x[first], y[first], x[last] + size[last], y[last] + size[last]
        left, right = ([g[first][::-1].tolist() for g in (gaps_a, gaps_b)], [g[last + 1].tolist() for g in (gaps_a, gaps_b)])
        for whole in (False, True):
            e_a, e_b, e_hit = extend(*right, count if whole else 0, max(e - s, u - t) if whole else 0)
            have, span = count + e_hit, max(e + e_a - s, u + e_b - t)
            s_a, s_b, s_hit = extend(*left, have if whole else 0, span if whole else 0)
            if not whole or have + s_hit >= least:
                found = (s - s_a, e + e_a, t - s_b, u + e_b, have + s_hit)
                reach = (s_a, s_b, e_a, e_b)
            if found[4] >= least:
                break
        cut = first == 0 and ((reach[0] == len(left[0]) and more[0]) or (reach[1] == len(left[1]) and more[1]))
        cut |= last == len(x) - 1 and ((reach[2] == len(right[0]) and more[2]) or (reach[3] == len(right[1]) and more[3]))
        if cut:
            yield None
        elif found[4] >= least and found[4] >= identity * max(found[1] - found[0], found[3] - found[2]):
            yield found


_SIDE = pa.schema([("chain", pa.int64()), ("side", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("cuts", pa.list_(pa.int32())), ("left", pa.int32()), ("right", pa.int32()), ("more_left", pa.bool_()), ("more_right", pa.bool_()), ("words", pa.binary())])
_SIDE_SQL = "chain long, side int, key long, doc_id long, cuts array<int>, left int, right int, more_left boolean, more_right boolean, words binary"


def _cut(reach: int, alone: int):
    """Words (32 bits of each one's hash) around and between the blocks of each chain that asks; texts come with their requests. alone: how far for chains of negative number, of which what is `sure` has seen as much."""

    def go(batches):
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                raw, rows = words.hash.astype(np.uint32).tobytes(), []
                for r, (key, doc_id, asks) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("asks").to_pylist(), strict=True)):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    for q in asks:
                        cuts = [c for p, n in zip(q["at"], q["size"], strict=True) for c in (p, p + n)]
                        if cuts[-1] > b - a:
                            continue  # another text with the same key
                        far = reach if q["chain"] >= 0 else alone
                        low, high = max(0, cuts[0] - far), min(b - a, cuts[-1] + far)
                        edge = [low, *cuts, high]
                        own = b"".join([raw[4 * (a + edge[i]) : 4 * (a + edge[i + 1])] for i in range(0, len(edge), 2)])
                        rows.append((q["chain"], q["side"], key, doc_id, cuts, cuts[0] - low, high - cuts[-1], low > 0, high < b - a, own))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SIDE, strict=True)], schema=_SIDE)

    return go


_PASSAGE_NAMES = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "matched_words", "identity"]
_PASSAGES = ", ".join(f"{c} long" for c in _PASSAGE_NAMES[:-1]) + ", identity double, cut boolean, key long, hub long"


def _gaps(side: dict) -> list[np.ndarray]:
    words, cuts = np.frombuffer(side["words"], np.uint32), side["cuts"]
    out, at = [], 0
    for size in (side["left"], *(b - a for a, b in zip(cuts[1:-1:2], cuts[2::2], strict=True)), side["right"]):
        out.append(words[at : at + size])
        at += size
    return out


def _align(least: int, identity: float):
    """Both sides of a chain come one after the other."""
    kinds = (pa.int64(),) * 7 + (pa.float64(), pa.bool_(), pa.int64(), pa.int64())

    def hopeless(a: dict, b: dict) -> bool:
        """Whether too few words can match, and none up to the edge of sight. A word that stands once on a side counts however often it stands on the other."""
        if max(a["left"], a["right"], b["left"], b["right"]) > REACH:
            return False
        u, v, count = a["words"], b["words"], 0
        cuts, other = a["cuts"], b["cuts"]
        for p, q, r, t in zip(cuts[1::2], cuts[2::2], other[1::2], other[2::2], strict=False):
            count += min(q - p, t - r)
        for p, q in zip(cuts[::2], cuts[1::2], strict=True):
            count += q - p
        for side in ("left", "right"):
            m, n = a[side], b[side]
            if m and n:
                p, q = (np.frombuffer(w, np.uint32, k, 0 if side == "left" else len(w) - 4 * k).tolist() for w, k in ((u, m), (v, n)))
                held = set(q)
                both = sum(w in held for w in p)
                if 5 * both >= 4 * min(m, n):
                    return False
                count += min(both, n)
            elif not m and a[f"more_{side}"] or not n and b[f"more_{side}"]:
                return False
        return count < least

    def one(a: dict, b: dict):
        if hopeless(a, b):
            return []
        x, y, size = a["cuts"][::2], b["cuts"][::2], [q - p for p, q in zip(a["cuts"][::2], a["cuts"][1::2], strict=True)]
        found = list(passages(x, y, size, _gaps(a), _gaps(b), (a["more_left"], b["more_left"], a["more_right"], b["more_right"]), least, identity))
        if None in found:
            return [(None, None, a["chain"], 0, 0, 0, 0, 0.0, True, None, None)]
        return [(a["doc_id"], b["doc_id"], s, e, t, u, n, n / max(e - s, u - t), False, a["key"], b["key"]) for s, e, t, u, n in found]

    def go(batches):
        chain, open_ = None, []
        for batch in batches:
            rows = []
            for side in batch.to_pylist():
                if side["chain"] != chain:
                    chain, open_ = side["chain"], []
                if not side["side"]:
                    open_.append(side)
                else:
                    for a in open_:
                        rows += one(a, side)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_PASSAGE_NAMES, "cut", "key", "hub"])

    return go


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, identity: float = IDENTITY, hot: int = HOT) -> DataFrame:
    """One row for each passage that a document shares with another: both ids, word places in both, matched words, identity. hot: see HOT; it decides how common seeds are handled, not what is found."""
    if least < K + WINDOW:
        raise ValueError(f"passages of fewer than {K + WINDOW} words can lie between seeds")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    base = base.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    names = _names(spark, width(spark))
    cells = hot_cells(base, hot)
    cells = None if cells is None else spark.sparkContext.broadcast(cells)
    posted = base.select("key", "text").mapInArrow(_post(names, least, cells), _POST_SQL).repartition(width(spark), "part")
    met = written(posted.mapInArrow(_meet(names), _MET_SQL), "met")
    packed = met.filter("seeds IS NULL").drop("seeds")
    common = met.filter("seeds IS NOT NULL").mapInArrow(_common, "seed long, key long, pos int")
    if cells is not None:
        rows = written(base.select("key", "text").mapInArrow(_post_hot(least, cells), _HOT_ROW), "hot-seeds")
        packed = packed.union(hot_links(rows).mapInArrow(_pack_hot(names), _LINKS_SQL))
        common = common.union(hot_common(rows))
    out = _passages(base, packed, CHAINED, least, identity)
    if not common.isEmpty():
        found = _rest(base, common, out, names, least, identity)
        more = _passages(base, found.filter("part >= 0"), K, least, identity, found.filter("part < 0")).dropDuplicates()
        same = [F.col(f"m.{c}") == F.col(f"o.{c}") for c in ("key", "hub")]
        sides = (("start_word", "end_word"), ("other_start", "other_end"))
        over = [F.col(f"{x}.{s}") < F.col(f"{y}.{e}") for s, e in sides for x, y in ("mo", "om")]
        within = [c for s, e in sides for c in (F.col(f"o.{s}") <= F.col(f"m.{s}"), F.col(f"m.{e}") <= F.col(f"o.{e}"))]
        longer = F.col("m.end_word") - F.col("m.start_word") + F.col("m.other_end") - F.col("m.other_start") < F.col("o.end_word") - F.col("o.start_word") + F.col("o.other_end") - F.col("o.other_start")
        more = written(more, "more")
        more = more.alias("m").join(more.alias("o"), [*same, *within, longer], "left_anti")  # of a chain and of one seed of it
        out = out.union(more.alias("m").join(out.alias("o"), [*same, *over], "left_anti"))
    return out.drop("key", "hub")


_CHAINS = "key long, hub long, x array<int>, y array<int>, size array<int>"


def _alone(batches):
    """Each link as a chain of its own, so that no other block stands in the way of what its ends are extended to."""
    for batch in batches:
        for keys, hubs, pos, hub_pos in zip(*(batch.column(c).to_pylist() for c in ("keys", "hubs", "pos", "hub_pos")), strict=True):
            x, y = (np.frombuffer(c, np.int32)[:, None].tolist() for c in (pos, hub_pos))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(hubs, np.int64)), *(pa.array(c, pa.list_(pa.int32())) for c in (x, y, [[K]] * len(x)))], ["key", "hub", "x", "y", "size"])


def _passages(base: DataFrame, packed: DataFrame, chained_words: int, least: int, identity: float, alone: DataFrame | None = None) -> DataFrame:
    """Passages of the pairs that these links name; alone: links that aren't chained with others."""
    chained = packed.repartition(width(base.sparkSession), "part").mapInArrow(_chain(chained_words), _CHAINS)
    number = F.monotonically_increasing_id()
    chained = chained.withColumn("chain", number)
    if alone is not None:
        chained = chained.union(alone.mapInArrow(_alone, _CHAINS).withColumn("chain", -1 - number))
    chained = written(chained, "chains")
    out, reach = None, REACH
    while True:
        aligned = _aligned(base, chained, least, identity, reach, max(reach, _wide(least, identity)))
        done = aligned.filter("NOT cut").drop("cut")
        out = done if out is None else out.union(done)
        again = aligned.filter("cut").select(F.col("start_word").alias("chain"))
        if again.isEmpty():
            return out
        chained = written(chained.join(again, "chain", "left_semi"), "chains")
        reach *= REACH_MORE


#: Share of the words in sight that must match where a passage goes on beyond them.
OPEN = 0.5
#: Holders of common seeds. label, at: the smallest hub that a passage over the seed leads to, and where; own key and place without one. before: the common seed up to WINDOW words before and how far, 0 without one.
_PLACE = [("seed", np.int64), ("key", np.int64), ("pos", np.int64), ("label", np.int64), ("at", np.int64), ("before", np.uint64)]


def _holder(wide: int) -> np.dtype:
    """Holders with what stands around them. left, right: words in sight; digest: of those on the left, then of those on the right; words: 16 bits of each of `wide` words on the left, nearest first, then on the right, above 1, and 0 where the text ends."""
    return np.dtype([*_PLACE, ("left", np.int64), ("right", np.int64), ("digest", (np.uint64, 2 * DIGEST // 64)), ("words", np.uint16, (2 * wide,))])


def _digest(hashes: np.ndarray, first: np.ndarray, most: int, end: np.ndarray) -> np.ndarray:
    """Parity, at each of DIGEST places, of the words from `first` to `end` that fall there; a word that comes again counts as another."""
    at = first[:, None] + np.arange(most)
    inside = at < end[:, None]
    word = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], U64(0))
    word.sort(axis=1)
    new = np.ones(word.shape, bool)
    new[:, 1:] = word[:, 1:] != word[:, :-1]
    place = np.arange(most)
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    bit = mix(word + nth.astype(U64) * U64(0x9E3779B97F4A7C15)) & U64(DIGEST - 1)
    row, col = np.nonzero(word)  # the hash 0 stands for no word
    flat_ = np.bincount(row * DIGEST + bit[row, col].astype(np.int64), minlength=len(first) * DIGEST) & 1
    return np.packbits(flat_.astype(np.uint8).reshape(len(first), DIGEST), axis=1).view(U64)


def placed(seed: np.ndarray, pos: np.ndarray, row: np.ndarray, keys: np.ndarray, spans: list) -> np.ndarray:
    """Places of the common seeds at `pos` of texts, in order of row (a text's number in keys) and pos; spans: for each text (hub, start, end, other_start) of its passages."""
    out = np.zeros(len(pos), _PLACE)
    out["seed"], out["key"], out["pos"], out["label"], out["at"] = seed, keys[row], pos, keys[row], pos
    gap = np.diff(pos)
    near = (gap <= WINDOW) & (row[1:] == row[:-1])
    out["before"][1:] = np.where(near, mix(seed[:-1].view(U64) + gap.astype(U64)) | U64(1), U64(0))
    edge = np.searchsorted(row, np.arange(len(keys) + 1)).tolist()
    for r, found in enumerate(spans):
        if found:
            own = out[edge[r] : edge[r + 1]]
            for hub, start, end, other in sorted(found, reverse=True):
                inside = (own["pos"] >= start) & (own["pos"] + K <= end)
                own["label"][inside], own["at"][inside] = hub, other + own["pos"][inside] - start
    return out


def seen(places: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, sight: int, wide: int) -> np.ndarray:
    """Holders at these places of texts whose words stand from first to last in hashes."""
    at = first + places["pos"]
    low, high = np.maximum(at - sight, first), np.minimum(at + K + sight, last)
    out = np.zeros(len(at), _holder(wide))
    for name, _ in _PLACE:
        out[name] = places[name]
    out["left"], out["right"] = at - low, high - at - K
    out["digest"] = np.concatenate([_digest(hashes, low, sight, at), _digest(hashes, at + K, sight, high)], axis=1)
    if wide:
        word = np.concatenate([at[:, None] - 1 - np.arange(wide), at[:, None] + K + np.arange(wide)], axis=1)
        short = np.maximum(hashes[np.clip(word, 0, len(hashes) - 1)] >> U64(48), U64(2)).astype(np.uint16)
        out["words"] = np.where((word >= first[:, None]) & (word < last[:, None]), short, 0)
    return out


def holders(hashes: np.ndarray, seed: np.ndarray, pos: np.ndarray, key: int, spans: list, sight: int, wide: int = 0) -> np.ndarray:
    """Holders of the common seeds at `pos` (ascending) of a text."""
    none = np.zeros(len(pos), np.int64)
    return seen(placed(seed, pos, none, np.array([key]), [spans]), hashes, none, none + len(hashes), sight, wide)


def one_class(rows: np.ndarray) -> bool:
    """Whether holders of one seed, in order of `classes`, have no two to be held against each other there."""
    return bool((rows["label"] == rows["label"][0]).all() and np.ptp(rows["at"]) <= DRIFT or rows["before"][0] and rows["before"][0] == rows["before"][-1])


def classes(rows: np.ndarray) -> np.ndarray:
    """Holders of one seed in order of the seed before and of label; hubs that hold the seed themselves hand their own label on."""
    rows = rows[np.lexsort((rows["pos"], rows["key"]))]
    while True:
        to = np.minimum(np.searchsorted(rows["key"], rows["label"]), len(rows) - 1)
        drift = rows["at"] - rows["pos"][to]
        go = (rows["key"][to] == rows["label"]) & (rows["label"] != rows["key"]) & (np.abs(drift) <= DRIFT) & (rows["label"][to] != rows["label"])
        if not go.any():
            return rows[np.lexsort((rows["key"], rows["at"], rows["label"], rows["before"]))]
        rows["label"][go], rows["at"][go] = rows["label"][to[go]], rows["at"][to[go]] + drift[go]


def near_pairs(a: np.ndarray, b: np.ndarray | None, half: int):
    """Places in a and b (None: a itself, each pair once) of holders of different classes that can share `half` words on one side. Those with the same seed before meet there."""
    whole, planes = b is None, DIGEST // 64
    b = a if whole else b
    step = 64  # arrays that fit a core's cache
    for i in range(0, len(a), step):
        x = a[i : i + step]
        j = i if whole else 0
        if x["before"][0] and x["before"][0] == x["before"][-1]:
            j = max(j, int(np.searchsorted(b["before"], x["before"][0], "right")))
        elif whole and x["before"][0] == b["before"][-1] and x["label"][0] == x["label"][-1] and x["at"].max() - x["at"].min() <= DRIFT:
            j = i + int(np.searchsorted(b["label"][i:], x["label"][0], "right")) if np.ptp(b["at"][i:][b["label"][i:] == x["label"][0]]) <= DRIFT else j
        y = b[j:]
        if not len(y):
            continue
        near = np.zeros((len(x), len(y)), bool)
        for side, first in (("left", 0), ("right", planes)):
            own, other = (np.flatnonzero(z[side] >= half) for z in (x, y))
            if not len(own) or not len(other):
                continue
            far = np.zeros((len(own), len(other)), np.int16)
            p, q = x["digest"][own], y["digest"][other]
            for n in range(first, first + planes):
                far += np.bitwise_count(p[:, n, None] ^ np.ascontiguousarray(q[:, n]))
            far -= (x[side][own] - 2 * half).astype(np.int16)[:, None]
            near[np.ix_(own, other)] |= far <= y[side][other].astype(np.int16)
        if whole and j - i < len(x):
            near &= np.arange(len(x))[:, None] + i < np.arange(len(y))[None, :] + j
        u, v = np.nonzero(near)
        of = lambda c: (x[c][u], y[c][v])  # noqa: B023, E731
        (p, q), (s, t), (e, f) = of("label"), of("at"), of("before")
        good = ((p != q) | (np.abs(s - t) > DRIFT)) & ((e != f) | (e == 0)) & np.not_equal(*of("key"))
        yield u[good] + i, v[good] + j


def counted(words: np.ndarray) -> np.ndarray:
    """Words of each row so that one that comes again counts as another; 0 stays no word."""
    order = np.argsort(words, axis=1, kind="stable")
    word = np.take_along_axis(words, order, 1)
    new = np.ones(word.shape, bool)
    new[:, 1:] = word[:, 1:] != word[:, :-1]
    place = np.arange(words.shape[1])
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    out = np.empty_like(words)
    np.put_along_axis(out, order, np.maximum(word + (nth * 40503).astype(np.uint16), 1), 1)
    return np.where(words > 0, out, np.uint16(0))


def in_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No fewer than the words that each row of a and of b, both `counted`, have in common."""
    both = np.concatenate([a, b], axis=1)
    both.sort(axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(axis=1)


def parities(words: np.ndarray) -> np.ndarray:
    """Parity, at each of PARITIES places, of the words of each row, `counted`, that fall there: rows differ in as many words at least as these bits."""
    row, col = np.nonzero(words)
    place = mix(words[row, col]) & U64(PARITIES - 1)
    odd = np.bincount(row * PARITIES + place.astype(np.int64), minlength=len(words) * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(words), PARITIES), axis=1).view(U64)


def class_of(rows: np.ndarray) -> np.ndarray:
    """A number for each class of holders of one seed: those with one label whose places lie within DRIFT."""
    order = np.lexsort((rows["at"], rows["label"]))
    label, at = rows["label"][order], rows["at"][order]
    place, new = np.arange(len(rows)), np.ones(len(rows), bool)
    new[1:] = label[1:] != label[:-1]
    while True:
        begin = np.maximum.accumulate(np.where(new, place, 0))
        over = np.flatnonzero(at - at[begin] > DRIFT)
        if not len(over):
            break
        new[over[np.unique(begin[over], return_index=True)[1]]] = True
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def around_seed(words: np.ndarray) -> tuple[list[int], list[int]]:
    """Words of a holder on the left and on the right, nearest first, as far as the text goes."""
    return tuple(side[: int((side > 0).sum())].tolist() for side in np.split(words, 2))


def in_place(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Most words of a seed and of `reach` words around it that match at the same distance from the seed, for each row of a and of b."""
    wide = a.shape[1] // 2
    left, right = (np.zeros((len(a), reach + 1), np.int16) for _ in range(2))
    for out, at in ((left, 0), (right, wide)):
        p = a[:, at : at + reach]
        np.cumsum((p == b[:, at : at + reach]) & (p > 0), axis=1, dtype=np.int16, out=out[:, 1:])
    return K + (left[:, ::-1] + right).max(axis=1, initial=0)


def sure(a: tuple, b: tuple, least: int, identity: float) -> bool:
    """Whether the words around a seed, extended as `passages` does, hold a passage even if two of the matching words should differ beyond their 16 bits."""
    for whole in (False, True):
        e_a, e_b, right = extend(a[1], b[1], *(K, K) if whole else ())
        have, span = K + right, K + max(e_a, e_b)
        s_a, s_b, left = extend(a[0], b[0], *(have, span) if whole else ())
        if have + left >= least:
            return have + left - 2 >= max(least, identity * max(e_a + K + s_a, e_b + K + s_b))
    return False


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most words that the first 0, 1, 2, ... of each row of b match in order in the same row of a, by bits of 64 words at once."""
    n, size = a.shape
    limbs = -(-size // 64)
    state = [np.full(n, 0xFFFFFFFFFFFFFFFF, U64) for _ in range(limbs)]
    out = np.zeros((size + 1, n), np.int16)
    equal = np.zeros((n, 64 * limbs), bool)
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(np.maximum(b, 1).T)  # no word of one is none of the other
    for j in range(size):
        np.equal(a, b[j][:, None], out=equal[:, :size])
        bits = np.packbits(equal.reshape(-1), bitorder="little").view("<u8").reshape(n, limbs)
        carry = np.zeros(n, U64)
        for i, v in enumerate(state):
            u = v & bits[:, i]
            plain = v + u
            whole = plain + carry
            carry = ((plain < u) | (whole < carry)).astype(U64)
            state[i] = whole | (v & ~u)
            out[j + 1] += np.bitwise_count(~state[i])
    return out.T


def _room(left: tuple, right: tuple, least: int, identity: float) -> tuple[np.ndarray, np.ndarray]:
    """What `possible` asks of the words of the second of each pair of holders, whatever part of the first they match: that enough of them do, and that a passage can go on beyond."""
    wide = left[0].shape[1]
    words = np.arange(2 * wide + 1) + K
    need = np.maximum(least, np.ceil(identity * words - 1e-9)).astype(np.int16) - K
    far = np.ceil(OPEN * words).astype(np.int16)[wide:] - K
    a, b = in_order(*left), in_order(*right)
    enough, beyond = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for p in range(wide + 1):
        enough |= (a[:, p, None] + b >= need[p : p + wide + 1]).any(axis=1)
    for near, over, (x, y) in ((a, b, right), (b, a, left)):
        beyond |= ((x[:, -1] > 0) | (y[:, -1] > 0)) & (near + over[:, -1:] >= far).any(axis=1)
    return enough, beyond


def possible(left: tuple, right: tuple, least: int, identity: float) -> np.ndarray:
    """Whether a passage over the seed of each pair of holders can be: some words on both sides, together with the seed, have `least` matches in order and are alike, in either text; or at least OPEN of them match up to where sight ends and a text goes on. left, right: words of both, nearest first."""
    enough, out = _room(left, right, least, identity)
    again = np.flatnonzero(enough & ~out)
    if len(again):
        enough, beyond = _room(*((b[again], a[again]) for a, b in (left, right)), least, identity)
        out[again] = enough | beyond
    return out


def _places(base: DataFrame, common: DataFrame, out: DataFrame, names: list[int]) -> DataFrame:
    """key, place: holders of common seeds (seed, key, pos) that passages found so far don't join, with their classes."""
    asks = common.groupBy("key").agg(F.collect_list(F.struct("seed", "pos")).alias("asks"))
    spans = out.groupBy("key").agg(F.collect_list(F.struct("hub", "start_word", "end_word", "other_start")).alias("spans"))

    def deal(batches):
        """By partition of the seed, packed."""
        for batch in batches:
            held = batch.column("asks")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(held.offsets)))
            seed, pos = (np.asarray(held.flatten().field(c)).astype(np.int64) for c in ("seed", "pos"))
            order = np.lexsort((seed, pos, row))
            seed, pos, row = seed[order], pos[order], row[order]
            fresh = np.ones(len(row), bool)  # a text that stands in the table again is one holder
            fresh[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1]) | (seed[1:] != seed[:-1])
            spans_ = [[tuple(s.values()) for s in found or []] for found in batch.column("spans").to_pylist()]
            places = placed(seed[fresh], pos[fresh], row[fresh], np.asarray(batch.column("key")), spans_)
            part = (mix(places["seed"].view(U64)) % U64(len(names))).astype(np.int64)
            order = np.lexsort((places["seed"], part))
            edge = np.searchsorted(part[order], np.arange(len(names) + 1)).tolist()
            rows = [(names[n], places[order[a:b]].tobytes()) for n, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "places"])

    def differ(batches):
        held = [np.frombuffer(x, _PLACE) for batch in batches for x in batch.column("places").to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.argsort(rows["seed"], kind="stable")]
        begin = np.flatnonzero(np.concatenate([[True], rows["seed"][1:] != rows["seed"][:-1]]))
        ends = np.append(begin[1:], len(rows))
        least, most = ({c: f.reduceat(rows[c], begin) for c in ("label", "at", "before")} for f in (np.minimum, np.maximum))
        joined = (least["label"] == most["label"]) & (most["at"] - least["at"] <= DRIFT) | (least["before"] == most["before"]) & (most["before"] > 0)
        for a, b in zip(begin[~joined].tolist(), ends[~joined].tolist(), strict=True):
            own = classes(rows[a:b])
            if not one_class(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own["key"])), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "place"])

    dealt = asks.join(spans, "key", "left").mapInArrow(deal, "part int, places binary").repartition(width(base.sparkSession), "part")
    return written(dealt.mapInArrow(differ, "key long, place binary"), "places")


def _blocks(base: DataFrame, places: DataFrame, sight: int, wide: int) -> DataFrame:
    """seed, nth, a, b: blocks of holders to be held against each other, with what stands around them; b is null for a block and itself."""
    spark = base.sparkSession
    asks = places.groupBy("key").agg(F.collect_list("place").alias("asks"))
    sent = spark.sparkContext.broadcast(asked_table(places.select("key")))
    kind = _holder(wide)

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(sent.value, np.asarray(batch.column("key")))))

    def around(batches):
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                asked_ = batch.column("asks").to_pylist()
                own = np.frombuffer(b"".join(x for a in asked_ for x in a), _PLACE)
                row = np.repeat(np.arange(len(asked_)), [len(a) for a in asked_])
                good = own["pos"] + K <= words.count[row]  # else of another text with the same key
                own, row = own[good], row[good]
                for i in range(0, len(own), 4096):
                    of = row[i : i + 4096]
                    rows = seen(own[i : i + 4096], words.hash, words.first[of], words.first[of + 1], sight, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["seed"])), pa.array([x.tobytes() for x in rows], pa.binary())], ["seed", "holder"])

    def deal(batches):
        """Rows of a seed come together."""
        seed, held = None, []

        def cut():
            rows = classes(np.frombuffer(b"".join(held), kind).copy())
            if one_class(rows):
                return
            blocks_ = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            for i, x in enumerate(blocks_):
                for j in range(i, len(blocks_)):
                    y = blocks_[j]
                    yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), pa.array([i * len(blocks_) + j], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([None if i == j else y.tobytes()], pa.binary())], ["seed", "nth", "a", "b"])

        for batch in batches:
            for s, holder in zip(batch.column("seed").to_pylist(), batch.column("holder").to_pylist(), strict=True):
                if s != seed and held:
                    yield from cut()
                    held = []
                seed = s
                held.append(holder)
        if held:
            yield from cut()

    texts = base.select("key", "text").mapInArrow(asked, "key long, text string").dropDuplicates(["key"])
    held = texts.join(asks, "key").mapInArrow(around, "seed long, holder binary").repartition(width(spark), "seed").sortWithinPartitions("seed")
    return held.mapInArrow(deal, "seed long, nth int, a binary, b binary").repartition(width(spark), "seed", "nth")


def _wide(least: int, identity: float) -> int:
    """Words on each side of a seed by which pairs of holders are held against each other."""
    return -(-2 * int(least / identity + 1e-9) // 64) * 64


def _rest(base: DataFrame, common: DataFrame, out: DataFrame, names: list[int], least: int, identity: float) -> DataFrame:
    """Links between holders of common seeds (seed, key, pos) that passages found so far don't join, and that neither digests nor the words on both sides rule out; those of part -1 surely hold a passage each, and stand for all pairs of the classes that they join."""
    half, longest = (least - K) // 2, int(least / identity + 1e-9)
    sight, wide = half + longest - least, _wide(least, identity)

    def pairs(batches, wide):
        kind = _holder(wide)
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x = np.frombuffer(x, kind)
                y = None if y is None else np.frombuffer(y, kind)
                yield x, x if y is None else y, near_pairs(x, y, half)

    def near(batches):
        """Places of holders that digests leave with another."""
        for x, y, found in pairs(batches, 0):
            left = np.zeros(len(x), bool), np.zeros(len(y), bool)
            for u, v in found:
                left[0][u] = left[1][v] = True
            rows = np.concatenate([z[[c for c, _ in _PLACE]][m].astype(_PLACE) for z, m in zip((x, y), left, strict=True)])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["key"])), pa.array([z.tobytes() for z in rows], pa.binary())], ["key", "place"])

    sides, reach = (slice(0, wide), slice(wide, 2 * wide)), longest - K

    def joined(x, y, found):
        """Of found, by the words in sight that both have in common: pairs that surely hold a passage, each of which joins two classes, and the others of classes that are not joined."""
        both = (x,) if y is x else (x, y)
        once = [[counted(z["words"][:, s]) for s in sides] for z in both]
        bits = [np.concatenate([parities(c) for c in z], axis=1) for z in once]
        size = [sum((c > 0).sum(axis=1) for c in z) for z in once]
        of = class_of(np.concatenate([z[["label", "at"]] for z in both]))
        of, root, around = (of[: len(x)], of[-len(y) :]), np.arange(len(of)), ({}, {})
        sure_, open_ = [], []
        for us, vs in found:
            for i in range(0, len(us), 1024):
                u, v = us[i : i + 1024], vs[i : i + 1024]
                may = root[of[0][u]] != root[of[1][v]]
                u, v = u[may], v[may]
                common = K + (size[0][u] + size[-1][v] - np.bitwise_count(bits[0][u] ^ bits[-1][v]).sum(axis=1, dtype=np.int64)) // 2
                close = np.flatnonzero((common >= least) & (common < least + 6))  # as many words may be one bit
                common[close] = K + sum(in_both(a[u[close]], b[v[close]]) for a, b in zip(once[0], once[-1], strict=True))
                u, v = u[common >= least], v[common >= least]
                may = in_place(x["words"][u], y["words"][v], reach) >= least
                open_ += zip(u[~may].tolist(), v[~may].tolist(), strict=True)
                for p, q in zip(u[may].tolist(), v[may].tolist(), strict=True):
                    s, t = root[of[0][p]], root[of[1][q]]
                    if s == t:
                        continue
                    for z, w, have in ((x, p, around[0]), (y, q, around[1])):
                        if w not in have:
                            have[w] = around_seed(z["words"][w])
                    if sure(around[0][p], around[1][q], least, identity):
                        root[root == t] = s
                        sure_.append((p, q))
                    else:
                        open_.append((p, q))
        sure_, open_ = (np.array(c, np.int64).reshape(-1, 2).T for c in (sure_, open_))
        return sure_, open_[:, root[of[0][open_[0]]] != root[of[1][open_[1]]]]

    def linked(x, y, u, v):
        """key, hub, pos, hub_pos of pairs of holders."""
        p, q = ([z[c][w] for c in ("key", "pos")] for z, w in ((x, u), (y, v)))
        swap = p[0] < q[0]
        (k, at), (hub, hub_at) = ([np.where(swap, t, s) for s, t in zip(e, f, strict=True)] for e, f in ((p, q), (q, p)))
        return k, hub, at.astype(np.int32), hub_at.astype(np.int32)

    def roomy(held):
        """Links that leave room for a passage by the words around both seeds, which stand behind them."""
        *link, p, q = (np.concatenate(c) for c in zip(*held, strict=True))
        good = np.concatenate([possible(*((p[i : i + 512, s], q[i : i + 512, s]) for s in sides), least, identity) for i in range(0, len(p), 512)])
        return tuple(c[good] for c in link)

    def meet(batches):
        alone, links_, count, held, open_ = [], [], 0, [], 0  # pairs of many seeds go through `possible` together
        for x, y, found in pairs(batches, wide):
            certain, rest = joined(x, y, found)
            alone.append(linked(x, y, *certain))
            for i in range(0, rest.shape[1], 4096):
                u, v = rest[:, i : i + 4096]
                held.append((*linked(x, y, u, v), x["words"][u], y["words"][v]))
                open_ += len(u)
                if open_ >= 4096:
                    links_.append(roomy(held))
                    count += len(links_[-1][0])
                    held, open_ = [], 0
            if count >= 1 << 20:
                yield from _packets(*(np.concatenate(c) for c in zip(*links_, strict=True)), names)
                links_, count = [], 0
        if held:
            links_.append(roomy(held))
        if links_:
            yield from _packets(*(np.concatenate(c) for c in zip(*links_, strict=True)), names)
        if alone:
            key, hub, pos, hub_pos = (np.concatenate(c) for c in zip(*alone, strict=True))
            for i in range(0, len(key), 1 << 14):
                row = {"keys": key, "hubs": hub, "pos": pos, "hub_pos": hub_pos}
                yield pa.RecordBatch.from_arrays([pa.array([-1 if f.name == "part" else row[f.name][i : i + (1 << 14)].tobytes() if f.name in row else b""], f.type) for f in _LINKS], schema=_LINKS)

    places = _places(base, common, out, names)
    left = written(_blocks(base, places, sight, 0).mapInArrow(near, "key long, place binary").distinct(), "near")
    return written(_blocks(base, left, sight, wide).mapInArrow(meet, _LINKS_SQL), "links")


def _aligned(base: DataFrame, chained: DataFrame, least: int, identity: float, reach: int, alone: int) -> DataFrame:
    """Passages of chains, `reach` words on both sides in sight; those that go on to the edge of sight are marked cut, with the chain for start_word."""
    spark = base.sparkSession
    ask = lambda side, key, at: chained.select(F.col(key).alias("key"), F.struct(F.col("chain"), F.lit(side).alias("side"), F.col(at).alias("at"), "size").alias("ask"))
    # a hub that very many chains name is asked in parts, each of which fetches its text once
    both = ask(0, "key", "x").union(ask(1, "hub", "y"))
    asks = both.groupBy("key", F.pmod(F.col("ask.chain"), F.lit(width(spark))).alias("part")).agg(F.collect_list("ask").alias("asks"))
    sent = spark.sparkContext.broadcast(asked_table(both.select("key")))

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(sent.value, np.asarray(batch.column("key")))))

    named = base.mapInArrow(asked, "key long, doc_id long, text string").withColumn("other", F.xxhash64(F.lit(1), "text")).dropDuplicates(["key", "doc_id", "other"])
    sides = named.join(asks, "key").select("key", "doc_id", "text", "asks").mapInArrow(_cut(reach, alone), _SIDE_SQL)
    met = sides.repartition(width(spark), "chain").sortWithinPartitions("chain", "side")
    return written(met.mapInArrow(_align(least, identity), _PASSAGES), "passages")


@query("op2_repeated_passages")
def op2_repeated_passages(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir))
