import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import odd_rows

from shardwell.llm import content_sort, line_dedup
from shardwell.llm.perfect_hash import PerfectHash, Shard

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_content_sort_against_grouping(odd, monkeypatch):
    rows = [(r[0], SPACE.sub(" ", r[1] or "")) for r in odd_rows()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        want.append((str(i), str(min(ids) if ids else None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    for share, least in ((4, 1000), (10**6, 1)):  # the second makes every group of two a crowded one, which is salted
        monkeypatch.setattr(content_sort, "SHARE", share)
        monkeypatch.setattr(content_sort, "LEAST_CROWD", least)
        got = content_sort.content_sort(odd).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_content_sort_keeps_columns_and_takes_empty_tables(odd, none):
    assert content_sort.keep_one(odd).columns == odd.columns and content_sort.keep_one(odd).count() == len({SPACE.sub(" ", r[1] or "") for r in odd_rows()})
    assert content_sort.content_sort(none).collect() == []


def test_perfect_hash_numbers_its_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        table = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
        other = rng.integers(0, 2**64, 500, dtype=np.uint64)
        shard = Shard.load(Shard.build(keys, keys ^ np.uint64(5), np.arange(len(keys)), np.arange(len(keys)) * 2).dump())
        found, count, keeper = shard.probe(keys, keys ^ np.uint64(5))
        assert found.all() and count.tolist() == list(range(len(keys))) and keeper.tolist() == [2 * i for i in range(len(keys))]
        assert not shard.probe(other, other)[0].any() and not shard.probe(keys, keys)[0].any()


def brute_lines(rows, least_chars=20, least_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    none = -(2**63)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(none if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == (none if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    shared = ["a line that many documents hold", "  A Line That MANY documents hold\t", "ünder twenty points é", "zwänzig Zeichen sind es hier", "short", ""]
    rows = [(i, "\n".join(rng.choice([*shared, f"own line number {i} of its own {k}"]) for k in range(rng.randint(0, 7))) if i % 9 else None) for i in range(60)]
    rows += [(r[0], r[1]) for r in odd_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.line_dedup(df).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    got = line_dedup.line_dedup(odd).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines([(r[0], r[1]) for r in odd_rows()])
    assert line_dedup.line_dedup(none).collect() == []
    # many shards, packets of a few lines, and shards dealt over several copies of their blob
    got = line_dedup.line_dedup(df, shard_keys=5, packet_lines=7, asked_lines=3).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(rows)


def test_lines_that_share_a_first_hash_are_told_apart():
    h1, h2 = np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64)
    shard = Shard.load(Shard.build(h1, h2, np.array([3, 4, 5]), np.array([30, 40, 50])).dump())
    found, count, keeper = shard.probe(h1, h2)
    assert found.all() and count.tolist() == [3, 4, 5] and keeper.tolist() == [30, 40, 50]


def test_line_keys_against_python():
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "B", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "😀", "\u00a0", "\x1c"], k=rng.randint(0, 40))) for _ in range(400)] + ["", None, "\n", "\n\n", " \n "]
    row, place, left, right, size, low = line_dedup.line_keys(pa.array(texts))
    want = [(i, n, line.strip(" \t\n\x0b\f\r")) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    got = [(int(i), int(n), bytes(low[a:b]).decode(), int(s)) for i, n, a, b, s in zip(row, place, left, right, size, strict=True)]
    assert got == [(i, n, k.replace("B", "b"), len(k)) for i, n, k in want]
