import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import odd_rows, prose
from pyspark.sql import functions as F

from shardwell.llm import jaccard_join, simhash, substring_dedup
from shardwell.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def test_fingerprints_follow_the_votes():
    texts = ["the cat sat on the mat", "", None, "the cat sat on the mat", "The cat SAT on the mat", "a b c d e f g"]
    p = simhash.fingerprints(pa.array(texts), 256)
    assert p.shape == (6, 32) and (p[0] == p[3]).all() and (p[0] == p[4]).all() and not p[1].any() and not p[2].any() and (p[0] != p[5]).any()
    whole = simhash.fingerprints(pa.array([prose(random.Random(n), 300) for n in range(700)]), 64)
    assert (whole[650] == simhash.fingerprints(pa.array([prose(random.Random(650), 300)]), 64)[0]).all()


def test_next_and_edited_texts(odd, none):
    rows = [(r[0], r[1] or "") for r in odd_rows()]
    for parts in (odd, odd.coalesce(1)):
        got = simhash.with_next(parts).collect()
        assert len(got) == len(rows)
        single = [i for i, _ in rows if [x for x, _ in rows].count(i) == 1 and i is not None]
        order = sorted({i for i, _ in rows if i is not None}, reverse=True)
        text = dict(rows)
        by_id = {r.doc_id: r for r in got if r.doc_id in single}
        for a, b in zip(order, order[1:], strict=False):
            if a in single and b in single:
                new = simhash.edited(text[a], text[b])
                assert by_id[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and by_id[a].n_chars == len(text[a])
                f = simhash.fingerprints(pa.array([text[a], new, text[b]]))
                assert [by_id[a].near_edited, by_id[a].near_next] == [simhash.likeness(f[:1], f[k : k + 1])[0] for k in (1, 2)]
    assert simhash.with_next(none).collect() == []
    counted = simhash.near_counts(simhash.with_next(odd), F.col("doc_id") % 5 == 0).collect()
    numbers = {int(r.fingerprint[:16], 16) for r in counted}
    assert len(counted) == len(rows) and all((r.near_fingerprints is None) == (r.doc_id is None or r.doc_id % 5 != 0) for r in counted)
    assert all(r.near_fingerprints == sum(0 < (n ^ int(r.fingerprint[:16], 16)).bit_count() <= 3 for n in numbers) for r in counted if r.near_fingerprints is not None)
    one = simhash.with_next(odd.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_edited <= 1 and one[0].near_next == 1


def test_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (60, 64), dtype=np.uint8)
    near = base[rng.integers(0, 60, 120)].copy()
    for row in near:
        row[rng.choice(64, rng.integers(0, 6), replace=False)] ^= 1
    bits = np.unique(np.concatenate([base, near, base[:5]]), axis=0)
    prints = [np.packbits(b).tobytes() for b in bits]
    numbers = [int.from_bytes(p, "big", signed=True) for p in prints]
    df = spark.createDataFrame([(n,) for n in [*numbers, numbers[0], None]], "fp long")
    for radius in (0, 1, 3, 5):
        want = {(numbers[i], numbers[j], int((bits[i] != bits[j]).sum())) for i, j in itertools.permutations(range(len(bits)), 2) if 0 < (bits[i] != bits[j]).sum() <= radius}
        got = simhash.within_radius(df, df, radius).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    some = df.filter(F.col("fp") % 3 == 0)
    got = simhash.within_radius(some, df, 3).collect()
    want = {(numbers[i], numbers[j]) for i, j in itertools.permutations(range(len(bits)), 2) if (bits[i] != bits[j]).sum() <= 3 and abs(numbers[i]) % 3 == 0}
    assert {(r.asked, r.found) for r in got} == want
    assert simhash.within_radius(df.filter("false"), df.filter("false")).collect() == []


@pytest.mark.parametrize("prints", [1, 10**5, 10**8, 10**10, 10**12, 10**18])
def test_block_tables_of_any_size_find_all(prints):
    masks, tables = simhash.block_tables(prints, 3)
    assert sum(masks) == (1 << 64) - 1 and len(tables) == math.comb(len(masks), 3)
    rng = random.Random(prints)
    for _ in range(200):
        differ = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not differ & sum(masks[j] for j in c) for c in tables)


def test_fingerprints_against_votes_by_hand():
    """Bits recomputed term by term from the terms' hashes."""
    texts = ["one two three four five six seven", "one", "a b a b a b", "", "The the THE"]
    got = simhash.fingerprints(pa.array(texts), 64)
    words = simhash.Words(pa.array(texts))
    pairs, pair_of = simhash._pairs(words)
    fives, five_of = simhash.runs(words, 5)
    for i in range(len(texts)):
        total = [0] * 64
        for terms, of, weight in ((pairs, pair_of, simhash.PAIR_WEIGHT), (fives, five_of, simhash.FIVE_WEIGHT)):
            for h in simhash.mix(terms[of == i]).tolist():
                for byte in range(8):
                    for bit in range(8):
                        total[8 * byte + bit] += weight if h >> (8 * byte) >> (7 - bit) & 1 else -weight
        assert np.unpackbits(got[i]).tolist() == [int(t > 0) for t in total]
        n = len(words_of(texts[i]))
        assert (pair_of == i).sum() == (n + 1 if n else 0) and (five_of == i).sum() == max(0, n - 4)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(n) and rows[m][0] is not None] if sets[n] else [i]
        out.append((str(i), len(sets[n]), str(min(ids, default=None) if ids != [None] else None)))
    return sorted(out)


def test_jaccard_components_against_all_pairs(spark, odd, none):
    rng = random.Random(8)
    rows = []
    for group in range(6):
        base = prose(rng, rng.randint(4, 90)).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"q{rng.randint(0, 99)}"
            rows.append((group * 100 + k, " ".join(w)))
    rows += [(1000 + k, prose(rng, 12) + " this passage stands in many of the documents and is never rare at all") for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(df).collect())
    assert got == brute_components(rows)
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(none).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(30)) and got[200] == got[201] == 200


def test_components_write_no_more_files_than_there_are_cores(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 2000) if i % 4 != 3], "a long, b long")
        got = jaccard_join.components(edges)
        assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism < 40
        assert {(r.v, r.label) for r in got.collect()} == {(i, i - i % 4) for i in range(2000)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_chains_against_all_chains():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        x, y, size = [rng.randint(0, 60) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)], [rng.randint(6, 20) for _ in range(n)]
        cost, k = substring_dedup.SKIP_COST, substring_dedup.K
        last = lambda i, s, size=size, k=k: s[i] + size[i] - k

        def value(c, x=x, y=y, size=size, cost=cost, k=k, last=last):
            return sum(size[i] for i in c) - cost * sum(x[b] + y[b] - last(a, x) - last(a, y) - 2 * k for a, b in itertools.pairwise(c))

        best = max(value(c) for r in range(1, n + 1) for c in itertools.permutations(range(n), r) if all(last(a, x) < x[b] and last(a, y) < y[b] for a, b in itertools.pairwise(c)))
        found = substring_dedup.chains(x, y, size)
        assert abs(value(found[0]) - best) < 1e-9 and sorted(i for c in found for i in c) == list(range(n))


def test_blocks_and_parts():
    x, y = np.array([0, 3, 9, 20, 5]), np.array([10, 13, 19, 30, 90])
    assert sorted(zip(*substring_dedup.blocks(x, y), strict=True)) == [(0, 10, 15), (5, 90, 6), (20, 30, 6)]
    assert substring_dedup.parted([0, 8, 500], [0, 11, 503], [10, 10, 20]) == [[(0, 0, 10), (10, 13, 8)], [(500, 503, 20)]]
    assert substring_dedup.matched(np.array([1, 2, 3, 4]), np.array([2, 9, 4])) == 2
    # 100 words, 90 amiss, 100 words: two parts; with 20 amiss, one
    assert substring_dedup.alike([0, 190], [0, 190], [100, 100], [0]) == [(0, 0), (1, 1)]
    assert substring_dedup.alike([0, 120], [0, 120], [100, 100], [0]) == [(0, 1)]


def test_alignment_counts_matches():
    a = np.arange(200, dtype=np.uint64)
    b = np.delete(np.where(a == 50, 999, a).astype(np.uint64), 100)
    x, y, size = [20, 51, 101], [20, 51, 100], [30, 49, 40]
    gaps = lambda w, at: [w[: at[0]], *(w[p + n : q] for p, n, q in zip(at, size, at[1:], strict=False)), w[at[-1] + size[-1] :]]
    assert list(substring_dedup.passages(x, y, size, gaps(a, x), gaps(b, y), (False,) * 4)) == [(0, 200, 0, 199, 198)]
    assert list(substring_dedup.passages(x, y, size, gaps(a, x), gaps(b, y), (True,) * 4)) == [None]


def test_repeated_passages_are_found_and_only_these(spark, odd, none):
    rng = random.Random(21)
    fresh = lambda n: " ".join(f"{a}{rng.randint(0, 10**6)}" for a in rng.choices("abcdef", k=n))
    passages = [fresh(55), fresh(80), fresh(300)]
    rows, holds = [], {k: set() for k in range(3)}
    for i in range(40):
        parts = [fresh(rng.randint(0, 60))]
        for k, p in enumerate(passages):
            if rng.random() < 0.25:
                w = p.split()
                if rng.random() < 0.5:
                    w[rng.randrange(len(w))] = "changed"
                parts += [" ".join(w), fresh(rng.randint(0, 40))]
                holds[k].add(i)
        rows.append((i, "\n".join(parts)))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    flagged = {r.doc_id for r in got} | {r.other_id for r in got}
    must = {i for k in (1, 2) for i in holds[k]}
    assert must <= flagged <= must | holds[0]
    for r in got:
        a, b = (words_of(rows[i][1])[s:e] for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)))
        assert len(set(a) & set(b)) >= r.matched_words - 2 and r.identity >= 0.8 and r.matched_words >= 50
    found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(odd).collect()}
    assert any({42, 43} == set(p) for p in found)  # the two very long texts
    assert substring_dedup.repeated_passages(none).collect() == []


def hidden_by_hubs(rng):
    """Two texts share 70 words; the first 35 stand in 30 other texts and the last 35 in 30 more."""
    fresh = lambda n: [f"{a}{rng.randint(0, 10**6)}" for a in rng.choices("abcdef", k=n)]
    half, other = fresh(35), fresh(35)
    rows = [half + other, half + other, *[half] * 30, *[other] * 30]
    return [(i, " ".join(fresh(40) + w + fresh(40))) for i, w in enumerate(rows)]


def test_a_passage_whose_parts_are_common_elsewhere_is_found(spark):
    df = spark.createDataFrame(hidden_by_hubs(random.Random(33)), "doc_id long, text string")
    for parts in (1, 5):
        got = [r for r in substring_dedup.repeated_passages(df.repartition(parts)).collect()]
        assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((0, 1))}
        assert got[0].matched_words >= 70 and got[0].end_word - got[0].start_word == got[0].matched_words


def test_a_passage_is_followed_beyond_the_words_first_fetched(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "REACH", 5)
    rng = random.Random(34)
    fresh = lambda n: [f"{a}{rng.randint(0, 10**6)}" for a in rng.choices("abcdef", k=n)]
    first = fresh(300)
    second = [w if 100 <= n < 130 or n % 6 != 5 else "changed" for n, w in enumerate(first)]
    df = spark.createDataFrame([(0, " ".join(first)), (1, " ".join(second))], "doc_id long, text string")
    assert [(r.start_word, r.end_word) for r in substring_dedup.repeated_passages(df).collect()] == [(0, 299)]


def fresh_words(rng, n):
    return [f"{a}{rng.randint(0, 10**6)}" for a in rng.choices("abcdef", k=n)]


def shares(rows, got):
    """Of each pair of documents, words of the first in a row of the result."""
    out = {}
    for r in got:
        for i, j, s, e in ((r.doc_id, r.other_id, r.start_word, r.end_word), (r.other_id, r.doc_id, r.other_start, r.other_end)):
            out.setdefault((i, j), set()).update(range(s, e))
    return out


def test_edited_lone_passages_are_found(spark):
    rng = random.Random(4)
    for size, every, share in ((60, 10, 0), (80, 8, 0), (60, 0, 0.05), (60, 0, 0.1), (100, 0, 0.15)):
        rows, pairs = [], []
        while len(pairs) < 40:
            one = fresh_words(rng, size)
            two = ["changed" if (n % every == every - 1 if every else rng.random() < share) else w for n, w in enumerate(one)]
            same = sum(a == b for a, b in zip(one, two, strict=True))
            if same >= 50 and same >= 0.8 * size:
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows) + k, " ".join(fresh_words(rng, 30) + w + fresh_words(rng, 30))) for k, w in enumerate((one, two))]
        got = {frozenset((r.doc_id, r.other_id)) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got <= {frozenset(p) for p in pairs}
        assert len(got) >= 0.9 * len(pairs), (size, every, share, len(got))


def test_passages_with_any_gap_between_are_found_whatever_the_partitions(spark):
    rng = random.Random(6)
    rows, planted = [], []
    for gap in (0, 30, 50, 100, 200, 300, 600, 1500, 2000):
        for count in (1, 2, 3, 4):
            i, parts = len(rows), [fresh_words(rng, rng.randint(55, 300)) for _ in range(count)]
            texts = [[], []]
            for p in parts:
                for k in (0, 1):
                    texts[k] += fresh_words(rng, max(0, gap + rng.randint(-gap // 3, gap // 3)))
                    planted.append((i + k, i + 1 - k, len(texts[k]), len(texts[k]) + len(p)))
                    texts[k] += p
            rows += [(i + k, " ".join(t + fresh_words(rng, 20))) for k, t in enumerate(texts)]
    results = []
    for parts in (1, 4, 8):
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        results.append(sorted(map(tuple, got)))
    assert results[0] == results[1] == results[2]
    covered = shares(rows, got)
    assert all(len(set(range(s, e)) & covered.get((i, j), set())) >= 0.97 * (e - s) for i, j, s, e in planted)
    for r in got:  # brute force: each row's words are as alike as it says
        a, b = (words_of(rows[i][1])[s:e] for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)))
        n = substring_dedup.matched(np.array([hash(w) for w in a]), np.array([hash(w) for w in b]))
        assert n >= r.matched_words >= 50 and r.identity >= 0.8


def test_common_passages_link_all_their_texts(spark):
    """Many texts with one passage, some of them edited, and passages within others: every text that shares 50 words with another is linked to one that has them."""
    rng = random.Random(7)
    common, inner = fresh_words(rng, 120), fresh_words(rng, 70)
    rows = []
    for i in range(60):
        w = list(common)
        if i % 3 == 0:
            w[60:60] = inner
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(fresh_words(rng, rng.randint(0, 60)) + w + fresh_words(rng, 10))))
    texts = {i: words_of(t) for i, t in rows}
    windows = {}
    for i, w in texts.items():
        for p in range(len(w) - 49):
            windows.setdefault(tuple(w[p : p + 50]), set()).add(i)
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    covered = {}
    for (i, _), at in shares(rows, got).items():
        covered.setdefault(i, set()).update(at)
    for i, w in texts.items():
        for p in range(len(w) - 49):
            assert len(windows[tuple(w[p : p + 50])]) < 2 or covered[i] >= set(range(p, p + 50)), (i, p)


def test_edited_passages_whose_seeds_are_common_elsewhere(spark):
    """Two texts share an edited passage; each third of it stands in many other texts too."""
    rng = random.Random(14)
    thirds = [fresh_words(rng, 30) for _ in range(3)]
    one = [w for t in thirds for w in t]
    two = ["changed" if n in (14, 44, 75) else w for n, w in enumerate(one)]
    rows = [(0, " ".join(fresh_words(rng, 20) + one)), (1, " ".join(two + fresh_words(rng, 20)))]
    rows += [(2 + 20 * k + i, " ".join(fresh_words(rng, 40) + t + fresh_words(rng, 40))) for k, t in enumerate(thirds) for i in range(20)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((0, 1))} and got[0].matched_words >= 85


def common_phrases(rng):
    """Pairs of texts share an edited passage of phrases that each stand in 20 other texts, or a phrase of 10 words that all texts hold with 50 edited words before or after it."""
    line = fresh_words(rng, 10)
    rows, pairs = [], []
    for n in range(8):
        one = fresh_words(rng, 60)
        two = ["changed" if k % 10 == 9 else w for k, w in enumerate(one)]
        rows += [fresh_words(rng, 20) + one, two + fresh_words(rng, 20)]
        pairs.append(frozenset((len(rows) - 2, len(rows) - 1)))
        rows += [fresh_words(rng, 30) + one[k : k + 9] + fresh_words(rng, 30) for k in range(0, 60, 10) for _ in range(20)]
        more = fresh_words(rng, 50)
        changed = ["changed" if k % 7 == 5 else w for k, w in enumerate(more)]
        rows += [fresh_words(rng, 20) + line + more, line + changed + fresh_words(rng, 20)] if n % 2 else [more + line + fresh_words(rng, 30), fresh_words(rng, 9) + changed + line]
        pairs.append(frozenset((len(rows) - 2, len(rows) - 1)))
    rows += [fresh_words(rng, 40) + line + fresh_words(rng, 40) for _ in range(100)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)], set(pairs)


def test_edited_passages_all_of_whose_seeds_are_common_are_found(spark):
    rows, pairs = common_phrases(random.Random(41))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, hot = (substring_dedup.repeated_passages(df.repartition(parts), hot=n).collect() for parts, n in ((3, 10**6), (5, 10)))
    assert {frozenset((r.doc_id, r.other_id)) for r in plain} == pairs
    assert sorted(map(str, plain)) == sorted(map(str, hot))


def test_digests_rule_out_no_pair_that_shares_enough_words():
    rng = np.random.default_rng(42)
    for _ in range(200):
        one = rng.integers(0, 40, 140).astype(np.uint64)
        two = rng.integers(0, 40, 140).astype(np.uint64)
        at = rng.choice(34, 22, replace=False)
        side = 70 + 6 + np.sort(at) if rng.random() < 0.5 else 69 - np.sort(at)
        two[side] = one[side]
        a, b = (substring_dedup.holders(substring_dedup.mix(w), np.array([1]), np.array([70]), k, [], 34) for k, w in enumerate((one, two)))
        assert [(u.tolist(), v.tolist()) for u, v in substring_dedup.near_pairs(a, b, 22)] == [([0], [0])]
        assert [(u.tolist(), v.tolist()) for u, v in substring_dedup.near_pairs(np.concatenate([a, b]), None, 22)] == [([0], [1])]


def test_links_of_a_group():
    """Each with each in small groups; in larger ones with the first, and again within those that go on alike."""
    key, pos = np.arange(10, dtype=np.int64) + 100, np.zeros(10, np.int32)
    one = np.ones(10, np.uint64)
    few = lambda *going, n: {(int(a), int(b)) for a, b in zip(*substring_dedup.links(one[:n], key[:n], pos[:n], *(np.array(g[:n]) for g in going), few=4)[:2], strict=True)}
    assert few(n=4) == {(a, b) for a in range(100, 104) for b in range(100, a)}
    assert few(n=10) == {(a, 100) for a in range(101, 110)}
    going = [0, 0, 0, 0, 0, 7, 7, 7, 8, 8]
    assert few(going, n=10) == {(a, 100) for a in range(101, 110)} | {(106, 105), (107, 105), (107, 106), (109, 108)}
    deep = [7] * 10, [1, 1, 1, 1, 1, 1, 1, 1, 5, 5]
    assert few(*deep, n=10) == {(a, 100) for a in range(101, 110)} | {(109, 108)}


def test_passages_of_equal_texts_repeated_rows_and_null_ids(spark):
    rng = random.Random(17)
    text, other = " ".join(fresh_words(rng, 80)), " ".join(fresh_words(rng, 80))
    rows = [(1, text), (1, text), (2, text), (3, text), (None, text), (None, text), (1, other), (5, ""), (6, None), (7, None)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # rows that repeat id and text are one: four texts are left, each with each
    assert sorted(sorted(map(str, (r.doc_id, r.other_id))) for r in got) == sorted(sorted(p) for p in itertools.combinations(["1", "2", "3", "None"], 2))
    assert all((r.start_word, r.end_word, r.other_start, r.other_end, r.matched_words, r.identity) == (0, 80, 0, 80, 80, 1.0) for r in got)


def test_hot_seeds_give_the_same_passages(spark):
    rng = random.Random(23)
    common, inner = fresh_words(rng, 90), [fresh_words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(40):
        w = list(common)
        if i % 3 == 0:
            w[50:50] = inner[i % 4]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(fresh_words(rng, rng.randint(0, 30)) + w + fresh_words(rng, 10))))
    rows += [rows[3], rows[3], (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain, hot, some = (sorted(map(str, substring_dedup.repeated_passages(df, hot=n).collect())) for n in (10**6, 0, 20))
    assert plain == hot == some and len(plain) > 40


def test_texts_that_share_too_short_a_run_are_no_chains(spark, monkeypatch):
    """Sixty texts hold one run of 30 words between words of their own; two of them share 40 more, edited, on both sides of it."""
    rng = random.Random(51)
    run, before, after = fresh_words(rng, 30), fresh_words(rng, 20), fresh_words(rng, 20)
    rows = [fresh_words(rng, 90) + run + fresh_words(rng, 90) for _ in range(58)]
    edited = lambda w: ["changed" if k % 8 == 4 else x for k, x in enumerate(w)]
    rows += [fresh_words(rng, 50) + before + run + after + fresh_words(rng, 50), fresh_words(rng, 70) + edited(before) + run + edited(after) + fresh_words(rng, 60)]
    chains, real = [], substring_dedup.written

    def counted(df, what, *more):
        out = real(df, what, *more)
        chains.extend([out.count()] if what == "chains" else [])
        return out

    monkeypatch.setattr(substring_dedup, "written", counted)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    assert {frozenset((r.doc_id, r.other_id)) for r in substring_dedup.repeated_passages(df).collect()} == {frozenset((58, 59))}
    assert sum(chains) < 200  # 1,770 pairs


def test_words_in_sight_rule_out_no_passage():
    rng = np.random.default_rng(52)
    for _ in range(100):
        one, two = rng.integers(1, 30, (2, 128)).astype(np.uint16)
        best = substring_dedup.in_order(one[None], two[None])[0]
        assert [int(best[p]) for p in (0, 1, 63, 64, 65, 128)] == [substring_dedup.matched(one, two[:p]) for p in (0, 1, 63, 64, 65, 128)]
        assert substring_dedup.in_both(*(substring_dedup.counted(w[None]) for w in (one, two)))[0] >= best[-1]
    for _ in range(200):  # 6 words of a seed, p and q beside it, one in five amiss at most, matched words 50 or more
        p = int(rng.integers(0, 57))
        q = int(rng.integers(56 - p, 129))
        amiss = min(p + q - 44, (p + q + 6) // 5)
        sides = [(np.zeros((1, 128), np.uint16), np.zeros((1, 128), np.uint16)) for _ in range(2)]
        out = rng.choice(p + q, int(rng.integers(0, amiss + 1)), replace=False)
        for (x, y), n, first in ((sides[0], p, 0), (sides[1], q, p)):
            x[0, :n] = rng.permutation(60000)[:n] + 1
            y[0, :n] = x[0, :n]
            y[0, [k - first for k in out if first <= k < first + n]] = 65000
        assert substring_dedup.possible(*sides, 50, 0.8).all()


def test_room_for_a_passage_is_asked_of_both_texts():
    """44 words beside a seed match in order, one after the other in one text but strewn over 128 words of the other: 50 of 134 are no passage."""
    one = np.arange(1, 129, dtype=np.uint16)[None]
    two = np.zeros((1, 128), np.uint16)
    two[0, :44] = one[0, np.linspace(0, 127, 44).astype(int)]
    none = np.zeros((1, 128), np.uint16)
    for a, b in ((one, two), (two, one)):
        assert not substring_dedup.possible((none, none), (a, b), 50, 0.8)[0]
        assert not substring_dedup.possible((a, b), (none, none), 50, 0.8)[0]


def test_parities_and_words_in_place_are_bounds():
    rng = np.random.default_rng(53)
    one, two = (substring_dedup.counted(rng.integers(1, 60, (50, 128)).astype(np.uint16)) for _ in range(2))
    apart = np.bitwise_count(substring_dedup.parities(one) ^ substring_dedup.parities(two)).sum(axis=1)
    assert all(128 - d / 2 >= len(set(a.tolist()) & set(b.tolist())) for d, a, b in zip(apart.tolist(), one, two, strict=True))
    a = rng.integers(1, 60000, (1, 256)).astype(np.uint16)
    b = a.copy()
    b[0, [3, 130]] = 60001
    assert substring_dedup.in_place(a, b, 20).tolist() == [25]
    around = substring_dedup.around_seed
    assert substring_dedup.sure(around(a[0]), around(b[0]), 50, 0.8)
    b[0, 4:128], b[0, 150:] = 60002, 60003
    assert not substring_dedup.sure(around(a[0]), around(b[0]), 50, 0.8)


def test_pairs_of_joined_classes_are_not_all_looked_at(spark, monkeypatch):
    """40 texts share an edited passage over a phrase that 200 other texts hold: all are joined, without a row for each of the 780 pairs."""
    rng = np.random.default_rng(54)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    phrase, passage = fresh(12), fresh(60)
    rows = [fresh(20) + phrase + fresh(20) for _ in range(200)]
    for k in range(40):
        words = list(passage)
        for at in rng.choice(np.arange(1, 59), 2, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append(fresh(20) + phrase + words + fresh(20))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {frozenset((r.doc_id, r.other_id)) for r in substring_dedup.repeated_passages(df).collect()}
    assert got and all(min(p) >= 200 for p in got) and len(got) < 500
    one = {i: i for i in range(200, 240)}
    for _ in range(40):
        for a, b in map(sorted, got):
            one[a] = one[b] = min(one[a], one[b])
    assert set(one.values()) == {200}
