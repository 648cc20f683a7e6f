import random
import re

import corpus_pipeline
from conftest_llm import odd_rows, prose

from shardwell.llm import jaccard_join, language_id, runtime


def test_stages_in_turn(spark, odd, none, tmp_path):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs, seen = base, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, ""), name)
        seen[name] = docs.collect()
        assert docs.columns == base.columns, name
    texts = [r[1] for r in odd_rows()]
    assert len(seen["language_id"]) == sum(any(c.isalpha() for c in t or "") for t in texts)
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in seen["exact_dedup"]}) == len(seen["exact_dedup"])
    groups = jaccard_join.jaccard_components(docs).collect()
    assert len(seen["jaccard_join"]) == len(groups)
    assert len({g.component_id for g in groups}) == len({g.doc_id for g in groups})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(base.columns), "").collect() == [], name


def test_run_is_its_stages(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert language_id.UNKNOWN == "und" and len(corpus_pipeline.STAGES) == 5


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    one, two, three = (prose(rng, 100) for _ in range(3))
    near = lambda t: t + " and"
    rows = [(None, one), (None, near(one)), (None, two), (5, near(three)), (5, three), (4, three + " of"), (7, ""), (7, ""), (None, None), (9, "! !"), (9, "! !")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, `a.b` string, mark long, label double").repartition(4)
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    left = sorted((str(r.doc_id), r.text) for r in got.collect() if r.text)
    assert left[0] == ("4", three + " of") and left[1] == ("9", "! !") and left[3] == ("None", two) or left[2] == ("None", two)
    assert len(left) == 4 and sum(t in (one, near(one)) for _, t in left) == 1
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect() if not r.text) == [("7", ""), ("7", ""), ("None", "None")]


def test_a_users_own_columns_come_through(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, prose(rng, 50), "en", f"p{i}", i / 10, f"d{i}") for i in range(20)], "doc_id long, text string, lang string, lang_pred string, lang_score double, `a.b` string")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns
    assert sorted(map(str, docs.collect())) == sorted(map(str, df.collect()))
