import math
import random
import string

import numpy as np
import pyarrow as pa
import pytest


from shardwell.llm import language_id, secret_scan


def test_language_of_held_out_texts(spark, odd, none):
    rng = random.Random(5)
    alphabets = {"xx": ["the", "and", "ing", "of", "to"], "yy": ["der", "und", "ung", "sch", "zu"], "zz": ["что", "это", "как", "нет", "да"]}
    make = lambda k: " ".join("".join(rng.choices(alphabets[k], k=rng.randint(1, 3))) for _ in range(20))
    rows = [(i, make(k), k) for i in range(300) for k in [rng.choice(sorted(alphabets))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(df.filter("doc_id < 200"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].lang_score <= 1 for i, _, k in rows) and model.langs == ["xx", "yy", "zz"]
    out = language_id.predict(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "lang_score"]
    for r in out.collect():
        assert (r.lang_pred == "und" and r.lang_score == 0) == (not any(c.isalpha() for c in r.text or ""))
    empty = language_id.train(none.select("text", "lang"))
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"} and language_id.predict(none, model).collect() == []


def test_more_labels_than_a_task_holds_and_ties(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}rd " * 3, f"l{i:04d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = language_id.train(df.coalesce(1)), language_id.train(df.repartition(3))
    assert one.langs == many.langs == sorted(r[2] for r in rows) and (one.weights == many.weights).all()
    same = language_id.train(spark.createDataFrame([(0, "one text", "bb"), (1, "one text", "aa"), (2, "one text", "cc")], "doc_id long, text string, lang string"))
    assert same.predict(["one text", "other", ""])[0] == ["aa", "aa", "und"]  # ties go to the first in the alphabet


def test_log_probabilities_by_hand(spark):
    """Counts, smoothing, sums and scores again in plain Python."""
    texts = [("aa", "ab ab"), ("aa", "b"), ("bb", "cab c")]
    model = language_id.train(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string"))
    counts = {}
    for k, t in texts:
        for g in language_id.grams([t])[0].tolist():
            counts.setdefault(k, {}).setdefault(g, 0)
            counts[k][g] += 1
    weight = lambda k, g: math.log((counts[k].get(g, 0) + language_id.SMOOTHING) / (sum(counts[k].values()) + language_id.SMOOTHING * language_id.BUCKETS))
    for text in ("abc", "c", "cab ab b", "zz"):
        g = language_id.grams([text])[0].tolist()
        total = [sum(weight(k, x) for x in g) * min(1, language_id.EVIDENCE / len(g)) for k in ("aa", "bb")]
        (lang,), (score,) = model.predict([text])
        assert lang == ("aa" if total[0] >= total[1] else "bb") and abs(score - 1 / sum(math.exp(t - max(total)) for t in total)) < 1e-4


def test_certain_rows_keep_their_columns(spark):
    model = language_id.train(spark.createDataFrame([(0, "the one and other", "en"), (1, "der und die", "de")], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the other one", "mine", 0.25, "dot"), (2, "123", "mine", 0.5, "dot"), (3, None, None, None, None)], "doc_id long, text string, lang_pred string, lang_score double, `a.b` string")
    assert [tuple(r) for r in language_id.keep_certain(df, model, 0.3).collect()] == [(1, "the other one", "mine", 0.25, "dot")]
    assert language_id.predict(df, model).columns == ["doc_id", "text", "a.b", "lang_pred", "lang_score"]


def test_grams_are_those_of_the_folded_text():
    texts = ["Ab c", "", "É1é", "!!"]
    bucket, row, has = language_id.grams(texts)
    assert has.tolist() == [True, False, True, False]
    whole = language_id.grams([texts[0]])[0]
    assert sorted(bucket[row == 0].tolist()) == sorted(whole.tolist()) == sorted(language_id.grams(["aB,  c"])[0].tolist())
    assert not (row == 1).any() and not (row == 3).any()


def test_forest_on_other_findings_than_it_saw():
    forest = secret_scan.train(secret_scan.default_findings(1500, 1))
    other = secret_scan.default_findings(800, 2)
    score = forest.score(np.array([secret_scan.features(t, s, e) for t, s, e, _ in other])) >= 0.5
    label = np.array([y for *_, y in other]) == 1
    assert (score == label).mean() > 0.97 and score[label].mean() > 0.97
    assert all(any(a <= s and b >= e for a, b, _ in secret_scan.candidates(t)) for t, s, e, y in other if y)


def test_candidates_do_not_overlap_and_come_in_order():
    text = 'token = "ghp_' + "a1" * 20 + '" and AKIA' + "Z9" * 8 + " sha " + "0a" * 20 + " password: hunter2x key=1"
    found = secret_scan.candidates(text)
    assert [k for *_, k in found] == ["assigned", "issued", "run", "assigned"] and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert secret_scan.candidates("") == []


@pytest.fixture(scope="module")
def forest():
    return secret_scan.train(secret_scan.default_findings(1200, 3))


def test_scan_and_redact(spark, odd, none, forest):
    rng = random.Random(7)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(30)]
    rows = [(i, f'Wörds é😀 before.\nSome token = "{k}" after that.' if i % 2 else f"plain words number {i} of file lib/{k[:12]}/name.txt and no more") for i, k in enumerate(keys)]
    df = spark.createDataFrame([(i, t, len(t), "z") for i, t in rows], "doc_id long, text string, n_chars long, secret string").repartition(3)
    got = [r for r in secret_scan.scan(df, forest).collect() if r.secret]
    assert sorted(r.doc_id for r in got) == list(range(1, 30, 2)) and all(dict(rows)[r.doc_id][r.start : r.start + r.length] == keys[r.doc_id] for r in got)
    for r in secret_scan.redact(df, forest).collect():
        t = dict(rows)[r.doc_id]
        assert r.text == (t.replace(keys[r.doc_id], secret_scan.MARK) if r.doc_id % 2 else t) and r.n_chars == len(r.text) and r.secret == "z"
    same = secret_scan.redact(odd, forest)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert secret_scan.scan(odd, forest).filter("secret").collect() == [] and secret_scan.scan(none, forest).collect() == [] and secret_scan.redact(none, forest).collect() == []


def test_texts_without_a_trigger_are_left_out():
    texts = ["no sign", None, "a=b", "x1", "-----BEGIN PRIVATE KEY-----", string.ascii_letters, "ghp_" + string.ascii_letters[:36]]
    assert secret_scan.holds_any(pa.array(texts)).tolist() == [False, False, True, True, True, False, True]
    letters = string.ascii_letters
    rng = random.Random(3)
    bare = [f"some words {a}{''.join(rng.choices(letters, k=40))} more" for a in ("AKIA", "ghp_", "ghr_", "sk-", "xoxb-", "eyJ")] + [f"x eyJ{letters[:20]}.{letters[:20]}.{letters[:20]}", "password = correct horse battery staple", "a plain text"]
    assert all(h or not secret_scan.candidates(t) for t, h in zip(bare, secret_scan.holds_any(pa.array(bare)), strict=True))
    assert secret_scan.candidates(bare[1]) and secret_scan.candidates(bare[6])


def test_planted_secrets_become_candidates(forest):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    forms = ["https://h.example/login?user=bob&password={}", "cfg={{user:bob,password:{}}}", "mode=x;token={}", 'token2 = "{}"', "auth=call?password={}", "pwd: {}, and", "Authorization: Bearer {}"]
    for form in forms:
        scores = []
        for n in (10, 16, 32):
            for _ in range(20):
                value = key(n)
                text = "Some words before. " + form.format(value) + " and words after that."
                at = [(s, e) for s, e, _ in secret_scan.candidates(text) if text[s:e] == value]
                assert len(at) == 1, text
                scores.append(forest.score(np.array([secret_scan.features(text, *at[0])]))[0])
        assert np.mean(np.array(scores) >= 0.5) > 0.9, form
    assert [t for t in ("token=" * 100_000, "token=" + ",;" * 100_000) if len(secret_scan.candidates(t)) > 100_000] == []


def test_passphrases_of_several_words(forest):
    for text in ("password = correct horse battery staple", 'password: "correct horse battery staple",', "x\npassphrase=stone window seven rivers\nmore"):
        (s, e, kind), *rest = secret_scan.candidates(text)
        assert kind == "assigned" and not rest and text[s:e].count(" ") == 3
        assert forest.score(np.array([secret_scan.features(text, s, e)]))[0] >= 0.5
    for text in ('password: "that must be in the file"', "secret = the one that you are to set for this"):
        for s, e, _ in secret_scan.candidates(text):
            assert forest.score(np.array([secret_scan.features(text, s, e)]))[0] < 0.5, text


def test_redaction_leaves_null_texts_and_repeated_rows_as_they_are(spark, forest):
    key = "".join(random.Random(1).choices("0123456789abcdef", k=40))
    rows = [(1, None, 5), (1, None, None), (None, f'token = "{key}"', 50), (2, f'token = "{key}"', None), (2, f'token = "{key}"', None), (3, "plain", 99)]
    got = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), forest).collect()
    cleaned = f'token = "{secret_scan.MARK}"'
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None, 5), (1, None, None), (None, cleaned, len(cleaned)), (2, cleaned, len(cleaned)), (2, cleaned, len(cleaned)), (3, "plain", 99)]))
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), forest).filter("secret").collect()
    assert sorted(str(r.doc_id) for r in found) == ["2", "2", "None"]


def test_a_private_key_is_one_finding_to_its_end(forest):
    rng = random.Random(10)
    for kind in ("RSA ", "", "OPENSSH "):
        body = "\n".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(25))
        block = f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
        for text, want in ((f"key:\n{block}\nmore", block), (f'private_key = "{block}"', block), (f"x {block[:-40]}", None)):
            (s, e, found), *rest = secret_scan.candidates(text)
            assert found == "issued" and not rest and (text[s:e] == want if want else text[s:].startswith(block[:1600]) and e - s >= 1600)
            assert forest.score(np.array([secret_scan.features(text, s, e)]))[0] >= 0.5


def test_features_see_the_whole_candidate():
    rng = random.Random(13)
    path = "/".join("path" for _ in range(70)) + "1"
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=200))
    one, two = (f"see {path}/{end}" for end in ("path/" * 40, key))
    assert len(path) > 256
    a, b = (secret_scan.features(t, 4, 4 + len(path) + 1 + 200) for t in (one, two))
    assert a[0] == b[0] and all(x != y for x, y in zip(a[2:6], b[2:6], strict=True)) and a[13] != b[13]
