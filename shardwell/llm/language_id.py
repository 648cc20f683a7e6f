"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every labelled training row is counted (one pass; partial counts by task and language, a table of
`BUCKETS` numbers each, given out and begun anew after `HELD` languages; summed in two steps, so that no
task gets all tables of a language). The matrix of log probabilities has languages x BUCKETS floats,
whatever the size of the corpus, and goes to the executors once. Texts are scored as sparse vectors:
the distinct n-grams of a batch pick rows of the matrix, weighted by their counts. All languages have
the same prior: a language is not likelier for being more frequent in the training rows.

N-grams run over code points, lower-cased one by one, of letters only: every stretch of other
characters is one blank, so digits, marks and white space say nothing about the language.

Defined results: a null text or one without letters is `und` with score 0; a language unseen in
training cannot be predicted; with no training rows all is `und`; ties go to the language first in
the alphabet; null lang rows are predicted, not learned from; other columns are not read. The score
is the posterior of the predicted language with evidence counted as at most `EVIDENCE` n-grams,
since n-grams of a text are far from independent.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import documents, map_rows, query
from .textkit import U64, mix, pieces

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
EVIDENCE = 50.0
UNKNOWN = "und"
#: Languages whose counts a task holds at a time; tables that one task of the first step sums.
HELD, STEP = 64, 256
#: Bytes of text whose n-grams are held at a time.
PIECE = 1 << 18


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter or not, of each code point."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            letter[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return lower, letter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the row of each, and whether each row has letters."""
    lower, letter = _tables()
    code = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes + 1)
    real = letter[code]
    has = np.bincount(row[real], minlength=len(texts)) > 0
    low = np.where(real, lower[code], 32)
    first = np.ones(len(code), bool)
    first[1:] = real[:-1] | (row[1:] != row[:-1])  # of a stretch of blanks, the first stays
    keep = real | first
    low, row, real = low[keep].astype(U64), row[keep], real[keep]
    out, of = [], []
    for n in ORDERS:
        if len(low) < n:
            continue
        h = np.full(len(low) - n + 1, n, U64)
        for i in range(n):
            h = h * U64(0x100000001B3) + low[i : len(low) - n + 1 + i]
        good = row[: len(row) - n + 1] == row[n - 1 :]
        some = real[: len(real) - n + 1].copy()
        for i in range(1, n):
            some |= real[i : len(real) - n + 1 + i]
        good &= some
        out.append((mix(h[good]) % U64(BUCKETS)).astype(np.int32))
        of.append(row[: len(row) - n + 1][good])
    return (np.concatenate(out), np.concatenate(of), has) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), has)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


_COUNTS = "lang string, part int, counts binary"


def _packed(held: dict[str, np.ndarray], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([part] * len(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], ["lang", "part", "counts"])


def _count(batches):
    """Counts of this task by language."""
    held: dict[str, np.ndarray] = {}
    part = TaskContext.get().partitionId() // STEP
    for whole in batches:
        for batch in pieces(whole, most=PIECE):
            bucket, row, _ = grams(_texts(batch.column("text")))
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(bucket[mine[row]], minlength=BUCKETS)
                if len(held) >= HELD:
                    yield _packed(held, part)
                    held = {}
    if held:
        yield _packed(held, part)


def _add(batches):
    """Sums of what comes in order of language and part, one row for each."""
    open_, total = None, None
    for batch in batches:
        for lang, part, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "counts")), strict=True):
            if (lang, part) != open_:
                if open_ is not None:
                    yield _packed({open_[0]: total}, open_[1])
                open_, total = (lang, part), np.zeros(BUCKETS, np.int64)
            total += np.frombuffer(zlib.decompress(counts), np.int64)
    if open_ is not None:
        yield _packed({open_[0]: total}, open_[1])


class Model:
    """Languages in alphabetical order; log probabilities as BUCKETS x languages."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        langs = sorted(counts)
        table = np.array([counts[x] for x in langs], np.float64).reshape(len(langs), BUCKETS) + SMOOTHING
        return cls(langs, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32).copy())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bucket, row, has = grams(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        size = np.bincount(row, minlength=len(texts))
        total = np.stack([np.bincount(row, self.weights[bucket, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1).astype(np.float64)
        total *= np.minimum(1, EVIDENCE / np.maximum(size, 1))[:, None]
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = 1 / share.sum(1)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def train(rows: DataFrame) -> Model:
    """rows: text, lang. All rows are counted; at most languages x tasks tables travel, and one table of each language reaches the driver."""
    parts = rows.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_count, _COUNTS)
    for _ in range(2):
        parts = parts.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(_add, _COUNTS).withColumn("part", F.lit(0))
    return Model.of_counts({r["lang"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in parts.collect()})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score after its own columns (of the caller's columns those with these names are replaced, see `keep_certain` for a way that leaves them)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    added = (T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()))

    def go(batches):
        for whole in batches:
            for batch in pieces(whole, text_col, PIECE):
                langs, score = sent.value.predict(_texts(batch.column(text_col)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "lang_score"])

    return map_rows(docs, go, added)


def keep_certain(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """docs with a known language of at least this score; all columns as they were, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        for whole in batches:
            for batch in pieces(whole, text_col, PIECE):
                langs, score = sent.value.predict(_texts(batch.column(text_col)))
                yield batch.filter(pa.array(np.array([x != UNKNOWN for x in langs], bool) & (score >= least)))

    return map_rows(docs, go)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs.filter(fold(F.col("doc_id")) != 1).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
