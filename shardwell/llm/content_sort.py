"""Exact duplicates by sorting content.

Rows are range-partitioned by sampled splitters over (first bytes, hash) of the normalised text, an
external sort places equal texts side by side, and neighbours are compared over their full bytes.
Only DataFrame expressions run here.

A text that holds more than its share of all rows would fill one partition, so such texts are found
first by counting 64-bit hashes (a bounded list: at most `4 x partitions` can exceed the share), and
their rows are dealt over salts; the few sub-runs are then joined by their SHA-256.

Defined results: null text counts as empty; rows with a null id group like others, an id that is
null never wins over one that is not, and a group of null ids only has keep_id null and keeps one
row; of rows that repeat id and text, one stays; an empty table gives an empty result; further
columns, whatever their names, are carried untouched in `carry`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import documents, query, width

#: Runs of white space that are not already a single blank.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SHARE = 4
#: Groups of fewer rows than this are never crowded.
LEAST_CROWD = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and `row` (struct of carry)."""
    n = width(docs.sparkSession)
    keyed = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else [])
    ).withColumn("h", F.xxhash64("norm"))
    total = docs.count()
    crowded = keyed.groupBy("h").count().filter(F.col("count") > F.lit(max(total // (SHARE * n), LEAST_CROWD)))
    hot = [r["h"] for r in crowded.select("h").collect()]  # at most SHARE * n of them, by the threshold
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    dealt = keyed.withColumn("head", F.substring("norm", 1, 16))
    keys = ["head", "h"]
    if hot:  # a salt that is the same everywhere would be folded away, and the window would not see its order in the range partitions
        dealt = dealt.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(4 * n))).otherwise(F.lit(0)))
        keys.append("salt")
    placed = dealt.repartitionByRange(n, *keys)
    same = W.partitionBy(*keys, "norm")
    order = same.orderBy(F.col("id").asc_nulls_last())
    runs = placed.select(
        "id", "h", *(["row"] if carry else []), F.sha2("norm", 256).alias("text_sha256"),
        F.first("id").over(order).alias("low"), F.count(F.lit(1)).over(same).alias("size"), F.row_number().over(order).alias("place"),
    )
    keep, size = F.col("low"), F.col("size")
    if hot:
        whole = keyed.filter(is_hot).groupBy("norm").agg(F.min("id").alias("g_low"), F.count(F.lit(1)).alias("g_size"))
        whole = whole.select(F.sha2("norm", 256).alias("text_sha256"), "g_low", "g_size")
        runs = runs.join(F.broadcast(whole), "text_sha256", "left")
        keep, size = F.coalesce("g_low", "low"), F.coalesce("g_size", "size")
    return runs.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), size.cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"), "text_sha256", *(["row"] if carry else []),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, all columns as they were."""
    return content_sort(docs, id_col, text_col, carry=docs.columns).filter("kept").select("row.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""


@query("op6_content_sort", ORACLE)
def op6_content_sort(spark, sf_dir):
    return content_sort(documents(spark, sf_dir))
