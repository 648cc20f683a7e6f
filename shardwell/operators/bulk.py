"""Whole-table writes as DataFrame transformations, for batches that are themselves tables.

`batch` has the table's columns and `ordinal`, the place of each row in the batch. Each function
returns the table after the batch; nothing is collected, and each key meets its rows by one shuffle
on the primary key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _one(batch: DataFrame, key: list[str], last: bool) -> DataFrame:
    order = F.col("ordinal").desc() if last else F.col("ordinal").asc()
    return batch.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("__n = 1").drop("__n", "ordinal")


def replace(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch take the place of those with their keys; of several in the batch, the last."""
    new = _one(batch, key, last=True)
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


DUPLICATE, NOT_PERFORMED = "DuplicateKeyError", "NotPerformedError"


def insert(table: DataFrame, batch: DataFrame, key: list[str], shard: Column | None = None, stop_on_error: bool = False, rollback_on_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table after, rejected rows with their `error`): a key that is there, or came earlier in the batch, is a duplicate.

    shard: of a row, for the policies. stop_on_error: in a shard, rows after its first error are not
    performed; rollback_on_error: nor is any row of a shard with an error. A shard's first error is an
    aggregate, so no shard's rows are gathered.
    """
    first = batch.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("ordinal")))
    there = table.select(*key).withColumn("__there", F.lit(True))
    judged = first.join(there, key, "left").withColumn("error", F.when(F.col("__there").isNotNull() | (F.col("__n") > 1), F.lit(DUPLICATE))).drop("__n", "__there")
    if shard is not None and (stop_on_error or rollback_on_error):
        judged = judged.withColumn("__shard", shard)
        failed = judged.filter("error IS NOT NULL").groupBy("__shard").agg(F.min("ordinal").alias("__failed"))
        judged = judged.join(failed, "__shard", "left")
        late = F.col("ordinal") > F.col("__failed")
        given_up = F.lit(False)
        if stop_on_error:
            given_up = given_up | late
        if rollback_on_error:
            given_up = given_up | (F.col("__failed").isNotNull() & F.col("error").isNull())
        judged = judged.withColumn("error", F.when(given_up, F.lit(NOT_PERFORMED)).otherwise(F.col("error"))).drop("__shard", "__failed")
    good = judged.filter("error IS NULL").select(*table.columns)
    return table.unionByName(good), judged.filter("error IS NOT NULL")


def update(table: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    return table.withColumns({name: F.when(where, to.cast(table.schema[name].dataType)).otherwise(F.col(name)) for name, to in changes.items()})


@dataclass(frozen=True)
class Adding:
    """A change of `upsert` that adds an amount, once for each row of the batch."""

    amount: Column


def upsert(table: DataFrame, batch: DataFrame, key: list[str], changes: dict[str, Column | Adding]) -> DataFrame:
    """Keys that are there take `changes` for the batch's rows with that key: a Column sets (columns of the batch are `new.<name>`), Adding adds once for each row; others are inserted, and later rows of the batch change them."""
    hits = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("__hits"), F.min_by(F.struct(*[c for c in batch.columns if c != "ordinal"]), "ordinal").alias("new"))
    joined = table.withColumn("__old", F.lit(True)).join(hits, key, "full")
    times = F.when(F.col("__old").isNotNull(), F.coalesce("__hits", F.lit(0))).otherwise(F.col("__hits") - 1)
    base = {c: F.when(F.col("__old").isNotNull(), F.col(c)).otherwise(F.col(f"new.{c}")) for c in table.columns if c not in key}
    joined = joined.select(*key, *[v.alias(c) for c, v in base.items()], "new", times.alias("__times"))
    changed = {c: F.col(c) + to.amount * F.col("__times") if isinstance(to, Adding) else F.when(F.col("__times") > 0, to) for c, to in changes.items()}
    return joined.select(*[(F.coalesce(changed[c], F.col(c)) if c in changed else F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")
