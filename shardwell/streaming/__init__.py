"""No stream operator is asked for: tables change by calls, and each call is one snapshot.

`changes` gives a table's versions as a plain difference of snapshots, for consumers that poll.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine


def changes(engine: Engine, space: str, since: int, until: int | None = None) -> DataFrame:
    """Rows that came (`change` = +1) and went (-1) between two versions. Files that both versions hold are not read."""
    definition = engine.catalog.get(space)
    old, new = engine.store.snapshot(space, since), engine.store.snapshot(space, until)
    have_old, have_new = set(old.of()), set(new.of())
    read = lambda files: engine.spark.read.schema(definition.schema()).parquet(*sorted(files)) if files else engine.spark.createDataFrame([], definition.schema())
    came, went = read(have_new - have_old), read(have_old - have_new)
    plus, minus = came.exceptAll(went), went.exceptAll(came)
    return plus.withColumn("change", F.lit(1)).unionByName(minus.withColumn("change", F.lit(-1)))
