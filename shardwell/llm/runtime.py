"""Session settings, shared storage and the registry of this package's queries."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows in an Arrow batch. Texts have no bound of their own, so batches are also re-cut by bytes in `textkit.pieces`.
BATCH_ROWS = 1024
_shipped: dict[str, bool] = {}
_folders: set[str] = set()
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its DuckDB form where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, as rows hold whole documents, and send this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(), f"{top.name}-{app}.zip")  # Spark's file server hands it out
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
        _shipped[app] = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: the machine's own, if the master is local, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, what: str, narrow: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Survives the loss of any executor.

    narrow: rows of a few numbers, written by as many tasks as there are cores at most. On a local file
    system each file costs an executor a process, which shows the executor's memory a second time.

    Results are lazy and read these tables, so they go with the application: all stand under one folder
    of it, removed when the driver's Python ends in an orderly way; `sweep` removes them sooner.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"
    (df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if narrow else df).write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession):
    """Tables written inside are removed at the end, but for those whose frame is handed to the function given as soon as it is written."""
    made: list[str] = []
    kept: set[str] = set()
    before = _made.set(made)
    try:
        yield lambda df: kept.add(made[-1]) or df
    finally:
        _made.reset(before)
        for path in made:
            if path not in kept:
                _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/shardwell-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(sweep, spark, path)
    return path


def sweep(spark: SparkSession, path: str | None = None) -> None:
    """Remove the tables that this application has written between its steps. Results that read them must have been used."""
    path = path or _folder(spark)
    with contextlib.suppress(Exception):  # at the end of the process the session may be gone
        _remove(spark, path)
        _folders.discard(path)


def map_rows(docs: DataFrame, go, added: tuple[T.StructField, ...] = ()) -> DataFrame:
    """mapInArrow over rows that keep their columns, whatever their names (dots too), with `added` ones after them."""
    names = docs.columns
    safe = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(s, f.dataType) for s, f in zip(safe, docs.schema.fields, strict=True)]
    renamed = lambda batch, to: pa.RecordBatch.from_arrays(batch.columns, to)
    after = [*safe, *(f.name for f in added)]

    def named(batches):
        for out in go(renamed(b, names) for b in batches):
            yield renamed(out, after)

    return docs.toDF(*safe).mapInArrow(named, T.StructType([*fields, *added])).toDF(*names, *(f.name for f in added))


def width(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
