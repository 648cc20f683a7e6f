"""Request-sized writes: rows that a client sends, resolved against the rows they touch, one snapshot for each call.

A batch is in the driver's memory already, as the client sent it. Of the table only rows with its
primary or unique keys are fetched. Each shard's rows are settled in order, as outcomes depend on the
rows before; then new rows become new files, and files that hold changed or deleted rows are written
anew without them.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import SpaceDef
from ..errors import BucketIDError, EngineError, NotPerformedError, ParseOperationsError, ShardingKeyError
from ..functions.bucket import function_of
from ..sources.store import SHARD, Snapshot, SnapshotStore, shard_of

STOPPED = "Operation with tuple was not performed"
ROLLED_BACK = "Operation with tuple was rollback"


def check_bucket(bucket_id, where: str = "opts") -> None:
    if isinstance(bucket_id, bool) or not isinstance(bucket_id, int) or bucket_id < 1:
        raise BucketIDError(f"Invalid bucket_id in {where}: expected unsigned, got {'nil' if bucket_id is None else {'int': 'number', 'float': 'number', 'str': 'string', 'bool': 'boolean'}.get(type(bucket_id).__name__, type(bucket_id).__name__)}")


@dataclass
class Placement:
    """Buckets and shards of rows and keys."""

    space: SpaceDef
    buckets: int
    shards: int

    def bucket(self, key: tuple) -> int:
        f = function_of(self.space.sharding_func)
        return f(key, self.buckets) if f.__code__.co_argcount > 1 else f(key)

    def shard(self, bucket: int) -> int:
        return shard_of(bucket, self.shards, self.buckets)

    def of_row(self, row: list, bucket_id: int | None) -> int:
        """The row's bucket, put into its bucket field where there is one."""
        at = self.space.names.index(self.space.bucket_field) if self.space.has_bucket else None
        own = row[at] if at is not None else None
        if own is not None:
            check_bucket(own, "data")
        if bucket_id is not None:
            check_bucket(bucket_id)
            if own is not None and own != bucket_id:
                raise BucketIDError(f"Tuple and opts.bucket_id contain different bucket_id values: {own} and {bucket_id}")
        bucket = own or bucket_id or self.bucket(tuple(row[self.space.names.index(f)] for f in self.space.shard_by))
        if at is not None:
            row[at] = bucket
        return bucket

    def of_key(self, key: tuple, bucket_id: int | None) -> int:
        if bucket_id is not None:
            check_bucket(bucket_id)
            return bucket_id
        named = dict(zip((p.field for p in self.space.primary.parts), key, strict=False))
        if self.space.bucket_field in named and named[self.space.bucket_field] is not None:
            return named[self.space.bucket_field]
        if any(f not in named for f in self.space.shard_by):
            raise ShardingKeyError(f'Sharding key for space "{self.space.name}" is missed in primary index, specify bucket_id')
        return self.bucket(tuple(named[f] for f in self.space.shard_by))

    def full_key(self, key: tuple, bucket: int) -> tuple:
        """A bucket that leads the primary key may be left as None."""
        return tuple(bucket if p.field == self.space.bucket_field and v is None else v for p, v in zip(self.space.primary.parts, key, strict=True))


def parse_operations(space: SpaceDef, operations) -> list[tuple[str, int, object]]:
    if not isinstance(operations, (list, tuple)):
        raise ParseOperationsError("Operations should be table")
    out = []
    for op in operations:
        if not isinstance(op, (list, tuple)) or len(op) != 3:
            raise ParseOperationsError("Operation should be a list of operator, field and value")
        sign, name, value = op
        if isinstance(name, bool) or not isinstance(name, (int, str)):
            raise ParseOperationsError("Field of an operation should be a name or a number")
        at = name - 1 if isinstance(name, int) and name > 0 else len(space.fields) + name if isinstance(name, int) else next((i for i, f in enumerate(space.names) if f == name), -1)
        if not 0 <= at < len(space.fields):
            raise ParseOperationsError(f'Space format doesn\'t contain field named "{name}"')
        if sign not in ("=", "+", "-", "&", "|", "^", "!", "#"):
            raise ParseOperationsError(f"Unknown UPDATE operation {sign}")
        out.append((sign, at, value))
    return out


def apply_operations(space: SpaceDef, row: list, operations: list[tuple[str, int, object]]) -> list:
    """`=`, `+`, `-` as the reference shows them; bit operations are an extension, `!` and `#` set and clear a field."""
    row = list(row)
    keys = {p.field for p in space.primary.parts}
    for sign, at, value in operations:
        f = space.fields[at]
        if f.name in keys:
            raise EngineError(f"Attempt to modify a tuple field which is part of primary index '{space.primary.name}' in space '{space.name}'", class_name="UpdateError")
        if sign in ("=", "!"):
            row[at] = value
        elif sign == "#":
            row[at] = None
        else:
            if isinstance(row[at], bool) or not isinstance(row[at], (int, float, decimal.Decimal)):
                raise EngineError(f"Argument type in operation '{sign}' on field '{f.name}' does not match field type: expected a number", class_name="UpdateError")
            row[at] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b}[sign](row[at], value)
    return row


_PYTHON = {"unsigned": int, "integer": int, "number": (int, float, decimal.Decimal), "double": (int, float), "string": str, "uuid": str, "boolean": bool, "decimal": (int, float, decimal.Decimal)}


def check_row(space: SpaceDef, row: list) -> list:
    if len(row) > len(space.fields):
        raise EngineError(f"Tuple field count {len(row)} does not match space field count {len(space.fields)}", class_name="TupleError")
    row = [*row, *[None] * (len(space.fields) - len(row))]
    for n, (f, v) in enumerate(zip(space.fields, row, strict=True), 1):
        if v is None:
            if not f.is_nullable and f.name != space.bucket_field:
                raise EngineError(f"Tuple field {n} ({f.name}) type does not match one required by operation: expected {f.type}, got nil", class_name="TupleError")
            continue
        want = _PYTHON.get(f.type) if f.spark_type is None else None
        bad = want and (not isinstance(v, want) or (isinstance(v, bool) and want is not bool))
        if bad or (f.type == "unsigned" and v < 0):
            raise EngineError(f"Tuple field {n} ({f.name}) type does not match one required by operation: expected {f.type}, got {type(v).__name__}", class_name="TupleError")
    return row


@dataclass
class Change:
    """What a call does to the table: rows gone by (shard, key), rows new or changed."""

    rows: dict[tuple, list] = field(default_factory=dict)  # (shard, key) -> row, or None for gone
    old: set[tuple] = field(default_factory=set)  # of these, those that are in the snapshot


def typed(values, names, schema: T.StructType) -> tuple:
    """Values as the columns of these names take them."""
    out = []
    for f, v in zip(names, values, strict=False):
        if v is not None and isinstance(schema[f].dataType, T.DoubleType):
            v = float(v)
        elif v is not None and isinstance(schema[f].dataType, T.DecimalType):
            v = decimal.Decimal(str(v))
        out.append(v)
    return tuple(out)


class State(dict):
    """Rows by (shard, key), and who holds which values of each unique index."""

    def __init__(self, writer: Writer, rows: dict[tuple, list]):
        super().__init__()
        self.everywhere = writer.global_unique
        self.at = [[writer.space.names.index(p.field) for p in i.parts] for i in writer.unique]
        self.held: list[dict[tuple, set]] = [{} for _ in self.at]
        self.by_key: dict[tuple, set] = {}
        for k, row in rows.items():
            self[k] = row

    def _values(self, n: int, shard: int, row: list) -> tuple | None:
        values = tuple(row[i] for i in self.at[n])
        return None if any(v is None for v in values) else (None if self.everywhere else shard, *values)

    def __setitem__(self, at: tuple, row: list | None) -> None:
        old = self.get(at)
        for kind, put in ((old, False), (row, True)):
            if kind is None:
                continue
            for n, held in enumerate(self.held):
                if (v := self._values(n, at[0], kind)) is not None:
                    holders = held.setdefault(v, set())
                    holders.add(at) if put else holders.discard(at)
            holders = self.by_key.setdefault(at[1], set())
            holders.add(at[0]) if put else holders.discard(at[0])
        super().__setitem__(at, row)

    def others(self, n: int, shard: int, row: list, own: tuple | None) -> bool:
        """Whether a row other than `own` has this row's values in unique index n."""
        v = self._values(n, shard, row)
        return v is not None and any(k != own for _, k in self.held[n].get(v, ()))


class Writer:
    def __init__(self, store: SnapshotStore, placement: Placement, global_unique: bool = False):
        self.store, self.placement, self.space, self.global_unique = store, placement, placement.space, global_unique
        self.key_at = [self.space.names.index(p.field) for p in self.space.primary.parts]
        self.unique = [i for k, i in sorted(self.space.indexes.items()) if k and i.unique and i.type == "TREE"]

    def key(self, row) -> tuple:
        return tuple(row[i] for i in self.key_at)

    def touched(self, snapshot: Snapshot, shards: set[int], rows: list[list], keys: list[tuple]) -> dict[tuple, list]:
        """Rows of the snapshot that share a primary or unique key with the request."""
        df = self.store.read(self.space.schema(), snapshot, None if self.global_unique else shards)
        if not snapshot.of(None if self.global_unique else shards):
            return {}
        wanted = None
        names = [p.field for p in self.space.primary.parts]
        spark, schema = self.store.spark, self.space.schema()
        sets = [(names, list(dict.fromkeys([*keys, *(self.key(r) for r in rows)])))]
        sets += [([p.field for p in i.parts], list(dict.fromkeys(tuple(r[self.space.names.index(p.field)] for p in i.parts) for r in rows))) for i in self.unique if rows]
        for fields, values in sets:
            values = [v for v in values if all(x is not None for x in v)]
            if not values:
                continue
            if len(fields) == 1:  # a plain list reaches the files' statistics
                one = df.filter(F.col(fields[0]).isin([v[0] for v in values]))
            else:
                held = spark.createDataFrame([typed(v, fields, schema) for v in values], T.StructType([schema[f] for f in fields]))
                one = df.join(F.broadcast(held), fields, "left_semi").select(*schema.names)  # the request's own keys
            wanted = one if wanted is None else wanted.unionByName(one)
        if wanted is None:
            return {}
        out = {}
        for r in wanted.collect():  # as many as keys in the request, at most
            row = [r[n] for n in self.space.names]
            out[self.placement.shard(self._bucket(row)), self.key(row)] = row
        return out

    def _bucket(self, row: list) -> int:
        return self.placement.of_row(list(row), None)

    def clash(self, state: State, shard: int, row: list, own: tuple | None) -> str | None:
        """Name of a unique secondary index that another row of the shard holds already."""
        for n, index in enumerate(self.unique):
            if state.others(n, shard, row, own):
                return index.name
        return None

    def duplicate(self, index: str, row: list) -> EngineError:
        return EngineError(f'Duplicate key exists in unique index "{index}" in space "{self.space.name}" with new tuple - {list(row)}', class_name="DuplicateKeyError")

    def commit(self, snapshot: Snapshot, change: Change) -> None:
        if not change.rows:
            return
        files = {s: list(f) for s, f in snapshot.files.items()}
        stale = {k for k in change.rows if k in change.old}
        if stale:
            self._rewrite(snapshot, files, stale)
        new = [(*row, shard) for (shard, _), row in change.rows.items() if row is not None]
        if new:
            schema = T.StructType([*self.space.schema().fields, T.StructField(SHARD, T.IntegerType())])
            self._add(files, self.store.spark.createDataFrame([self._typed(r) for r in new], schema).coalesce(1))
        self.store.commit(self.space.name, snapshot, {k: tuple(v) for k, v in files.items()})

    def _typed(self, row: tuple) -> tuple:
        return (*typed(row[:-1], self.space.names, self.space.schema()), row[-1])

    def _add(self, files: dict[int, list[str]], rows: DataFrame) -> None:
        for shard, names in self.store.write_files(self.space.name, rows, [p.field for p in self.space.primary.parts]).items():
            files.setdefault(shard, []).extend(names)

    def _rewrite(self, snapshot: Snapshot, files: dict[int, list[str]], stale: set[tuple]) -> None:
        """Write those files anew that hold stale rows, without them; other files stay as they are."""
        names = [p.field for p in self.space.primary.parts]
        spark, schema = self.store.spark, self.space.schema()
        kinds = T.StructType([T.StructField(SHARD, T.IntegerType()), *[schema[n] for n in names]])
        gone = F.broadcast(spark.createDataFrame([(s, *typed(k, names, schema)) for s, k in sorted(stale, key=str)], kinds))  # the request's own keys
        tagged = lambda df: df.select("*", F.regexp_extract("_metadata.file_path", rf"{SHARD}=(\d+)/", 1).cast("int").alias(SHARD), F.col("_metadata.file_path").alias("__file"))
        mine = self.store.read(schema, snapshot, {s for s, _ in stale})
        if len(names) == 1:  # a plain list reaches the files' statistics
            mine = mine.filter(F.col(names[0]).isin([k[0] for _, k in stale]))
        hit = tagged(mine).join(gone, [SHARD, *names], "left_semi").select("__file").distinct().collect()  # files, not rows
        short = lambda f: f.split(":", 1)[-1].lstrip("/")
        hit = {short(r[0]) for r in hit}
        touched = [f for fs in files.values() for f in fs if short(f) in hit]
        for shard, fs in files.items():
            files[shard] = [f for f in fs if short(f) not in hit]
        if touched:
            left = tagged(spark.read.schema(schema).parquet(*touched)).join(gone, [SHARD, *names], "left_anti").drop("__file")
            self._add(files, left.repartition(SHARD))

    # settling a batch

    def settle(self, items: list[tuple[int, list, object]], act, stop: bool, rollback: bool, snapshot: Snapshot):
        """items: (shard, row, more) in order. act(state, shard, row, more) -> row or raises. Returns (good rows, errors, change)."""
        shards = {s for s, _, _ in items}
        before = self.touched(snapshot, shards, [r for _, r, _ in items], [])
        change, good, errors = Change(old=set(before)), {}, []
        for shard in sorted(shards):
            mine = [(n, r, more) for n, (s, r, more) in enumerate(items) if s == shard]
            state = State(self, {k: v for k, v in before.items() if k[0] == shard or self.global_unique})
            done: list[tuple[int, list]] = []
            own_errors: list[EngineError] = []
            for place, (n, row, more) in enumerate(mine):
                try:
                    new = act(state, shard, row, more)
                except EngineError as e:
                    own_errors.append(e.about(row))
                    if stop:
                        own_errors += [NotPerformedError(STOPPED, operation_data=r) for _, r, _ in mine[place + 1 :]]
                        break
                    continue
                state[shard, self.key(new)] = new
                done.append((n, new))
            if own_errors and rollback:
                own_errors += [NotPerformedError(ROLLED_BACK, operation_data=r) for _, r in done]
                done = []
            else:
                for n, new in done:
                    change.rows[shard, self.key(new)] = new
                    good[n] = new
            errors += own_errors
        return [good[n] for n in sorted(good)], errors, change
