"""The engine: sharded tables behind one set of calls.

Every option of a call is a keyword; unknown ones raise TypeError. Options that steer a cluster of
servers (timeouts, replica choice, batch sizes, yields) are checked and have no effect here, as
Spark schedules the work. Reads are lazy: errors of a request are raised when it is made.
"""

from __future__ import annotations

import logging
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .catalog import Catalog, IndexDef, SpaceDef
from .functions.bucket import BUCKETS, bucket_column, integer_bucket, text_column
from .functions.predicates import Operand, compare
from .operators import reader
from .operators.results import Result, cut_objects, cut_rows, flatten, metadata_of, plain, unflatten_rows
from .operators.writer import Change, Placement, State, Writer, apply_operations, check_bucket, check_row, parse_operations
from .plans.conditions import parse
from .plans.planner import SelectPlan, plan
from .sources.store import SHARD, Snapshot, SnapshotStore, shard_of, tag_shard
from .stats import RateLimiter, Settings, Stats, counted

__version__ = "0.2.0"
log = logging.getLogger("shardwell")
#: A scan of all rows of this many or fewer is no reason to warn.
SMALL_FIRST = 1000
#: Pages of more rows are sorted and cut instead of held in a heap by each task.
LARGEST_TOP = 100_000

_ROUTE = frozenset("mode prefer_replica balance request_timeout".split())
_WRITE = frozenset("timeout fields vshard_router noreturn fetch_latest_metadata".split())
_SELECT = frozenset("after first batch_size bucket_id force_map_call fields fullscan fetch_latest_metadata timeout vshard_router yield_every".split())


def _options(given: dict, allowed: frozenset, error=E.EngineError) -> dict:
    for k in given:
        if k not in allowed:
            raise TypeError(f"unexpected option {k!r}")
    for k in ("batch_size", "yield_every"):
        if given.get(k) is not None and given[k] < 1:
            raise error(f"{k} should be > 0")
    if given.get("mode") is not None and given["mode"] not in ("read", "write"):
        raise E.kind("CallError")(f"Unknown call mode: {given['mode']}")
    return given


class Engine:
    _VERSION = __version__

    def __init__(self, spark: SparkSession, root: str | None = None, *, buckets: int = BUCKETS, shards: int = 4, global_unique: bool = False):
        self.spark, self.buckets, self.shards, self.global_unique = spark, buckets, shards, global_unique
        self.catalog = Catalog()
        self.store = SnapshotStore(spark, root) if root else None
        spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", LARGEST_TOP)
        self._sources: dict[str, Callable[[], DataFrame]] = {}
        self._stats = Stats()
        self._limiter = RateLimiter()
        self._views: dict[int, dict[str, Snapshot]] = {}

    # tables

    def create(self, space: SpaceDef) -> SpaceDef:
        """A table kept in snapshots."""
        if self.store is None:
            raise E.SchemaError("an engine without a root folder has no tables of its own")
        return self.catalog.add(space)

    def alter(self, space: SpaceDef) -> SpaceDef:
        """A new format for a table: nullable fields may be appended; old files read NULL there."""
        old = self.catalog.get(space.name)
        if space.names[: len(old.names)] != old.names or any(not f.is_nullable for f in space.fields[len(old.names) :]):
            raise E.SchemaError("only nullable fields can be appended")
        return self.catalog.add(space)

    def attach(self, space: SpaceDef, source: Callable[[], DataFrame] | DataFrame) -> SpaceDef:
        """A read-only table over a DataFrame."""
        self._sources[space.name] = source if callable(source) else lambda: source
        return self.catalog.add(space)

    def _space(self, name: str, error) -> SpaceDef:
        return self.catalog.get(name, error)

    def _bucket(self, space: SpaceDef):
        return F.col(space.bucket_field) if space.has_bucket and space.name not in self._sources else self._computed_bucket(space)

    def _computed_bucket(self, space: SpaceDef):
        kinds = {c: space.schema()[c].dataType.typeName() for c in space.shard_by}
        if space.sharding_func is not None:
            from .functions.bucket import function_of

            f, n, buckets = function_of(space.sharding_func), len(space.shard_by), self.buckets
            two = f.__code__.co_argcount > 1

            @F.pandas_udf("long")
            def custom(rows):
                keys = rows.itertuples(index=False, name=None)
                import pandas as pd

                return pd.Series([f(tuple(k[:n]), buckets) if two else f(tuple(k[:n])) for k in keys])

            return custom(F.struct(*space.shard_by))
        if [*kinds.values()] == ["long"]:
            return integer_bucket(F.col(space.shard_by[0]), self.buckets)
        return bucket_column([text_column(F.col(c), kinds[c]) for c in space.shard_by], self.buckets)

    def _rows(self, space: SpaceDef, shards: set[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Rows of some shards. Of kept tables only these shards' files are read."""
        if space.name in self._sources:
            df = self._sources[space.name]()
            if space.has_bucket and space.bucket_field not in df.columns:
                df = df.withColumn(space.bucket_field, self._bucket(space))
            return df if shards is None else df.filter(shard_of(self._bucket(space), self.shards, self.buckets).isin(sorted(shards)))
        return self.store.read(space.schema(), self.store.snapshot(space.name) if snapshot is None else snapshot, shards)

    def rows(self, space: str) -> DataFrame:
        """All rows, in no order."""
        return self._rows(self.catalog.get(space))

    def _placement(self, space: SpaceDef) -> Placement:
        return Placement(space, self.buckets, self.shards)

    def _route(self, space: SpaceDef, p: SelectPlan, opts: dict) -> set[int] | None:
        """Shards to read: one by bucket or sharding key, else all (None)."""
        bucket = opts.get("bucket_id")
        if bucket is not None:
            check_bucket(bucket)
        elif not opts.get("force_map_call") and p.sharding_key is not None and space.name not in self._sources:
            bucket = self._placement(space).bucket(p.sharding_key)
        return None if bucket is None else {shard_of(bucket, self.shards, self.buckets)}

    def _warn_full_scan(self, space: str, p: SelectPlan, opts: dict, call: str) -> None:
        first = opts.get("first")
        if opts.get("fullscan") or (first is not None and abs(first) <= SMALL_FIRST) or p.operator == "==":
            return
        said, missed = self._limiter.allow()
        if said:
            log.critical("Potentially long %s from space '%s'%s", call, space, f" ({missed} messages held back)" if missed else "")

    # reads

    def _select(self, space_name: str, conditions, opts: dict, snapshot: Snapshot | None = None, quiet: bool = False, ordered: bool = True, seen: Observation | None = None) -> tuple[SelectPlan, DataFrame]:
        space = self._space(space_name, E.SelectError)
        try:
            parsed = parse(conditions)
        except E.ParseConditionError as e:
            raise E.SelectError(f"Failed to parse conditions: {e}") from e
        try:
            p = plan(space, parsed, opts.get("first"), opts.get("after"), opts.get("fields"), opts.get("bucket_id"))
        except (E.NoIndexesError, E.IndexTypeError, E.FilterFieldsError) as e:
            raise E.SelectError(f"Failed to plan select: {e}") from e
        if not quiet:
            self._warn_full_scan(space_name, p, opts, "select")
        shards = self._route(space, p, opts)
        if shards is None:
            self._stats.detail(space_name, map_reduces=1)
        return p, reader.run_select(p, self._rows(space, shards, snapshot), ordered, seen)

    @counted("select")
    def select(self, space: str, conditions=None, **opts) -> Result:
        # a page is one run over the filtered rows; all rows in order are as many as the filters let through
        seen = Observation() if self._stats.settings.stats and opts.get("first") is not None else None
        p, df = self._select(space, conditions, _options(opts, _SELECT | _ROUTE, E.SelectError), seen=seen)
        out = reader.result(p.space, df, p.fields)
        if self._stats.settings.stats:
            out._told = lambda n: self._stats.detail(space, tuples_fetched=n, tuples_lookup=n if seen is None else seen.get["n"])
        return out

    def pairs(self, space: str, conditions=None, *, use_tomap: bool = False, **opts) -> Iterator:
        """Rows one after the other, partitions fetched ahead; objects with use_tomap. Counted when the iteration ends."""
        opts = _options(opts, (_SELECT | _ROUTE) - {"fullscan"}, E.SelectError)
        if opts.get("first") is not None and opts["first"] < 0:
            raise E.SelectError("Negative first isn't allowed for pairs")
        p, df = self._select(space, conditions, opts, quiet=True)
        return self._iterate(space, p, df, use_tomap)

    def _iterate(self, space: str, p: SelectPlan, df: DataFrame, objects: bool) -> Iterator:
        import time

        began, ok, n = time.monotonic(), False, 0
        names = list(p.fields if p.fields is not None else p.space.names)
        try:
            for row in df.toLocalIterator(prefetchPartitions=True):
                n += 1
                values = tuple(map(plain, row))
                yield dict(zip(names, values, strict=True)) if objects else values
            ok = True
        except GeneratorExit:
            ok = True
            raise
        finally:
            self._stats.observe(space, "select", ok, time.monotonic() - began)
            self._stats.detail(space, tuples_fetched=n, tuples_lookup=n)

    @counted("count")
    def count(self, space: str, conditions=None, **opts) -> int:
        return self.count_frame(space, conditions, **opts).head()["cnt"]

    def count_frame(self, space: str, conditions=None, **opts) -> DataFrame:
        """The count as a lazy DataFrame of one row `cnt`."""
        opts = _options(opts, frozenset("timeout bucket_id force_map_call fullscan yield_every vshard_router".split()) | _ROUTE, E.CountError)
        definition = self._space(space, E.CountError)
        try:
            p = plan(definition, parse(conditions), bucket_id=opts.get("bucket_id"))
        except E.ParseConditionError as e:
            raise E.CountError(f"Failed to parse conditions: {e}") from e
        except (E.NoIndexesError, E.IndexTypeError) as e:
            raise E.CountError(f"Failed to plan count: {e}") from e
        self._warn_full_scan(space, p, opts, "count")
        return reader.run_count(p, self._rows(definition, self._route(definition, p, opts)))

    @counted("len")
    def len(self, space: str, **opts) -> int:
        return self.len_frame(space, **opts).head()["cnt"]

    def len_frame(self, space: str, **opts) -> DataFrame:
        _options(opts, frozenset(("timeout", "vshard_router")) | _ROUTE, E.LenError)
        return self._rows(self._space(space, E.LenError)).agg(F.count(F.lit(1)).alias("cnt"))

    def _border(self, space: str, index, largest: bool, opts: dict) -> Result:
        opts = _options(opts, frozenset("timeout request_timeout fields mode vshard_router fetch_latest_metadata".split()), E.BorderError)
        definition = self._space(space, E.BorderError)
        df = reader.run_border(definition, self._rows(definition), reader.border_index(definition, index), largest, opts.get("fields"))
        return reader.result(definition, df, opts.get("fields"))

    @counted("borders")
    def min(self, space: str, index: str | int | None = None, **opts) -> Result:
        return self._border(space, index, False, opts)

    @counted("borders")
    def max(self, space: str, index: str | int | None = None, **opts) -> Result:
        return self._border(space, index, True, opts)

    def _key(self, key) -> tuple:
        return tuple(key) if isinstance(key, (list, tuple)) else (key,)

    @counted("get")
    def get(self, space: str, key, **opts) -> Result:
        opts = _options(opts, frozenset("timeout bucket_id fields vshard_router fetch_latest_metadata".split()) | _ROUTE, E.GetError)
        definition = self._space(space, E.GetError)
        key, shards = self._key(key), None
        if space not in self._sources or opts.get("bucket_id") is not None:
            bucket = self._placement(definition).of_key(key, opts.get("bucket_id"))
            key = self._placement(definition).full_key(key, bucket)
            shards = {shard_of(bucket, self.shards, self.buckets)}
        df = reader.run_get(definition, self._rows(definition, shards), key, opts.get("fields"))
        return reader.result(definition, df, opts.get("fields"))

    @counted("locate")
    def locate(self, space: str, key, **opts) -> dict | None:
        """Shard and file of a key's row, None if there is none."""
        opts = _options(opts, frozenset("timeout bucket_id vshard_router".split()) | _ROUTE, E.LocateError)
        definition = self._space(space, E.LocateError)
        placement = self._placement(definition)
        key = self._key(key)
        bucket = placement.of_key(key, opts.get("bucket_id"))
        shard = placement.shard(bucket)
        attached = space in self._sources
        here = compare("==", [Operand(definition, p, collated=True) for p in definition.primary.parts], placement.full_key(key, bucket))
        row = self._rows(definition, None if attached else {shard}).filter(here).select(F.input_file_name().alias("file")).head()
        return None if row is None else {"shard": shard, "bucket_id": bucket, "file": row["file"]}

    # writes

    def _writer(self, space: str, error) -> tuple[SpaceDef, Writer]:
        definition = self._space(space, error)
        if space in self._sources:
            raise error(f'Space "{space}" is read-only')
        return definition, Writer(self.store, self._placement(definition), self.global_unique)

    def _insert_act(self, w: Writer):
        def act(state, shard, row, more):
            key = w.key(row)
            if (held := state.get((shard, key))) is not None or (w.global_unique and state.by_key.get(key)):
                raise w.duplicate(w.space.primary.name, held or row)
            if (index := w.clash(state, shard, row, None)) is not None:
                raise w.duplicate(index, row)
            return row

        return act

    def _replace_act(self, w: Writer):
        def act(state, shard, row, more):
            if (index := w.clash(state, shard, row, w.key(row))) is not None:
                raise w.duplicate(index, row)
            return row

        return act

    def _upsert_act(self, w: Writer):
        def act(state, shard, row, operations):
            old = state.get((shard, w.key(row)))
            new = row if old is None else check_row(w.space, apply_operations(w.space, old, operations))
            if (index := w.clash(state, shard, new, w.key(new))) is not None:
                raise w.duplicate(index, new)
            return new

        return act

    def _write(self, space: str, rows: list, make, opts: dict, error, *, more=None, many: bool = False):
        """Settle rows and commit. A single row's error is raised; a batch gives (result, errors)."""
        definition, w = self._writer(space, error)
        snapshot = self.store.snapshot(space)
        metadata_of(definition, opts.get("fields"))
        items, errors = [], []
        for n, row in enumerate(rows):
            try:
                own = check_row(definition, list(row))
                bucket = w.placement.of_row(own, opts.get("bucket_id"))
                items.append((w.placement.shard(bucket), own, more[n] if more else None))
            except E.EngineError as e:
                if not many:
                    raise
                if opts.get("stop_on_error"):
                    return None, [e.about(row)]
                errors.append(e.about(row))
        good, more_errors, change = w.settle(items, make(w), bool(opts.get("stop_on_error")), bool(opts.get("rollback_on_error")), snapshot)
        errors += more_errors
        if errors and not many:
            raise errors[0]
        w.commit(snapshot, change)
        return good, errors

    def _given(self, definition: SpaceDef, good: list[list], opts: dict) -> Result:
        names = list(opts["fields"]) if opts.get("fields") is not None else definition.names
        at = [definition.names.index(n) for n in names]
        return Result(metadata_of(definition, opts.get("fields")), rows=[] if opts.get("noreturn") else [tuple(r[i] for i in at) for r in good])

    def _single(self, space, row, make, opts, error, more=None, silent=False) -> Result | None:
        good, _ = self._write(space, [row], make, opts, error, more=more)
        if opts.get("noreturn"):
            return None
        return self._given(self.catalog.get(space), [] if silent else good, opts)

    def _many(self, space, rows, make, opts, error, what, more=None, silent=False):
        if not rows:
            raise error(f"At least one {what} expected")
        good, errors = self._write(space, list(rows), make, opts, error, more=more, many=True)
        if errors and not good:
            return None, errors
        if opts.get("noreturn"):
            return None, errors or None
        return self._given(self.catalog.get(space), [] if silent else good, opts), errors or None

    def _flat(self, space, objects, opts, error, many: bool):
        """Objects as rows; a bad one is an error of its own in a batch, or the end of it."""
        definition, rows, at, errors = self.catalog.get(space, error), [], [], []
        for n, o in enumerate(objects):
            try:
                rows.append(flatten(o, definition, opts.get("bucket_id"), bool(opts.get("skip_nullability_check_on_flatten"))))
                at.append(n)
            except E.FlattenError as e:
                e = error(f"Failed to flatten object: {e}", operation_data=o)
                if not many:
                    raise e from None
                errors.append(e)
                if opts.get("stop_on_error"):
                    break
        return rows, at, errors

    def _many_objects(self, space, objects, call, opts, error, more=None):
        if not objects:
            raise error("At least one object expected")
        rows, at, errors = self._flat(space, objects, opts, error, many=True)
        if errors and (opts.get("stop_on_error") or not rows):
            return None, errors
        given = {k: v for k, v in opts.items() if k != "skip_nullability_check_on_flatten"}
        result, late = call(space, rows if more is None else [(r, more[n]) for r, n in zip(rows, at, strict=True)], **given)
        return result, (errors + (late or [])) or None

    _ONE = _WRITE | {"bucket_id", "add_space_schema_hash"}
    _BATCH = _WRITE | {"add_space_schema_hash", "stop_on_error", "rollback_on_error"}
    _SKIP = frozenset({"skip_nullability_check_on_flatten"})

    @counted("insert")
    def insert(self, space: str, row, **opts) -> Result | None:
        return self._single(space, row, self._insert_act, _options(opts, self._ONE), E.InsertError)

    def insert_object(self, space: str, obj: dict, **opts) -> Result | None:
        opts = _options(opts, self._ONE | self._SKIP)
        rows, _, _ = self._flat(space, [obj], opts, E.InsertError, many=False)
        return self.insert(space, rows[0], **{k: v for k, v in opts.items() if k not in self._SKIP})

    @counted("insert_many")
    def insert_many(self, space: str, rows, **opts):
        return self._many(space, rows, self._insert_act, _options(opts, self._BATCH), E.InsertManyError, "tuple")

    def insert_object_many(self, space: str, objects, **opts):
        return self._many_objects(space, objects, self.insert_many, _options(opts, self._BATCH | self._SKIP), E.InsertManyError)

    @counted("replace")
    def replace(self, space: str, row, **opts) -> Result | None:
        return self._single(space, row, self._replace_act, _options(opts, self._ONE), E.ReplaceError)

    def replace_object(self, space: str, obj: dict, **opts) -> Result | None:
        opts = _options(opts, self._ONE | self._SKIP)
        rows, _, _ = self._flat(space, [obj], opts, E.ReplaceError, many=False)
        return self.replace(space, rows[0], **{k: v for k, v in opts.items() if k not in self._SKIP})

    @counted("replace_many")
    def replace_many(self, space: str, rows, **opts):
        return self._many(space, rows, self._replace_act, _options(opts, self._BATCH), E.ReplaceManyError, "tuple")

    def replace_object_many(self, space: str, objects, **opts):
        return self._many_objects(space, objects, self.replace_many, _options(opts, self._BATCH | self._SKIP), E.ReplaceManyError)

    @counted("upsert")
    def upsert(self, space: str, row, operations, **opts) -> Result | None:
        opts = _options(opts, self._ONE)
        parsed = parse_operations(self.catalog.get(space, E.UpsertError), operations)
        return self._single(space, row, self._upsert_act, opts, E.UpsertError, more=[parsed], silent=True)

    def upsert_object(self, space: str, obj: dict, operations, **opts) -> Result | None:
        opts = _options(opts, self._ONE)
        rows, _, _ = self._flat(space, [obj], opts, E.UpsertError, many=False)
        return self.upsert(space, rows[0], operations, **opts)

    @counted("upsert_many")
    def upsert_many(self, space: str, items, **opts):
        opts = _options(opts, self._BATCH)
        if not items:
            raise E.UpsertManyError("At least one tuple expected")
        definition = self.catalog.get(space, E.UpsertManyError)
        parsed = [parse_operations(definition, ops) for _, ops in items]
        return self._many(space, [r for r, _ in items], self._upsert_act, opts, E.UpsertManyError, "tuple", more=parsed, silent=True)

    def upsert_object_many(self, space: str, items, **opts):
        return self._many_objects(space, [o for o, _ in items], self.upsert_many, _options(opts, self._BATCH | self._SKIP), E.UpsertManyError, more=[ops for _, ops in items])

    def _touch(self, space: str, key, opts: dict, error):
        definition, w = self._writer(space, error)
        key = self._key(key)
        bucket = w.placement.of_key(key, opts.get("bucket_id"))
        key = w.placement.full_key(key, bucket)
        shard, snapshot = w.placement.shard(bucket), self.store.snapshot(space)
        before = w.touched(snapshot, {shard}, [], [key])
        return definition, w, snapshot, (shard, key), before

    @counted("update")
    def update(self, space: str, key, operations, **opts) -> Result | None:
        opts = _options(opts, _WRITE | {"bucket_id"})
        parsed = parse_operations(self.catalog.get(space, E.UpdateError), operations)
        definition, w, snapshot, at, before = self._touch(space, key, opts, E.UpdateError)
        good = []
        if at in before:
            row = check_row(definition, apply_operations(definition, before[at], parsed))
            state = State(w, before | w.touched(snapshot, {at[0]}, [row], []))
            if (index := w.clash(state, at[0], row, at[1])) is not None:
                raise w.duplicate(index, row)
            w.commit(snapshot, Change({at: row}, {at}))
            good = [row]
        return None if opts.get("noreturn") else self._given(definition, good, opts)

    @counted("delete")
    def delete(self, space: str, key, **opts) -> Result | None:
        opts = _options(opts, _WRITE | {"bucket_id"})
        definition, w, snapshot, at, before = self._touch(space, key, opts, E.DeleteError)
        if at in before:
            w.commit(snapshot, Change({at: None}, {at}))
        return None if opts.get("noreturn") else self._given(definition, [before[at]] if at in before else [], opts)

    @counted("truncate")
    def truncate(self, space: str, **opts) -> bool:
        _options(opts, frozenset(("timeout", "vshard_router")))
        self._writer(space, E.TruncateError)
        self.store.commit(space, self.store.snapshot(space), {})
        return True

    def load(self, space: str, rows: DataFrame, *, check: bool = True) -> None:
        """Take in a whole DataFrame of new rows: buckets, one shuffle by shard, files, one snapshot. Keys that are there or repeat are an error; check=False leaves them unlooked at."""
        definition, w = self._writer(space, E.InsertManyError)
        if definition.has_bucket and definition.bucket_field not in rows.columns:
            rows = rows.select(*[F.col(c).cast(definition.schema()[c].dataType).alias(c) if definition.field(c) else F.col(c) for c in rows.columns])
            rows = rows.withColumn(definition.bucket_field, self._computed_bucket(definition))
        bucket = F.col(definition.bucket_field) if definition.has_bucket else self._bucket(definition)
        cast = [F.col(f.name).cast(f.data_type).alias(f.name) for f in definition.fields]
        sharded = rows.withColumn("__shard", shard_of(bucket, self.shards, self.buckets)).select(*cast, "__shard").repartition("__shard", definition.primary.parts[0].field)
        snapshot = self.store.snapshot(space)
        if check:
            self._check_keys(definition, w, sharded, snapshot)
        files = {s: list(f) for s, f in snapshot.files.items()}
        for shard, names in self.store.write_files(space, sharded, [p.field for p in definition.primary.parts]).items():
            files.setdefault(shard, []).extend(names)
        self.store.commit(space, snapshot, files)

    def _check_keys(self, definition: SpaceDef, w: Writer, rows: DataFrame, snapshot: Snapshot) -> None:
        """Each unique index of new rows, by shard unless keys are unique everywhere: one shuffle for each index, one row to the driver."""
        there = tag_shard(self.store.read(definition.schema(), snapshot))
        for index in [definition.primary, *w.unique]:
            names = [SHARD] * (not self.global_unique) + [p.field for p in index.parts]
            some = rows.select(*names).union(there.select(*names)).dropna().groupBy(*names).count().filter("count > 1").drop(SHARD, "count").head()
            if some is not None:
                raise w.duplicate(index.name, list(some))

    # read views

    def readview(self, *, name: str | None = None, timeout: float | None = None) -> ReadView:
        return ReadView(self, name)

    # client helpers

    cut_rows, cut_objects, unflatten_rows = staticmethod(cut_rows), staticmethod(cut_objects), staticmethod(unflatten_rows)

    # statistics and settings

    def cfg(self, **new) -> Settings:
        if new:
            if {"stats", "stats_driver"} & new.keys() and (new.get("stats_driver", self._stats.settings.stats_driver) != self._stats.settings.stats_driver or new.get("stats") is False):
                self._stats.reset()
            self._stats.settings = self._stats.settings.changed(**new)
        return self._stats.settings

    def stats(self, space: str | None = None) -> dict:
        return self._stats.view(space)

    def reset_stats(self) -> bool:
        self._stats.reset()
        return True

    # introspection

    def schema(self, space: str | None = None, *, vshard_router=None, timeout=None, cached: bool = False) -> dict:
        """Formats and indexes as users see them: the bucket field may be left out, its index is not shown, nor are tables whose names begin with an underscore."""

        def one(s: SpaceDef) -> dict:
            form = [f.describe() | ({"is_nullable": True} if f.name == s.bucket_field else {}) for f in s.fields]
            shown = {k: i for k, i in sorted(s.indexes.items()) if i.name != s.bucket_field or k == 0}
            return {"format": form, "indexes": {k: self._describe(s, i) for k, i in shown.items()}}

        if space is not None:
            if space.startswith("_"):
                raise E.SchemaError(f'Space "{space}" doesn\'t exist')
            return one(self._space(space, E.SchemaError))
        return {n: one(s) for n, s in self.catalog.spaces.items() if not n.startswith("_")}

    @staticmethod
    def _describe(space: SpaceDef, index: IndexDef) -> dict:
        parts = [{"fieldno": space.names.index(p.field) + 1, "type": p.type or space.field(p.field).type, "is_nullable": space.nullable(p), "exclude_null": False} | ({"collation": p.collation} if p.collation else {}) | ({"path": p.path} if p.path else {}) for p in index.parts]
        return {"name": index.name, "type": index.type, "unique": index.unique, "parts": parts}

    def storage_info(self, *, timeout=None, vshard_router=None) -> dict:
        """Shards with their status and how many files and rows of each table they hold. Rows are counted from the files' footers, one small job for each table."""
        out = {s: {"status": "running" if self.store else "uninitialized", "is_master": True, "files": {}, "rows": {}} for s in range(1, self.shards + 1)}
        for name in self.catalog.spaces if self.store else ():
            if name not in self._sources:
                try:
                    snapshot = self.store.snapshot(name)
                    for shard, files in snapshot.files.items():
                        out[shard]["files"][name] = len(files)
                    for row in tag_shard(self.store.read(self.catalog.get(name).schema(), snapshot)).groupBy(SHARD).count().collect():  # a row for each shard
                        out[row[SHARD]]["rows"][name] = row["count"]
                except Exception as e:  # a shard's state is an answer, not a failure
                    for v in out.values():
                        v |= {"status": "error", "message": str(e)}
        return out

    def router_cache_clear(self) -> bool:
        """Nothing is cached: the catalog is read by each call."""
        return True

    def safe_mode_status(self) -> bool:
        """Buckets never move here, so writes need no checks of where a bucket is."""
        return False

    def safe_mode_enable(self) -> bool:
        return False

    def safe_mode_disable(self) -> bool:
        return False

    def init_router(self) -> None:
        """The engine is ready when it is made; these four are there for callers that begin and end roles."""

    stop_router = init_storage = stop_storage = init_router

    def vacuum(self, space: str) -> int:
        """Remove files that neither the newest version nor an open read view needs."""
        return self.store.vacuum(space, {v[space].version for v in self._views.values() if space in v})


class ReadView:
    """A frozen state of all kept tables, the same moment for all shards."""

    def __init__(self, engine: Engine, name: str | None):
        self._engine, self.name, self.closed = engine, name, False
        engine._views[id(self)] = {n: engine.store.snapshot(n) for n in engine.catalog.spaces if n not in engine._sources}
        self._end = weakref.finalize(self, engine._views.pop, id(self), None)

    def _snapshot(self, space: str) -> Snapshot | None:
        if self.closed:
            raise E.ReadviewError("Read view is closed")
        return self._engine._views[id(self)].get(space)

    def _opts(self, opts: dict, allowed: frozenset) -> dict:
        for k in ("balance", "mode", "prefer_replica", "request_timeout", "vshard_router"):
            if opts.get(k) is not None:
                raise E.SelectError(f"Readview does not support '{k}' option")
        return _options(opts, allowed, E.SelectError)

    def select(self, space: str, conditions=None, **opts) -> Result:
        snapshot = self._snapshot(space)
        p, df = self._engine._select(space, conditions, self._opts(opts, _SELECT), snapshot)
        return reader.result(p.space, df, p.fields)

    def pairs(self, space: str, conditions=None, *, use_tomap: bool = False, **opts) -> Iterator:
        snapshot = self._snapshot(space)
        opts = self._opts(opts, _SELECT - {"fullscan"})
        if opts.get("first") is not None and opts["first"] < 0:
            raise E.SelectError("Negative first isn't allowed for pairs")
        p, df = self._engine._select(space, conditions, opts, snapshot, quiet=True)
        return self._engine._iterate(space, p, df, use_tomap)

    def close(self, *, timeout: float | None = None) -> None:
        self.closed = True
        self._end()
