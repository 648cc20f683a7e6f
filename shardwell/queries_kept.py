"""Kept tables as queries: loads, writes, batch policies, read views, sharding and introspection, each with its DuckDB form.

Each query makes a table of its own from one of the driver's tables, in the folder that driver and
executors share, does its calls, and returns what the table or the calls give.
"""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .catalog import FieldDef, IndexDef, Part, SpaceDef
from .engine import Engine, log
from .functions.bucket import TABLE, register
from .operators.results import flatten
from .sources.tables import SPACES, engine_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 4


def scratch(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir says; the machine's own only where the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/kept-{uuid.uuid4().hex}"


def _add(name: str, oracle: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return keep


# suppliers, customers and orders as kept tables

_FIELDS = [("id", "unsigned"), ("bucket_id", "unsigned"), ("name", "string"), ("nation", "integer"), ("balance", "number", True)]
_BY_ID = [IndexDef.on("id", "id"), IndexDef.on("bucket_id", "bucket_id", unique=False), IndexDef.on("nation", "nation", unique=False)]
SUPPLIERS = SpaceDef.of("suppliers", _FIELDS, _BY_ID)
S = "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier"
SHOWN = ["id", "name", "nation", "balance"]


def suppliers(spark, sf: str, space: SpaceDef = SUPPLIERS, **more) -> Engine:
    """An engine with all suppliers in a kept table of four shards."""
    engine = Engine(spark, scratch(spark), shards=SHARDS, **more)
    engine.create(space)
    rows = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance")
    engine.load(space.name, rows)
    return engine


def table(engine: Engine, name: str = "suppliers") -> DataFrame:
    return engine.rows(name).select(*SHOWN)


def frame(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def crc(text: str) -> str:
    """DuckDB: the default sharding function's CRC of a text of ASCII letters, with the table spelled out."""
    return f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor({TABLE}[(xor(a, b) & 255) + 1], a >> 8))"


def bucket(text: str) -> str:
    return f"CAST({crc(text)} % 3000 + 1 AS BIGINT)"


def shard(text: str) -> str:
    return f"(least(CAST(floor(({bucket(text)} - 1) * {SHARDS} / 3000) AS BIGINT), {SHARDS - 1}) + 1)"


_ID = "CAST(id AS VARCHAR)"

# loads and single writes


@_add("kept_load", f"SELECT *, {bucket(_ID)} AS bucket_id FROM ({S})")
def kept_load(spark, sf):
    return suppliers(spark, sf).rows("suppliers").select(*SHOWN, "bucket_id")


@_add("insert", f"{S} UNION ALL SELECT 1000001, 'New One', 3, 10.5")
def insert(spark, sf):
    e = suppliers(spark, sf)
    e.insert("suppliers", [1000001, None, "New One", 3, 10.5])
    return table(e)


@_add("insert_object", f"{S} UNION ALL SELECT 1000001, 'New One', 3, NULL")
def insert_object(spark, sf):
    e = suppliers(spark, sf)
    e.insert_object("suppliers", {"id": 1000001, "name": "New One", "nation": 3})
    return table(e)


@_add("replace", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Other' ELSE s_name END AS name, CASE WHEN s_suppkey = 3 THEN 9 ELSE s_nationkey END AS nation, CASE WHEN s_suppkey = 3 THEN 1.5 ELSE s_acctbal END AS balance FROM supplier UNION ALL SELECT 1000001, 'New One', 3, 10.5")
def replace(spark, sf):
    e = suppliers(spark, sf)
    e.replace("suppliers", [3, None, "Other", 9, 1.5])
    e.replace("suppliers", [1000001, None, "New One", 3, 10.5])
    return table(e)


@_add("replace_object", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Other' ELSE s_name END AS name, CASE WHEN s_suppkey = 3 THEN 9 ELSE s_nationkey END AS nation, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS balance FROM supplier")
def replace_object(spark, sf):
    e = suppliers(spark, sf)
    e.replace_object("suppliers", {"id": 3, "name": "Other", "nation": 9})
    return table(e)


@_add("update", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Set' ELSE s_name END AS name, CASE WHEN s_suppkey = 3 THEN s_nationkey - 2 ELSE s_nationkey END AS nation, CASE WHEN s_suppkey = 3 THEN s_acctbal + 5 ELSE s_acctbal END AS balance FROM supplier")
def update(spark, sf):
    e = suppliers(spark, sf)
    e.update("suppliers", 3, [("=", "name", "Set"), ("-", "nation", 2), ("+", 5, 5)])
    e.update("suppliers", 1000001, [("=", "name", "nobody")])
    return table(e)


@_add("update_operations", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey = 3 THEN xor((s_nationkey & 6) | 8, 3) ELSE s_nationkey END AS nation, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS balance FROM supplier")
def update_operations(spark, sf):
    e = suppliers(spark, sf)
    e.update("suppliers", 3, [("&", "nation", 6), ("|", "nation", 8), ("^", -2, 3), ("#", "balance", 1)])
    return table(e)


@_add("upsert", f"SELECT id, name, nation, CASE WHEN id = 3 THEN balance + 7 ELSE balance END AS balance FROM ({S}) UNION ALL SELECT 1000001, 'New One', 3, 10.5")
def upsert(spark, sf):
    e = suppliers(spark, sf)
    e.upsert("suppliers", [3, None, "unused", 1, 1], [("+", "balance", 7)])
    e.upsert("suppliers", [1000001, None, "New One", 3, 10.5], [("+", "balance", 7)])
    return table(e)


@_add("upsert_object", f"SELECT id, CASE WHEN id = 3 THEN 'Set' ELSE name END AS name, nation, balance FROM ({S}) UNION ALL SELECT 1000001, 'New One', 3, NULL")
def upsert_object(spark, sf):
    e = suppliers(spark, sf)
    e.upsert_object("suppliers", {"id": 3, "name": "x", "nation": 1}, [("=", "name", "Set")])
    e.upsert_object("suppliers", {"id": 1000001, "name": "New One", "nation": 3}, [("=", "name", "Set")])
    return table(e)


@_add("delete_row", f"SELECT 'left' AS what, * FROM ({S}) WHERE id <> 3 UNION ALL SELECT 'given' AS what, * FROM ({S}) WHERE id = 3")
def delete_row(spark, sf):
    e = suppliers(spark, sf)
    given = e.delete("suppliers", 3).rows()
    again = e.delete("suppliers", 3).rows()
    gone = frame(spark, [(r[0], *r[2:]) for r in given + again], "id long, name string, nation long, balance double")
    return table(e).withColumn("what", F.lit("left")).unionByName(gone.withColumn("what", F.lit("given")))


@_add("truncate", "SELECT 0 AS cnt, 'New One' AS name")
def truncate(spark, sf):
    e = suppliers(spark, sf)
    e.truncate("suppliers")
    before = e.len("suppliers")
    e.insert("suppliers", [1, None, "New One", 3, 1])
    return e.rows("suppliers").select(F.lit(before).cast("long").alias("cnt"), "name")


@_add("written_fields", "SELECT 'New One' AS name, 10.5 AS balance, 0 AS noreturn")
def written_fields(spark, sf):
    """What writes give back: named fields only, or nothing."""
    e = suppliers(spark, sf)
    one = e.insert("suppliers", [1000001, None, "New One", 3, 10.5], fields=["name", "balance"]).rows()
    none = e.insert("suppliers", [1000002, None, "New Two", 3, 10.5], noreturn=True)
    return frame(spark, [(*r, 0 if none is None else 1) for r in one], "name string, balance double, noreturn long")


@_add("grown_format", f"SELECT *, CASE WHEN id = 3 THEN 'set' END AS extra FROM ({S}) UNION ALL SELECT 1000001, 'New One', 3, 10.5, 'new'")
def grown_format(spark, sf):
    """A nullable field is appended; rows written before have NULL there, and operations reach it."""
    e = suppliers(spark, sf)
    e.alter(SpaceDef.of("suppliers", [*SUPPLIERS.fields, FieldDef("extra", "string", True)], SUPPLIERS.indexes))
    e.insert("suppliers", [1000001, None, "New One", 3, 10.5, "new"])
    e.update("suppliers", 3, [("=", "extra", "set")])
    return e.rows("suppliers").select(*SHOWN, "extra")


# batches and their policies: new ids with some that are there already

_BATCH = [1000000 + n for n in range(24)]
for _at, _id in ((4, 3), (9, 7), (13, 1), (20, 10)):
    _BATCH[_at] = _id
_JUDGED = f"""WITH b(n, id) AS (VALUES {', '.join(f'({n}, {i})' for n, i in enumerate(_BATCH))}),
s AS (SELECT n, id, {shard(_ID)} AS shard, id IN (SELECT s_suppkey FROM supplier) AS bad FROM b),
f AS (SELECT shard, min(n) FILTER (bad) AS failed FROM s GROUP BY shard),
j AS (SELECT id, n, bad, failed FROM s JOIN f USING (shard)) """
_POLICY = {
    "go_on": "CASE WHEN bad THEN 'DuplicateKeyError' ELSE 'ok' END",
    "stop": "CASE WHEN failed IS NULL OR n < failed THEN 'ok' WHEN n = failed THEN 'DuplicateKeyError' ELSE 'NotPerformedError' END",
    "rollback": "CASE WHEN bad THEN 'DuplicateKeyError' WHEN failed IS NULL THEN 'ok' ELSE 'NotPerformedError' END",
    "stop_rollback": "CASE WHEN failed IS NULL THEN 'ok' WHEN n = failed THEN 'DuplicateKeyError' ELSE 'NotPerformedError' END",
}
_SET = {"go_on": {}, "stop": {"stop_on_error": True}, "rollback": {"rollback_on_error": True}, "stop_rollback": {"stop_on_error": True, "rollback_on_error": True}}


def _outcome(spark, result, errors) -> DataFrame:
    good = [(r[0], "ok") for r in (result.rows() if result else [])]
    return frame(spark, good + [(e.operation_data[0], e.class_name) for e in errors or []], "id long, outcome string")


def _row(i: int) -> list:
    return [i, None, f"n{i}", i % 25, float(i)]


for _name, _options in _SET.items():

    @_add(f"insert_many_{_name}", f"{_JUDGED} SELECT id, {_POLICY[_name]} AS outcome FROM j")
    def insert_many_policy(spark, sf, options=_options):
        return _outcome(spark, *suppliers(spark, sf).insert_many("suppliers", [_row(i) for i in _BATCH], **options))

    @_add(f"insert_many_{_name}_rows", f"{_JUDGED} {S} UNION ALL SELECT id, 'n' || id, id % 25, CAST(id AS DOUBLE) FROM j WHERE {_POLICY[_name]} = 'ok'")
    def insert_many_rows(spark, sf, options=_options):
        e = suppliers(spark, sf)
        e.insert_many("suppliers", [_row(i) for i in _BATCH], **options)
        return table(e)

    @_add(f"insert_object_many_{_name}", f"{_JUDGED} SELECT id, {_POLICY[_name]} AS outcome FROM j")
    def insert_object_many_policy(spark, sf, options=_options):
        objects = [dict(zip(["id", "name", "nation", "balance"], [_row(i)[0], *_row(i)[2:]], strict=True)) for i in _BATCH]
        return _outcome(spark, *suppliers(spark, sf).insert_object_many("suppliers", objects, **options))

    @_add(f"bulk_insert_{_name}", f"{_JUDGED} SELECT id, {_POLICY[_name]} AS outcome FROM j")
    def bulk_insert_policy(spark, sf, options=_options):
        """The same policies where table and batch are DataFrames: nothing of either reaches the driver."""
        from .functions.bucket import integer_bucket
        from .operators import bulk
        from .sources.store import shard_of

        rows = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id")
        batch = frame(spark, [(i, n) for n, i in enumerate(_BATCH)], "id long, ordinal long")
        after, bad = bulk.insert(rows, batch, ["id"], shard_of(integer_bucket(F.col("id")), SHARDS, 3000), **options)
        good = after.join(rows, "id", "left_anti").withColumn("outcome", F.lit("ok"))
        return good.unionByName(bad.select("id", F.col("error").alias("outcome")))


@_add("replace_many_kept", f"WITH b AS (SELECT unnest({_BATCH}) AS id) SELECT * FROM ({S}) WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'n' || id, id % 25, CAST(id AS DOUBLE) FROM b")
def replace_many_kept(spark, sf):
    e = suppliers(spark, sf)
    e.replace_many("suppliers", [_row(i) for i in _BATCH])
    return table(e)


@_add("replace_object_many", f"WITH b AS (SELECT unnest({_BATCH}) AS id) SELECT * FROM ({S}) WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'n' || id, id % 25, CAST(NULL AS DOUBLE) FROM b")
def replace_object_many(spark, sf):
    e = suppliers(spark, sf)
    e.replace_object_many("suppliers", [{"id": i, "name": f"n{i}", "nation": i % 25} for i in _BATCH])
    return table(e)


_UPSERTED = f"WITH b AS (SELECT unnest({_BATCH}) AS id) SELECT id, name, nation, CASE WHEN id IN (SELECT id FROM b) THEN balance + 20 ELSE balance END AS balance FROM ({S}) UNION ALL SELECT id, 'n' || id, id % 25, CAST(id + 10 AS DOUBLE) FROM b WHERE id NOT IN (SELECT s_suppkey FROM supplier)"


@_add("upsert_many_kept", _UPSERTED)
def upsert_many_kept(spark, sf):
    """Each row comes twice: the second one's operations see what the first one did."""
    e = suppliers(spark, sf)
    e.upsert_many("suppliers", [(_row(i), [("+", "balance", 10)]) for i in _BATCH for _ in range(2)])
    return table(e)


@_add("upsert_object_many", _UPSERTED)
def upsert_object_many(spark, sf):
    e = suppliers(spark, sf)
    e.upsert_object_many("suppliers", [[dict(zip(["id", "name", "nation", "balance"], [_row(i)[0], *_row(i)[2:]], strict=True)), [("+", "balance", 10)]] for i in _BATCH for _ in range(2)])
    return table(e)


@_add("batch_by_shard", f"WITH b AS (SELECT unnest({_BATCH}) AS id UNION SELECT s_suppkey FROM supplier) SELECT {shard(_ID)} AS shard, count(*) AS cnt FROM b GROUP BY ALL")
def batch_by_shard(spark, sf):
    e = suppliers(spark, sf)
    e.replace_many("suppliers", [_row(i) for i in _BATCH])
    return frame(spark, [(s, v["rows"].get("suppliers", 0)) for s, v in e.storage_info().items()], "shard long, cnt long")


@_add("batch_edges", "SELECT * FROM (VALUES ('empty', 'InsertManyError', 'At least one tuple expected'), ('empty objects', 'InsertManyError', 'At least one object expected'), ('all failed', 'None', '2 errors'), ('bad object', 'InsertManyError', 'Failed to flatten object'), ('kept', 'rows', '1'), ('input', 'as it was', 'True')) AS t(what, kind, said)")
def batch_edges(spark, sf):
    """Empty batches, batches of which all rows fail, objects of a bad format, and the caller's lists."""
    e = suppliers(spark, sf)
    out = []
    for what, call in (("empty", e.insert_many), ("empty objects", e.insert_object_many)):
        try:
            call("suppliers", [])
        except E.EngineError as x:
            out.append((what, x.class_name, x.text))
    result, errors = e.insert_many("suppliers", [_row(3), _row(7)])
    out.append(("all failed", str(result), f"{len(errors)} errors"))
    result, errors = e.insert_object_many("suppliers", [{"id": 1000001, "name": "a", "nation": 1}, {"id": 1000002, "name": "b", "nation": 1, "unknown": 1}])
    out += [("bad object", errors[0].class_name, errors[0].text.split(":")[0]), ("kept", "rows", str(len(result)))]
    given = [_row(1000005)]
    e.insert_many("suppliers", given)
    return frame(spark, [*out, ("input", "as it was", str(given == [_row(1000005)]))], "what string, kind string, said string")


# pages and scans


def _ids(rows) -> list[tuple]:
    return [(n, r[0]) for n, r in enumerate(rows)]


_PAGED = "SELECT row_number() OVER (ORDER BY {0}) - 1 AS place, id FROM ({1}) WHERE {2} QUALIFY place < {3}"
_CUST = "SELECT o_orderkey AS id, * FROM orders"


@_add("pairs", _PAGED.format("o_custkey, id", _CUST, "o_custkey >= 100", 30))
def pairs(spark, sf):
    return frame(spark, _ids(engine_over(spark, sf).pairs("orders", [(">=", "custkey", 100)], first=30, batch_size=10)), "place long, id long")


@_add("pairs_objects", "SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey DESC) - 1 AS place, o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey <= 100 QUALIFY place < 30")
def pairs_objects(spark, sf):
    rows = engine_over(spark, sf).pairs("orders", [("<=", "custkey", 100)], first=30, use_tomap=True, fields=["o_orderkey", "o_totalprice"])
    return frame(spark, [(n, r["o_orderkey"], r["o_totalprice"]) for n, r in enumerate(rows)], "place long, id long, price double")


@_add("pairs_chain", "SELECT sum(o_totalprice) AS total FROM (SELECT o_totalprice FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey) WHERE o_orderstatus = 'O' LIMIT 20)")
def pairs_chain(spark, sf):
    """filter, map, take and reduce over the iterator."""
    from itertools import islice

    rows = engine_over(spark, sf).pairs("orders", [(">=", "custkey", 100)], use_tomap=True)
    taken = islice((r["o_totalprice"] for r in rows if r["o_orderstatus"] == "O"), 20)
    return frame(spark, [(float(sum(taken)),)], "total double").select(F.round("total", 2).alias("total"))


ORACLES["pairs_chain"] = ORACLES["pairs_chain"].replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)")


@_add("hints", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10")
def hints(spark, sf):
    """Options that steer a cluster are taken and change nothing."""
    return engine_over(spark, sf).select("orders", [(">=", "o_custkey", 100)], first=10, batch_size=1, yield_every=7, mode="write", prefer_replica=True, balance=True, timeout=5, request_timeout=1, fetch_latest_metadata=True, force_map_call=True).df


_ORDER_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@_add("after_eq", f"{_ORDER_ROWS} WHERE o_orderstatus = 'O' AND (o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 50)) ORDER BY o_orderpriority, o_orderkey LIMIT 20")
def after_eq(spark, sf):
    return engine_over(spark, sf).select("orders", [("==", "status_prio", ["O"])], first=20, after={"o_orderstatus": "O", "o_orderpriority": "2-HIGH", "o_orderkey": 50}).df


@_add("after_fields", "SELECT o_totalprice, o_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET 5)")
def after_fields(spark, sf):
    """The last row of a page of some fields, enriched with the key, leads to the next page."""
    e = engine_over(spark, sf)
    first = e.select("orders", [(">=", "custkey", 100)], first=5, fields=["o_totalprice"]).rows()
    return e.select("orders", [(">=", "custkey", 100)], first=10, after=first[-1], fields=["o_totalprice"]).df


@_add("walk_pages", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_custkey <= 3 ORDER BY o_custkey DESC, o_orderkey DESC")
def walk_pages(spark, sf):
    """All rows of a range, page by page."""
    e = engine_over(spark, sf)
    out, last = None, None
    while True:
        page = e.select("orders", [("<=", "custkey", 3)], first=25, after=last)
        rows = page.rows()
        if not rows:
            return out if out is not None else page.df
        out = page.df if out is None else out.unionByName(page.df)
        last = rows[-1]


def _json_events(spark, sf) -> Engine:
    e = Engine(spark)
    s = SpaceDef.of("events", [FieldDef("event_id", "integer"), FieldDef("props", "string")], [IndexDef.on("pk", "event_id"), IndexDef.on("k", Part("props", path="k", type="integer"), unique=False)])
    e.attach(s, lambda: spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props"))
    return e


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@_add("after_json_path", f"SELECT event_id, props FROM events WHERE {_K} > 50 OR ({_K} = 50 AND event_id > 1000) ORDER BY {_K}, event_id LIMIT 40")
def after_json_path(spark, sf):
    """Pages over an index whose key lies inside a document."""
    return _json_events(spark, sf).select("events", [(">=", "k", 50)], first=40, after={"props": {"k": 50}, "event_id": 1000}).df


@_add("fields_json_path", f"SELECT event_id, props FROM events WHERE {_K} >= 50 ORDER BY {_K}, event_id LIMIT 15")
def fields_json_path(spark, sf):
    """The field that an index's path starts from is added to the fields asked for."""
    return _json_events(spark, sf).select("events", [(">=", "k", 50)], first=15, fields=["event_id"]).df


@_add("cut_rows", "SELECT o_totalprice, o_orderstatus FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10)")
def cut_rows(spark, sf):
    e = engine_over(spark, sf)
    page = e.select("orders", [(">=", "custkey", 100)], first=10, fields=["o_totalprice", "o_orderstatus"])
    return frame(spark, e.cut_rows(page.rows(), page.metadata, ["o_totalprice", "o_orderstatus"]).rows(), "o_totalprice double, o_orderstatus string")


@_add("cut_objects", "SELECT o_orderstatus, o_totalprice FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10)")
def cut_objects(spark, sf):
    e = engine_over(spark, sf)
    page = e.select("orders", [(">=", "custkey", 100)], first=10, fields=["o_totalprice", "o_orderstatus"])
    return frame(spark, [(o["o_orderstatus"], o["o_totalprice"]) for o in e.cut_objects(page.objects(), ["o_totalprice", "o_orderstatus"])], "o_orderstatus string, o_totalprice double")


@_add("unflatten_rows", "SELECT r_regionkey AS id, r_name AS name FROM region")
def unflatten_rows(spark, sf):
    e = engine_over(spark, sf)
    page = e.select("region", None, fullscan=True)
    return frame(spark, [(o["r_regionkey"], o["r_name"]) for o in e.unflatten_rows(page.rows(), page.metadata)], "id long, name string")


@_add("flatten", "SELECT r_regionkey AS id, r_name AS name FROM region")
def flatten_objects(spark, sf):
    e = engine_over(spark, sf)
    space = next(s for s in SPACES if s.name == "region")
    return frame(spark, [flatten(o, space) for o in e.select("region", None, fullscan=True).objects()], "id long, name string")


# types and collations

_TYPED = "SELECT o_orderkey AS id, o_custkey % 2 = 0 AS flag, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(38, 15)) AS price, md5(CAST(o_orderkey AS VARCHAR)) AS u FROM orders"


def _typed(spark, sf) -> Engine:
    e = Engine(spark)
    s = SpaceDef.of("typed", [FieldDef("id", "integer"), FieldDef("flag", "boolean"), FieldDef("price", "decimal"), FieldDef("u", "uuid")], [IndexDef.on("pk", "id"), IndexDef.on("flag", "flag", unique=False), IndexDef.on("price", "price", unique=False), IndexDef.on("u", "u")])
    e.attach(s, lambda: spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey % 2 = 0 AS flag", "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(38, 15)) AS price", "md5(CAST(CAST(o_orderkey AS STRING) AS BINARY)) AS u"))
    return e


def _cast(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("decimal(18, 2)").cast("double"))


_TYPED_SHOWN = f"SELECT id, flag, CAST(CAST(price AS DECIMAL(18, 2)) AS DOUBLE) AS price, u FROM ({_TYPED})"
for _name, _conditions, _where, _order in (
    ("boolean", [(">", "flag", False)], "flag", "flag, id"),
    ("decimal", [(">=", "price", 150000.25)], "price >= 150000.25", "price, id"),
    ("uuid", [("<", "u", "80000000000000000000000000000000")], "u < '80000000000000000000000000000000'", "u DESC, id DESC"),
):

    @_add(f"compare_{_name}", f"{_TYPED_SHOWN} WHERE {_where} ORDER BY {_order} LIMIT 40")
    def compare(spark, sf, conditions=_conditions):
        return _cast(_typed(spark, sf).select("typed", conditions, first=40).df)


_ACCENTED = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Élan' WHEN 1 THEN 'elan' WHEN 2 THEN 'ELAN' ELSE c_mktsegment END AS word FROM customer"


def _words(spark, sf, collation: str) -> Engine:
    e = Engine(spark)
    s = SpaceDef.of("words", [FieldDef("id", "integer"), FieldDef("word", "string")], [IndexDef.on("pk", "id"), IndexDef.on("word", Part("word", collation), unique=False)])
    e.attach(s, lambda: spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN 'Élan' WHEN 1 THEN 'elan' WHEN 2 THEN 'ELAN' ELSE c_mktsegment END AS word"))
    return e


@_add("collation_unicode_ci", f"SELECT * FROM ({_ACCENTED}) WHERE word IN ('Élan', 'elan', 'ELAN')")
def collation_unicode_ci(spark, sf):
    return _words(spark, sf, "unicode_ci").select("words", [("==", "word", "ÉLAN")]).df


@_add("collation_unicode", f"SELECT * FROM ({_ACCENTED}) WHERE word = 'elan'")
def collation_unicode(spark, sf):
    return _words(spark, sf, "unicode").select("words", [("==", "word", "elan")]).df


@_add("collation_order", f"SELECT id, word FROM ({_ACCENTED}) WHERE word IN ('elan', 'ELAN', 'Élan') ORDER BY CASE word WHEN 'elan' THEN 1 WHEN 'ELAN' THEN 2 ELSE 3 END, id LIMIT 500")
def collation_order(spark, sf):
    """Index order under `unicode`: small before capital, without before with accent."""
    return _words(spark, sf, "unicode").select("words", [(">=", "word", "elan")], fullscan=True).df.filter(F.col("word").isin("elan", "ELAN", "Élan")).limit(500)


# planning


@_add("plans", "SELECT * FROM (VALUES ('by name', 'custkey', false), ('by field', 'custkey', false), ('down', 'custkey', true), ('first of two', 'orderdate', true), ('no index', 'pk', false), ('path of first part', 'k', false), ('not a tree', 'pk', false), ('dropped', 'late', false)) AS t(what, index_name, descending)")
def plans(spark, sf):
    """Which index a request takes, and which way."""
    from .plans.conditions import parse
    from .plans.planner import plan

    orders = next(s for s in SPACES if s.name == "orders")
    events = _json_events(spark, sf).catalog.get("events")
    hashed = SpaceDef.of("hashed", [("id", "unsigned"), ("a", "integer")], [IndexDef.on("pk", "id"), IndexDef.on("a", "a", type="HASH")])
    holes = SpaceDef.of("holes", [("id", "unsigned"), ("a", "integer")], {0: IndexDef.on("pk", "id"), 4: IndexDef.on("late", "a", unique=False)})
    asked = [("by name", orders, [(">", "custkey", 1)]), ("by field", orders, [("==", "o_custkey", 1)]), ("down", orders, [("<", "custkey", 1)]), ("first of two", orders, [("<=", "orderdate", "1997-01-01"), ("==", "custkey", 1)]), ("no index", orders, [(">=", "o_totalprice", 1.0)]), ("path of first part", events, [(">=", "props", 1)]), ("not a tree", hashed, [("==", "a", 1)]), ("dropped", holes, [("==", "a", 1)])]
    made = [(what, plan(space, parse(c))) for what, space, c in asked]
    return frame(spark, [(what, p.index.name, p.descending) for what, p in made], "what string, index_name string, descending boolean")


class _Heard(logging.Handler):
    def __init__(self):
        super().__init__()
        self.said: list[str] = []

    def emit(self, record):
        self.said.append(record.getMessage())


@_add("full_scan_guard", "SELECT * FROM (VALUES ('scan', 1), ('count', 1), ('allowed', 0), ('small page', 0), ('large page', 1), ('equal', 0), ('many scans', 7)) AS t(what, warnings)")
def full_scan_guard(spark, sf):
    """Scans that may be long are told of, at most ten times a minute."""
    e, heard, out = engine_over(spark, sf), _Heard(), []
    log.addHandler(heard)
    before, log.propagate = log.propagate, False
    try:
        asked = [("scan", lambda: e.select("orders")), ("count", lambda: e.count_frame("orders")), ("allowed", lambda: e.select("orders", fullscan=True)), ("small page", lambda: e.select("orders", first=10)), ("large page", lambda: e.select("orders", first=1001)), ("equal", lambda: e.select("orders", [("==", "custkey", 7)])), ("many scans", lambda: [e.select("orders") for _ in range(12)])]
        for what, call in asked:
            heard.said = []
            call()
            out.append((what, len(heard.said)))
    finally:
        log.removeHandler(heard)
        log.propagate = before
    return frame(spark, out, "what string, warnings long")


_ERRORS = [
    ("unknown field", "SelectError", lambda e: e.select("orders", fields=["nothing"])),
    ("unknown table", "SelectError", lambda e: e.select("nothing")),
    ("conditions", "SelectError", lambda e: e.select("orders", "o_custkey = 1")),
    ("operator", "SelectError", lambda e: e.select("orders", [("~", "o_custkey", 1)])),
    ("operand type", "SelectError", lambda e: e.select("orders", [("==", "custkey", "x")])),
    ("key parts", "SelectError", lambda e: e.select("orders", [("==", "custkey", [1, 2])])),
    ("negative first", "SelectError", lambda e: e.select("orders", first=-1)),
    ("negative first of pairs", "SelectError", lambda e: e.pairs("orders", first=-1)),
    ("batch size", "SelectError", lambda e: e.select("orders", batch_size=0)),
    ("yield every", "SelectError", lambda e: e.select("orders", yield_every=0)),
    ("option", "TypeError", lambda e: e.select("orders", nothing=1)),
    ("mode", "CallError", lambda e: e.select("orders", mode="both")),
    ("bucket", "BucketIDError", lambda e: e.select("orders", bucket_id="x")),
    ("key of get", "GetError", lambda e: e.get("orders", [1, 2])),
    ("index of min", "BorderError", lambda e: e.min("orders", "nothing")),
    ("table of count", "CountError", lambda e: e.count("nothing")),
    ("table of len", "LenError", lambda e: e.len("nothing")),
    ("read-only", "InsertError", lambda e: e.insert("orders", [1])),
    ("collation", "UnsupportedCollationError", lambda e: Part("a", "unicode_xx")),
    ("settings", "CfgError", lambda e: e.cfg(stats="yes")),
    ("driver", "CfgError", lambda e: e.cfg(stats_driver="other")),
    ("statistics", "StatsError", lambda e: e.stats(5)),
    ("metadata", "UnflattenError", lambda e: e.unflatten_rows([(1,)], None)),
    ("cut", "FilterFieldsError", lambda e: e.cut_rows([(1,)], [{"name": "a", "type": "any"}], ["b"])),
]


@_add("errors", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k, _ in _ERRORS) + ") AS t(what, kind)")
def errors(spark, sf):
    e, out = engine_over(spark, sf), []
    for what, _, call in _ERRORS:
        try:
            call(e)
            out.append((what, "none"))
        except E.EngineError as x:
            out.append((what, x.class_name))
        except TypeError:
            out.append((what, "TypeError"))
    return frame(spark, out, "what string, kind string")


_WRITE_ERRORS = [
    ("duplicate", "DuplicateKeyError", lambda e: e.insert("suppliers", [3, None, "a", 1, 1])),
    ("null", "TupleError", lambda e: e.insert("suppliers", [1000001, None, None, 1, 1])),
    ("type", "TupleError", lambda e: e.insert("suppliers", ["x", None, "a", 1, 1])),
    ("below zero", "TupleError", lambda e: e.insert("suppliers", [-1, None, "a", 1, 1])),
    ("too many", "TupleError", lambda e: e.insert("suppliers", [1000001, None, "a", 1, 1, 1])),
    ("bucket in row", "BucketIDError", lambda e: e.insert("suppliers", [1000001, 0, "a", 1, 1])),
    ("bucket in options", "BucketIDError", lambda e: e.insert("suppliers", [1000001, None, "a", 1, 1], bucket_id=-3)),
    ("two buckets", "BucketIDError", lambda e: e.insert("suppliers", [1000001, 7, "a", 1, 1], bucket_id=8)),
    ("key changed", "UpdateError", lambda e: e.update("suppliers", 3, [("=", "id", 4)])),
    ("no number", "UpdateError", lambda e: e.update("suppliers", 3, [("+", "name", 4)])),
    ("operation", "ParseOperationsError", lambda e: e.update("suppliers", 3, [("?", "name", 4)])),
    ("operations", "ParseOperationsError", lambda e: e.update("suppliers", 3, "name")),
    ("field", "ParseOperationsError", lambda e: e.upsert("suppliers", [3, None, "a", 1, 1], [("=", "nothing", 4)])),
    ("object", "InsertError", lambda e: e.insert_object("suppliers", {"id": 1000001, "nothing": 1})),
    ("object without", "InsertError", lambda e: e.insert_object("suppliers", {"id": 1000001})),
    ("hidden table", "SchemaError", lambda e: e.schema("_hidden")),
    ("read view option", "SelectError", lambda e: e.readview().select("suppliers", mode="read")),
    ("load", "DuplicateKeyError", lambda e: e.load("suppliers", e.rows("suppliers").drop("bucket_id"))),
]


@_add("write_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k, _ in _WRITE_ERRORS) + f") AS t(what, kind) UNION ALL SELECT 'rows after', CAST(count(*) AS VARCHAR) FROM supplier")
def write_errors(spark, sf):
    e, out = suppliers(spark, sf), []
    for what, _, call in _WRITE_ERRORS:
        try:
            call(e)
            out.append((what, "none"))
        except E.EngineError as x:
            out.append((what, x.class_name))
    return frame(spark, [*out, ("rows after", str(e.len("suppliers")))], "what string, kind string")


# sharding


@_add("sharding_key", f"SELECT id, {bucket('name')} AS bucket_id FROM ({S})")
def sharding_key(spark, sf):
    """Buckets by another field than the key."""
    space = SpaceDef.of("by_name", _FIELDS, [IndexDef.on("id", "id", "name")], sharding_key=("name",))
    return suppliers(spark, sf, space).rows("by_name").select("id", "bucket_id")


@_add("sharding_function", f"SELECT id, id % 10 + 1 AS bucket_id FROM ({S}) UNION ALL SELECT 1000001, 2")
def sharding_function(spark, sf):
    space = SpaceDef.of("by_function", _FIELDS, [IndexDef.on("id", "id", "name")], sharding_key=("id",), sharding_func=lambda key: key[0] % 10 + 1)
    e = suppliers(spark, sf, space)
    e.insert("by_function", [1000001, None, "a", 1, 1])
    return e.rows("by_function").select("id", "bucket_id")


@_add("sharding_function_by_name", f"SELECT id, id % 7 + 100 AS bucket_id FROM ({S})")
def sharding_function_by_name(spark, sf):
    register("by_seven", lambda key: key[0] % 7 + 100)
    space = SpaceDef.of("by_name_of_function", _FIELDS, [IndexDef.on("id", "id")], sharding_func="by_seven")
    return suppliers(spark, sf, space).rows("by_name_of_function").select("id", "bucket_id")


def _read(df: DataFrame) -> int:
    """Shards whose files a plan reads."""
    return len({f.split("__shard=")[1].split("/")[0] for f in df.inputFiles()})


@_add("key_pruned", f"SELECT id, 1 AS shards FROM ({S}) WHERE id = 7")
def key_pruned(spark, sf):
    """Equality on the sharding key reads the files of one shard."""
    df = suppliers(spark, sf).select("suppliers", [("==", "id", 7)]).df
    return df.select("id", F.lit(_read(df)).alias("shards"))


@_add("map_reduce", f"SELECT id, {SHARDS} AS shards FROM ({S}) WHERE nation = 7")
def map_reduce(spark, sf):
    """Any other condition, or force_map_call, reads all shards."""
    e = suppliers(spark, sf)
    df = e.select("suppliers", [("==", "nation", 7)]).df
    assert _read(e.select("suppliers", [("==", "id", 7)], force_map_call=True).df) == SHARDS
    return df.select("id", F.lit(_read(df)).alias("shards"))


@_add("bucket_in_key", f"SELECT id, {bucket(_ID)} AS bucket_id FROM ({S}) WHERE id IN (3, 7)")
def bucket_in_key(spark, sf):
    """A bucket that leads the primary key may be left out of a key."""
    space = SpaceDef.of("led", _FIELDS, [IndexDef.on("pk", "bucket_id", "id")], sharding_key=("id",))
    e = suppliers(spark, sf, space)
    return e.get("led", [None, 3], fields=["id", "bucket_id"]).df.unionByName(e.get("led", [None, 7], fields=["id", "bucket_id"]).df)


@_add("bucket_given", "SELECT 1000001 AS id, 2222 AS bucket_id, 4 AS shard")
def bucket_given(spark, sf):
    """A bucket given with the row holds, and is needed to find it again."""
    e = suppliers(spark, sf)
    e.insert("suppliers", [1000001, None, "a", 1, 1], bucket_id=2222)
    return e.get("suppliers", 1000001, bucket_id=2222, fields=["id", "bucket_id"]).df.withColumn("shard", F.lit(e.locate("suppliers", 1000001, bucket_id=2222)["shard"]))


ORACLES["bucket_given"] = "SELECT 1000001 AS id, 2222 AS bucket_id, least(CAST(floor(2221 * 4 / 3000) AS BIGINT), 3) + 1 AS shard"


@_add("key_from_primary", f"SELECT 'get' AS what, id FROM ({S}) WHERE id = 3 UNION ALL SELECT 'update', id FROM ({S}) WHERE id = 3 UNION ALL SELECT 'delete', id FROM ({S}) WHERE id = 3 UNION ALL SELECT 'ShardingKeyError', 3")
def key_from_primary(spark, sf):
    """Rows are found by key where the key tells the shard; else the bucket must be given."""
    e = suppliers(spark, sf)
    out = [("get", e.get("suppliers", 3).rows()[0][0]), ("update", e.update("suppliers", 3, [("=", "name", "x")]).rows()[0][0]), ("delete", e.delete("suppliers", 3).rows()[0][0])]
    hidden = SpaceDef.of("by_nation", _FIELDS, [IndexDef.on("id", "id")], sharding_key=("nation",))
    try:
        suppliers(spark, sf, hidden).get("by_nation", 3)
    except E.ShardingKeyError as x:
        out.append((x.class_name, 3))
    return frame(spark, out, "what string, id long")


# read views


@_add("read_view", f"SELECT 'view' AS what, * FROM ({S}) UNION ALL SELECT 'now' AS what, * FROM ({S}) WHERE id <> 3 UNION ALL SELECT 'now', 1000001, 'New One', 3, 10.5")
def read_view(spark, sf):
    """What a view shows after the table has changed, beside what the table shows."""
    e = suppliers(spark, sf)
    view = e.readview(name="before")
    e.delete("suppliers", 3)
    e.insert("suppliers", [1000001, None, "New One", 3, 10.5])
    e.vacuum("suppliers")
    before = view.select("suppliers", fullscan=True).df.select(*SHOWN, F.lit("view").alias("what"))
    return table(e).withColumn("what", F.lit("now")).unionByName(before)


@_add("read_view_pairs", f"SELECT row_number() OVER (ORDER BY id) - 1 AS place, id FROM ({S}) WHERE id >= 20")
def read_view_pairs(spark, sf):
    e = suppliers(spark, sf)
    view = e.readview()
    e.truncate("suppliers")
    return frame(spark, _ids(view.pairs("suppliers", [(">=", "id", 20)])), "place long, id long")


@_add("read_view_closed", "SELECT * FROM (VALUES ('closed', 'ReadviewError'), ('closed twice', 'None'), ('views after', '0')) AS t(what, said)")
def read_view_closed(spark, sf):
    """Closed by hand, twice without harm, or with its last reference."""
    import gc

    e = suppliers(spark, sf)
    view, dropped = e.readview(), e.readview()
    view.close()
    out = []
    try:
        view.select("suppliers", fullscan=True)
    except E.ReadviewError as x:
        out.append(("closed", x.class_name))
    out.append(("closed twice", str(view.close())))
    del dropped
    gc.collect()
    return frame(spark, [*out, ("views after", str(len(e._views)))], "what string, said string")


# introspection and statistics


@_add("locate", f"SELECT id, {bucket(_ID)} AS bucket_id, {shard(_ID)} AS shard FROM ({S}) WHERE id IN (1, 3, 7)")
def locate(spark, sf):
    e = suppliers(spark, sf)
    found = [(i, e.locate("suppliers", i)) for i in (1, 3, 7, 1000001)]
    return frame(spark, [(i, x["bucket_id"], x["shard"]) for i, x in found if x], "id long, bucket_id long, shard long")


@_add("storage_info", f"SELECT {shard(_ID)} AS shard, 'running' AS status, true AS is_master, count(*) AS cnt FROM ({S}) GROUP BY ALL")
def storage_info(spark, sf):
    info = suppliers(spark, sf).storage_info()
    return frame(spark, [(s, v["status"], v["is_master"], v["rows"].get("suppliers", 0)) for s, v in info.items()], "shard long, status string, is_master boolean, cnt long")


@_add("schema", "SELECT * FROM (VALUES " + ", ".join(f"('{s.name}', '{f.name}', '{f.type}', {str(f.is_nullable).lower()})" for s in SPACES for f in s.fields) + ", ('orders_sparse', 'o_orderkey', 'integer', false), ('orders_sparse', 'x', 'integer', true), ('orders_sparse', 'o_totalprice', 'double', false)) AS t(\"table\", field, type, is_nullable)")
def schema(spark, sf):
    shown = engine_over(spark, sf).schema()
    return frame(spark, [(n, f["name"], f["type"], bool(f.get("is_nullable"))) for n, s in shown.items() for f in s["format"]], "table string, field string, type string, is_nullable boolean")


@_add("schema_indexes", "SELECT * FROM (VALUES ('id', 'TREE', true, 1, 'unsigned'), ('nation', 'TREE', false, 4, 'integer')) AS t(name, type, is_unique, fieldno, part_type)")
def schema_indexes(spark, sf):
    """Indexes as users see them: that of the bucket is not shown."""
    shown = suppliers(spark, sf).schema("suppliers")["indexes"].values()
    return frame(spark, [(i["name"], i["type"], i["unique"], p["fieldno"], p["type"]) for i in shown for p in i["parts"]], "name string, type string, is_unique boolean, fieldno long, part_type string")


_CALLS = [("insert", 1, 1), ("insert_many", 1, 0), ("get", 1, 0), ("replace", 1, 0), ("replace_many", 1, 0), ("update", 1, 0), ("upsert", 1, 0), ("upsert_many", 1, 0), ("delete", 1, 0), ("select", 2, 0), ("truncate", 1, 0), ("len", 1, 0), ("count", 1, 0), ("borders", 2, 0), ("locate", 1, 0)]


@_add("stats", "SELECT * FROM (VALUES " + ", ".join(f"('{o}', {a}, {b}, true)" for o, a, b in _CALLS) + ") AS t(operation, ok, error, timed)")
def stats(spark, sf):
    """Calls of each operation, good and bad; pairs count under select when they end."""
    e = suppliers(spark, sf)
    e.cfg(stats=True)
    e.insert("suppliers", _row(1000001))
    try:
        e.insert("suppliers", _row(1000001))
    except E.EngineError:
        pass
    e.insert_many("suppliers", [_row(1000002)])
    e.get("suppliers", 3), e.replace("suppliers", _row(1000001)), e.replace_many("suppliers", [_row(1000002)])
    e.update("suppliers", 3, [("+", "balance", 1)]), e.upsert("suppliers", _row(3), [("+", "balance", 1)]), e.upsert_many("suppliers", [(_row(3), [("+", "balance", 1)])])
    e.delete("suppliers", 3), e.select("suppliers", first=3), list(e.pairs("suppliers", first=3))
    e.len("suppliers"), e.count("suppliers", fullscan=True), e.min("suppliers"), e.max("suppliers", "nation"), e.locate("suppliers", 7), e.truncate("suppliers")
    return frame(spark, [(o, v["ok"]["count"], v["error"]["count"], v["ok"]["time"] > 0 and abs(v["ok"]["latency_average"] - v["ok"]["time"] / v["ok"]["count"]) < 1e-9) for o, v in e.stats("suppliers").items()], "operation string, ok long, error long, timed boolean")


@_add("stats_details", f"SELECT (SELECT count(*) FROM ({S}) WHERE nation >= 20) + 5 AS tuples_fetched, (SELECT count(*) FROM ({S}) WHERE nation >= 20) + (SELECT count(*) FROM ({S}) WHERE nation >= 5) + 3 AS tuples_lookup, 3 AS map_reduces")
def stats_details(spark, sf):
    """Rows given out and let through by select and pairs, and reads of all shards."""
    e = suppliers(spark, sf)
    e.cfg(stats=True)
    e.select("suppliers", [(">=", "nation", 20)], fullscan=True).rows()
    e.select("suppliers", [(">=", "nation", 5)], first=2).rows()
    list(e.pairs("suppliers", first=3))
    d = e.stats("suppliers")["select"]["details"]
    return frame(spark, [(d["tuples_fetched"], d["tuples_lookup"], d["map_reduces"])], "tuples_fetched long, tuples_lookup long, map_reduces long")


@_add("settings", "SELECT * FROM (VALUES ('before', 'False local False'), ('after', 'True metrics True'), ('quantile', 'True'), ('reset', '0')) AS t(what, said)")
def settings(spark, sf):
    e = suppliers(spark, sf)
    show = lambda c: f"{c.stats} {c.stats_driver} {c.stats_quantiles}"
    out = [("before", show(e.cfg())), ("after", show(e.cfg(stats=True, stats_driver="metrics", stats_quantiles=True, stats_quantile_max_age_time=30)))]
    e.len("suppliers")
    ok = e.stats("suppliers")["len"]["ok"]
    out.append(("quantile", str(abs(ok["latency_quantile_recent"] - ok["time"]) <= 0.01 * ok["time"])))
    e.reset_stats()
    return frame(spark, [*out, ("reset", str(len(e.stats()["spaces"])))], "what string, said string")


@_add("lifecycle", "SELECT '0.2.0' AS version, true AS cleared, false AS safe_mode, true AS rows_stay")
def lifecycle(spark, sf):
    e = suppliers(spark, sf)
    n = e.len("suppliers")
    e.init_router(), e.init_storage(), e.stop_router(), e.stop_storage()
    safe = e.safe_mode_enable() or e.safe_mode_disable() or e.safe_mode_status()
    return frame(spark, [(e._VERSION, e.router_cache_clear(), safe, e.len("suppliers") == n)], "version string, cleared boolean, safe_mode boolean, rows_stay boolean")


# the corpus tables as tables of the engine

for _name, _space, _conditions, _oracle, _opts in (
    ("documents_by_language", "documents", [("==", "lang_source", ["en"])], "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY source, doc_id LIMIT 50", {"first": 50, "fields": ["doc_id", "lang", "source"]}),
    ("embeddings_by_label", "embeddings", [(">=", "label", 3)], "SELECT vec_id, label FROM embeddings WHERE label >= 3 ORDER BY label, vec_id LIMIT 50", {"first": 50, "fields": ["vec_id", "label"]}),
    ("pages_range", "pages", [("<", "page_id", 30)], "SELECT page_id, url FROM pages WHERE page_id < 30 ORDER BY page_id DESC LIMIT 20", {"first": 20, "fields": ["page_id", "url"]}),
    ("benchmark_page", "benchmark", [(">=", "item_id", 5)], "SELECT item_id, text FROM benchmark WHERE item_id >= 5 ORDER BY item_id LIMIT 20", {"first": 20}),
    ("labels_by_quality", "labels", [("==", "quality", 1), ("==", "toxic", 0)], "SELECT * FROM labels WHERE quality = 1 AND toxic = 0 ORDER BY doc_id LIMIT 50", {"first": 50}),
    ("conversation_turns", "conversations", [("==", "pk", [3])], "SELECT * FROM conversations WHERE conv_id = 3 ORDER BY turn", {}),
):

    @_add(_name, _oracle)
    def corpus_table(spark, sf, space=_space, conditions=_conditions, opts=_opts):
        return engine_over(spark, sf).select(space, conditions, fullscan=True, **opts).df
