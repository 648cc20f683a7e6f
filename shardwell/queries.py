"""The engine's operators as queries over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_kept
from .engine import Engine
from .functions.bucket import TABLE, integer_bucket
from .operators import bulk
from .sources.tables import SPACES, engine_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 4


def _add(name: str, oracle: str | None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _select(name: str, space: str, conditions, oracle: str, **opts) -> None:
    _add(name, oracle)(lambda spark, sf: engine_over(spark, sf).select(space, conditions, fullscan=True, **opts).df)


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
SPARSE = "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS x, o_totalprice FROM orders)"

_select("select_all", "region", None, "SELECT * FROM region ORDER BY r_regionkey")
_select("eq_secondary", "orders", [("==", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey = 100")
_select("ge_first", "orders", [(">=", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10", first=10)
_select("gt_first", "orders", [(">", "custkey", 100)], f"{ORDERS} WHERE o_custkey > 100 ORDER BY o_custkey, o_orderkey LIMIT 10", first=10)
_select("lt_first", "orders", [("<", "custkey", 100)], f"{ORDERS} WHERE o_custkey < 100 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 10", first=10)
_select("le_desc_first", "orders", [("<=", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey <= 100 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 10", first=10)
_select("field_no_index", "orders", [(">=", "o_totalprice", 100000.0)], f"{ORDERS} WHERE o_totalprice >= 100000 ORDER BY o_orderkey LIMIT 50", first=50)
_select("multi_condition", "orders", [(">=", "o_custkey", 50), ("<", "o_totalprice", 200000.0), ("==", "o_orderstatus", "O")], f"{ORDERS} WHERE o_custkey >= 50 AND o_totalprice < 200000 AND o_orderstatus = 'O' ORDER BY o_custkey, o_orderkey LIMIT 50", first=50)
_select("first_index_wins", "orders", [("<=", "o_orderdate", "1997-01-01"), ("==", "o_custkey", 7)], f"{ORDERS} WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20", first=20)
_PAIR = "(o_orderstatus {0} 'O' OR (o_orderstatus = 'O' AND o_orderpriority {1} '2-HIGH'))"
for _name, _op, _way in (("gt", ">", ("", "")), ("ge", ">=", ("", "")), ("lt", "<", (" DESC",) * 2), ("le", "<=", (" DESC",) * 2)):
    _select(f"composite_{_name}", "orders", [(_op, "status_prio", ["O", "2-HIGH"])], f"{ORDERS} WHERE {_PAIR.format(_op[0], _op)} ORDER BY o_orderstatus{_way[0]}, o_orderpriority{_way[0]}, o_orderkey{_way[0]} LIMIT 50", first=50)
_select("composite_eq", "orders", [("==", "status_prio", ["O", "2-HIGH"])], f"{ORDERS} WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 50", first=50)
_select("prefix_eq", "orders", [("==", "status_prio", ["P"])], f"{ORDERS} WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey LIMIT 50", first=50)
_select("prefix_gt", "orders", [(">", "status_prio", ["F"])], f"{ORDERS} WHERE o_orderstatus > 'F' ORDER BY o_orderstatus, o_orderpriority, o_orderkey LIMIT 50", first=50)
_select("after_page", "orders", [(">=", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey >= 100 AND (o_custkey > 120 OR (o_custkey = 120 AND o_orderkey > 5)) ORDER BY o_custkey, o_orderkey LIMIT 10", first=10, after={"o_custkey": 120, "o_orderkey": 5})
_select("before_page", "orders", [(">=", "o_custkey", 100)], f"SELECT * FROM ({ORDERS} WHERE o_custkey >= 100 AND (o_custkey < 120 OR (o_custkey = 120 AND o_orderkey < 5)) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 10) ORDER BY o_custkey, o_orderkey", first=-10, after={"o_custkey": 120, "o_orderkey": 5})
_select("after_desc", "orders", [("<=", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey <= 100 AND (o_custkey < 80 OR (o_custkey = 80 AND o_orderkey < 900)) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 10", first=10, after={"o_custkey": 80, "o_orderkey": 900})
_select("before_desc", "orders", [("<=", "o_custkey", 100)], f"{ORDERS} WHERE o_custkey <= 100 AND (o_custkey > 80 OR (o_custkey = 80 AND o_orderkey > 900)) ORDER BY o_custkey, o_orderkey LIMIT 10", first=-10, after={"o_custkey": 80, "o_orderkey": 900})
_select("null_lt", "orders_sparse", [("<", "x", 50)], f"{SPARSE} WHERE x < 50 OR x IS NULL ORDER BY x DESC NULLS LAST, o_orderkey DESC LIMIT 200", first=200)
_select("null_le", "orders_sparse", [("<=", "x", 50)], f"{SPARSE} WHERE x <= 50 OR x IS NULL ORDER BY x DESC NULLS LAST, o_orderkey DESC LIMIT 200", first=200)
_select("null_le_null", "orders_sparse", [("<=", "x", None)], f"{SPARSE} WHERE x IS NULL ORDER BY o_orderkey DESC LIMIT 200", first=200)
_select("null_lt_null", "orders_sparse", [("<", "x", None)], f"{SPARSE} WHERE false", first=200)
_select("null_ge", "orders_sparse", [(">=", "x", None)], f"{SPARSE} ORDER BY x NULLS FIRST, o_orderkey LIMIT 200", first=200)
_select("null_gt", "orders_sparse", [(">", "x", None)], f"{SPARSE} WHERE x IS NOT NULL ORDER BY x, o_orderkey LIMIT 200", first=200)
_select("null_eq", "orders_sparse", [("==", "x", None)], f"{SPARSE} WHERE x IS NULL ORDER BY o_orderkey LIMIT 200", first=200)
_select("missing_value", "orders_sparse", [("<", "x")], f"{SPARSE} ORDER BY x DESC NULLS LAST, o_orderkey DESC LIMIT 200", first=200)
_select("null_page", "orders_sparse", [(">=", "x", None)], f"{SPARSE} WHERE x IS NOT NULL OR (x IS NULL AND o_orderkey > 20) ORDER BY x NULLS FIRST, o_orderkey LIMIT 100", first=100, after={"x": None, "o_orderkey": 20})
_select("fields_enriched", "orders", [(">=", "o_custkey", 100)], "SELECT o_totalprice, o_custkey, o_orderkey FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10", first=10, fields=["o_totalprice"])
_select("json_path", "events", [(">=", '["props"].k', 50)], "SELECT * FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 ORDER BY event_id LIMIT 100", first=100)
_select("json_path_by_number", "events", [("<", "[6].k", 10)], "SELECT * FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) < 10 OR json_extract(props, '$.k') IS NULL ORDER BY event_id LIMIT 100", first=100)
_select("ci_filter", "customer", [("==", "segment", "household")], "SELECT * FROM customer WHERE lower(c_mktsegment) = 'household'")
_select("ci_dropped_in_residual", "customer", [(">=", "c_custkey", 1), ("==", "c_mktsegment", "household")], "SELECT * FROM customer WHERE c_custkey >= 1 AND c_mktsegment = 'household'")
_select("datetime_range", "events", [(">=", "ts", "2024-01-01"), ("<", "ts", "2024-01-08")], "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' ORDER BY ts, event_id LIMIT 500", first=500)
_select("user_window", "events", [("==", "user_ts", [7])], "SELECT * FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 100", first=100)


@_add("get_pk", f"{ORDERS} WHERE o_orderkey = 42")
def get_pk(spark, sf):
    return engine_over(spark, sf).get("orders", 42).df


@_add("get_fields", "SELECT o_totalprice FROM orders WHERE o_orderkey = 42")
def get_fields(spark, sf):
    return engine_over(spark, sf).get("orders", 42, fields=["o_totalprice"]).df


@_add("cut_fields", "SELECT o_totalprice FROM (SELECT * FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10)")
def cut_fields(spark, sf):
    """The key fields that a page of some fields is enriched with are cut off again."""
    engine = engine_over(spark, sf)
    page = engine.select("orders", [(">=", "o_custkey", 100)], first=10, fields=["o_totalprice"])
    return spark.createDataFrame(engine.cut_rows(page.rows(), page.metadata, ["o_totalprice"]).rows(), "o_totalprice double")


@_add("count_all", "SELECT count(*) AS cnt FROM lineitem")
def count_all(spark, sf):
    return engine_over(spark, sf).count_frame("lineitem", fullscan=True)


@_add("count_cond", "SELECT count(*) AS cnt FROM lineitem WHERE l_partkey >= 100 AND l_quantity < 25")
def count_cond(spark, sf):
    return engine_over(spark, sf).count_frame("lineitem", [(">=", "l_partkey", 100), ("<", "l_quantity", 25.0)], fullscan=True)


@_add("len", "SELECT count(*) AS cnt FROM orders")
def len_(spark, sf):
    return engine_over(spark, sf).len_frame("orders")


for _name, _call, _dir, _null in (("min_row", "min", "", "FIRST"), ("max_row", "max", " DESC", "LAST")):
    _add(_name, f"{ORDERS} ORDER BY o_custkey{_dir}, o_orderkey{_dir} LIMIT 1")(lambda spark, sf, c=_call: getattr(engine_over(spark, sf), c)("orders", "custkey").df)
    _add(f"null_{_call}", f"{SPARSE} ORDER BY x{_dir} NULLS {_null}, o_orderkey{_dir} LIMIT 1")(lambda spark, sf, c=_call: getattr(engine_over(spark, sf), c)("orders_sparse", "x").df)
_add("max_primary", "SELECT o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 1")(lambda spark, sf: engine_over(spark, sf).max("orders", fields=["o_orderdate"]).df)

# the same CRC in DuckDB: a fold over the key's characters, with the table spelled out
_CRC = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor({TABLE}[(xor(a, b) & 255) + 1], a >> 8))"
_BUCKET = f"CAST({_CRC} % 3000 + 1 AS BIGINT)"


@_add("bucket_id", f"SELECT o_orderkey, {_BUCKET} AS bucket_id FROM orders")
def bucket_id(spark, sf):
    return engine_over(spark, sf).rows("orders").select("o_orderkey", integer_bucket(F.col("o_orderkey")).alias("bucket_id"))


def kept_orders(spark, sf) -> Engine:
    """All orders in a kept table of four shards; the last one is used again for the same folder."""
    source = f"{sf}/orders.parquet"
    if _kept.get("of") != (spark.sparkContext.applicationId, source):
        engine = Engine(spark, queries_kept.scratch(spark), shards=SHARDS)
        engine.create(next(s for s in SPACES if s.name == "orders"))
        engine.load("orders", spark.read.parquet(source))
        _kept.update(of=(spark.sparkContext.applicationId, source), engine=engine)
    return _kept["engine"]


_kept: dict = {}


@_add("shard_pruned", f"SELECT o_orderkey, o_custkey FROM orders WHERE least(CAST(floor(({_BUCKET} - 1) * {SHARDS} / 3000) AS BIGINT), {SHARDS - 1}) + 1 = 2 ORDER BY o_orderkey LIMIT 100")
def shard_pruned(spark, sf):
    """The bucket_id option reads only the files of the shard that holds the bucket."""
    return kept_orders(spark, sf).select("orders", None, first=100, bucket_id=1000, fields=["o_orderkey", "o_custkey"]).df


def _orders(spark, sf) -> DataFrame:
    return engine_over(spark, sf).rows("orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _batch(spark, sf) -> DataFrame:
    """Orders with small keys and some new ones, each twice."""
    base = _orders(spark, sf).filter("o_orderkey < 60")
    moved = base.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 100000000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_totalprice")
    again = moved.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return moved.withColumn("ordinal", F.col("o_orderkey") * 2).unionByName(again.withColumn("ordinal", F.col("o_orderkey") * 2 + 1))


_BATCH = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 60"


@_add("replace_many", f"WITH b AS ({_BATCH}) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM b")
def replace_many(spark, sf):
    return bulk.replace(_orders(spark, sf), _batch(spark, sf), ["o_orderkey"])


@_add("insert_many", f"WITH b AS ({_BATCH}) SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_many(spark, sf):
    return bulk.insert(_orders(spark, sf), _batch(spark, sf), ["o_orderkey"])[0]


@_add("insert_many_errors", f"WITH b AS ({_BATCH}) SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM b UNION ALL SELECT * FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM orders)")
def insert_many_errors(spark, sf):
    return bulk.insert(_orders(spark, sf), _batch(spark, sf), ["o_orderkey"])[1].select("o_orderkey", "o_custkey", "o_totalprice")


@_add("upsert_many", f"WITH b AS ({_BATCH}) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM b) THEN o_custkey + 20 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_custkey + 10 AS o_custkey, o_totalprice FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def upsert_many(spark, sf):
    return bulk.upsert(_orders(spark, sf), _batch(spark, sf), ["o_orderkey"], {"o_custkey": bulk.Adding(F.lit(10))})


@_add("update_add", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 42 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_add(spark, sf):
    return bulk.update(_orders(spark, sf), F.col("o_orderkey") == 42, {"o_totalprice": F.col("o_totalprice") + 5})


@_add("delete", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey <> 42")
def delete(spark, sf):
    return bulk.delete(_orders(spark, sf), spark.createDataFrame([(42,)], "o_orderkey long"), ["o_orderkey"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).select("orders", [(">=", "o_custkey", 100)], first=10, fields=["o_orderkey"]).df


QUERIES |= queries_kept.QUERIES
ORACLES |= queries_kept.ORACLES
