"""The driver's Parquet tables as attached tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import FieldDef, IndexDef, Part, SpaceDef
from ..engine import Engine

_I, _N, _S, _D, _TS = "integer", "number", "string", "double", "datetime"


def _space(name: str, fields: str, *indexes: IndexDef, nullable: tuple[str, ...] = ()) -> SpaceDef:
    kinds = {"i": (_I, None), "s": (_S, None), "f": (_D, None), "t": (_TS, None), "a": ("array", T.ArrayType(T.FloatType()))}
    defs = []
    for item in fields.split():
        name_, kind = item.split(":")
        defs.append(FieldDef(name_, kinds[kind][0], name_ in nullable, kinds[kind][1]))
    return SpaceDef.of(name, defs, list(indexes))


SPACES = [
    _space("region", "r_regionkey:i r_name:s", IndexDef.on("pk", "r_regionkey")),
    _space("nation", "n_nationkey:i n_name:s n_regionkey:i", IndexDef.on("pk", "n_nationkey"), IndexDef.on("region", "n_regionkey", unique=False)),
    _space("customer", "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s", IndexDef.on("pk", "c_custkey"), IndexDef.on("segment", Part("c_mktsegment", "unicode_ci"), unique=False)),
    _space("supplier", "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f", IndexDef.on("pk", "s_suppkey"), IndexDef.on("nation", "s_nationkey", unique=False)),
    _space("part", "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f", IndexDef.on("pk", "p_partkey"), IndexDef.on("size", "p_size", unique=False), IndexDef.on("brand_type", "p_brand", "p_type", unique=False)),
    _space("orders", "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s", IndexDef.on("pk", "o_orderkey"), IndexDef.on("custkey", "o_custkey", unique=False), IndexDef.on("status_prio", "o_orderstatus", "o_orderpriority", unique=False), IndexDef.on("orderdate", "o_orderdate", unique=False)),
    # no key of lineitem is unique: these give an order, for counts and whole-row queries only
    _space("lineitem", "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t", IndexDef.on("order_line", "l_orderkey", "l_linenumber", unique=False), IndexDef.on("part", "l_partkey", unique=False)),
    _space("events", "event_id:i ts:t user_id:i event_type:s value:f props:s", IndexDef.on("pk", "event_id"), IndexDef.on("user_ts", "user_id", "ts", unique=False), IndexDef.on("ts", "ts", unique=False)),
    _space("documents", "doc_id:i text:s lang:s source:s n_chars:i", IndexDef.on("pk", "doc_id"), IndexDef.on("lang_source", "lang", "source", unique=False), nullable=("text", "lang", "source", "n_chars")),
    _space("embeddings", "vec_id:i embedding:a label:i", IndexDef.on("pk", "vec_id"), IndexDef.on("label", "label", unique=False)),
    _space("pages", "page_id:i url:s html:s", IndexDef.on("pk", "page_id"), nullable=("url", "html")),
    _space("benchmark", "item_id:i text:s", IndexDef.on("pk", "item_id"), nullable=("text",)),
    _space("labels", "doc_id:i quality:i toxic:i", IndexDef.on("pk", "doc_id"), IndexDef.on("quality", "quality", unique=False)),
    _space("conversations", "conv_id:i turn:i role:s text:s", IndexDef.on("pk", "conv_id", "turn"), nullable=("role", "text")),
]


def engine_over(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    for s in SPACES:
        engine.attach(s, lambda s=s: spark.read.parquet(f"{sf_dir}/{s.name}.parquet"))
    # orders with a customer that is NULL now and then
    orders = next(s for s in SPACES if s.name == "orders")
    sparse = SpaceDef.of("orders_sparse", [FieldDef("o_orderkey", _I), FieldDef("x", _I, True), FieldDef("o_totalprice", _D)], [IndexDef.on("pk", "o_orderkey"), IndexDef.on("x", "x", unique=False)])
    engine.attach(sparse, lambda: spark.read.parquet(f"{sf_dir}/{orders.name}.parquet").select("o_orderkey", F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END").alias("x"), "o_totalprice"))
    return engine
