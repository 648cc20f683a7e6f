"""Index-order semantics on small tables, held against a plain Python model."""

import datetime as dt
import decimal
import itertools
import random

import pytest
from pyspark.sql import types as T

from shardwell import Engine, FieldDef, IndexDef, Part, SpaceDef
from shardwell import errors as E

NULL_LOW = lambda v: (v is not None, v if v is not None else 0)


def rank(v):
    return (0, 0) if v is None else (1, v)


def attach(spark, fields, indexes, rows, name="t", **more):
    e = Engine(spark)
    s = SpaceDef.of(name, fields, indexes, **more)
    e.attach(s, spark.createDataFrame(rows, s.schema()))
    return e


VALUES = {
    "number": [1.0, 2.5, 7.0], "string": ["a", "b", "c"], "boolean": [False, True, True], "decimal": [decimal.Decimal(f"123456789012345678.9874312346783{x}") for x in (1, 2, 3)],
    "uuid": ["11111111-1111-4111-8111-111111111111", "22222222-1111-4111-8111-111111111111", "33333333-1111-4111-8111-111111111111"], "datetime": [dt.datetime(2024, 3, d) for d in (10, 11, 12)],
}


@pytest.mark.parametrize("kind", sorted(VALUES))
@pytest.mark.parametrize("indexed", [True, False])
@pytest.mark.parametrize("nullable", [True, False])
def test_null_matrix(spark, kind, indexed, nullable):
    values = VALUES[kind]
    rows = [(n, v) for n, v in enumerate([*values, *([None, None] if nullable else [])], 1)]
    indexes = [IndexDef.on("pk", "id")] + [IndexDef.on("f", "field", unique=False)] * indexed
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("field", kind, nullable)], indexes, rows)
    test = {"==": lambda x, v: rank(x) == rank(v), "<": lambda x, v: rank(x) < rank(v), "<=": lambda x, v: rank(x) <= rank(v), ">": lambda x, v: rank(x) > rank(v), ">=": lambda x, v: rank(x) >= rank(v)}
    frames, wants = [], []
    for op, f in test.items():
        for v in (values[1], None):
            frames.append(e.select("t", [(op, "field", v)], fullscan=True))
            want = [r for r in rows if f(r[1], v)]
            if indexed:
                want.sort(key=lambda r: (rank(r[1]), r[0]), reverse=op in ("<", "<="))
            wants.append([r[0] for r in want])
        frames.append(e.select("t", [(op, "field")], fullscan=True))
        want = sorted(rows, key=lambda r: (rank(r[1]), r[0]) if indexed else r[0], reverse=indexed and op in ("<", "<="))
        wants.append([r[0] for r in want])
    from functools import reduce

    from pyspark.sql import functions as F

    every = reduce(lambda a, b: a.unionByName(b), [r.df.select("id", F.lit(n).alias("n"), F.monotonically_increasing_id().alias("at")) for n, r in enumerate(frames)]).collect()
    for n, want in enumerate(wants):
        assert [r["id"] for r in sorted((r for r in every if r["n"] == n), key=lambda r: r["at"])] == want, n


def test_interval_conditions_are_refused(spark):
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("i", "interval", True)], [IndexDef.on("pk", "id")], [(1, dt.timedelta(1)), (2, None)])
    with pytest.raises(E.GenFiltersError, match="interval conditions are not supported"):
        e.select("t", [("==", "i", dt.timedelta(1))])
    assert [r[0] for r in e.select("t", [("==", "i", None)]).rows()] == [2]


def test_composite_and_prefix_against_tuples(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])) for n in range(40)]
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("a", "integer", True), FieldDef("b", "integer", True)], [IndexDef.on("pk", "id"), IndexDef.on("ab", "a", "b", unique=False)], rows)
    ops = {"==": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    for op, values in itertools.product(ops, ([2, 1], [2, None], [None, 1], [2], [None])):
        want = [r for r in rows if ops[op](tuple(map(rank, r[1:]))[: len(values)], tuple(map(rank, values)))]
        want.sort(key=lambda r: (rank(r[1]), rank(r[2]), r[0]), reverse=op in ("<", "<="))
        assert [r[0] for r in e.select("t", [(op, "ab", values)], fullscan=True).rows()] == [r[0] for r in want], (op, values)


@pytest.mark.parametrize("conditions", [None, [("<=", "x", 2)], [(">", "x", None)], [("==", "x", 1)]])
def test_pages_make_the_whole_and_turn_round(spark, conditions):
    rng = random.Random(3)
    rows = [(n, rng.choice([None, None, 0, 1, 2, 3])) for n in range(30)]
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("x", "integer", True)], [IndexDef.on("pk", "id"), IndexDef.on("x", "x", unique=False)], rows)
    whole = e.select("t", conditions, fullscan=True).rows()
    got, after = [], None
    while page := e.select("t", conditions, first=7, after=after).rows():
        got += page
        after = page[-1]
    assert got == whole
    if len(whole) > 6:
        at = len(whole) // 2
        assert e.select("t", conditions, first=-3, after=whole[at]).rows() == whole[at - 3 : at]
        assert e.select("t", conditions, first=-100, after=whole[at]).rows() == whole[:at]


CUSTOMERS = [(1, "Elizabeth", "Jackson", "New York"), (2, "Mary", "Brown", "oxford"), (3, "elizabeth", "Adams", "Oxford"), (4, "William", "White", "oxford"), (5, "Jack", "Sparrow", "London"), (6, "Élizabeth", "Brown", "x")]


def test_collation_depends_on_the_role(spark):
    e = attach(spark, [("id", "unsigned"), ("name", "string"), ("last_name", "string"), ("city", "string")], [IndexDef.on("pk", "id"), IndexDef.on("full_name", Part("name", "unicode_ci"), Part("last_name", "unicode_ci"), unique=False)], CUSTOMERS)
    assert [r[0] for r in e.select("t", [("==", "name", "Elizabeth")]).rows()] == [3, 6, 1]
    assert [r[0] for r in e.select("t", [(">=", "id", 1), ("==", "name", "Elizabeth")], fullscan=True).rows()] == [1]
    assert [r[0] for r in e.select("t", [(">=", "id", 1), ("==", "full_name", "ELIZABETH")], fullscan=True).rows()] == [1, 3, 6]
    assert [r[0] for r in e.select("t", [("==", "city", "oxford")], fullscan=True).rows()] == [2, 4]


def test_paths_into_variants_and_structs(spark):
    e = Engine(spark)
    s = SpaceDef.of("d", [("id", "unsigned"), ("additional", "any")], [IndexDef.on("pk", "id")])
    texts = [(1, '{"a":{"b":140}}'), (2, '{"a":{"b":120}}'), (3, "{}"), (4, '{"a":{"b":50}}'), (5, '{"a":55}')]
    e.attach(s, spark.createDataFrame(texts, "id long, t string").selectExpr("id", "parse_json(t) AS additional"))
    assert [r[0] for r in e.select("d", [(">=", "[2].a.b", 55)], fullscan=True).rows()] == [1, 2]
    assert [r[0] for r in e.select("d", [("<", '["additional"].a.b', 55)], fullscan=True).rows()] == [3, 4, 5]
    data = T.StructType([T.StructField("car", T.StructType([T.StructField("color", T.StringType()), T.StructField("model", T.StringType())]))])
    cars = SpaceDef.of("c", [FieldDef("id", "unsigned"), FieldDef("data", "map", spark_type=data)], [IndexDef.on("pk", "id"), IndexDef.on("data_index", Part("data", path="car.color", type="string"), Part("data", path="car.model", type="string"), unique=False)])
    e.attach(cars, spark.createDataFrame([(1, (("Yellow", "BMW"),)), (2, (("Black", "Audi"),)), (3, (("Yellow", "Ford"),))], cars.schema()))
    assert [r[0] for r in e.select("c", [("==", "data_index", ["Yellow"])], fullscan=True).rows()] == [1, 3]
    page = e.select("c", [("==", "data", ["Yellow"])], first=1, fields=["id"])
    assert [m["name"] for m in page.metadata] == ["id", "data"]
    assert [r[0] for r in e.select("c", [("==", "data_index", ["Yellow"])], first=1, after=page.rows()[0], fields=["id"]).rows()] == [3]


def test_borders_take_rows_nulls_and_ties(spark):
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("age", "integer", True)], [IndexDef.on("pk", "id"), IndexDef.on("age", "age", unique=False)], [(1, 33), (2, 33), (3, 10), (4, None)])
    assert e.max("t", "age").rows() == [(2, 33)] and e.min("t", "age").rows() == [(4, None)] and e.min("t").rows() == [(1, 33)] and e.max("t", 0, fields=["age"]).rows() == [(None,)]
    with pytest.raises(E.BorderError):
        e.min("t", "nope")
    empty = attach(spark, [FieldDef("id", "unsigned")], [IndexDef.on("pk", "id")], [])
    assert empty.min("t").rows() == [] and empty.count("t", fullscan=True) == 0 and empty.len("t") == 0 and empty.select("t").rows() == []


def test_pairs_count_len_and_the_full_scan_warning(spark, caplog):
    e = attach(spark, [FieldDef("id", "unsigned"), FieldDef("age", "integer")], [IndexDef.on("pk", "id"), IndexDef.on("age", "age", unique=False)], [(n, n % 3) for n in range(9)])
    assert list(e.pairs("t", [("==", "age", 1)], use_tomap=True)) == [{"id": n, "age": 1} for n in (1, 4, 7)]
    assert e.count("t", [(">", "age", 0)], fullscan=True) == 6 and e.len("t") == 9
    with pytest.raises(E.SelectError):
        e.pairs("t", first=-1)
    with pytest.raises(TypeError):
        e.select("t", nothing=1)
    with pytest.raises(E.SelectError, match="batch_size"):
        e.select("t", batch_size=0)
    with pytest.raises(E.SelectError, match="doesn't exist"):
        e.select("no")
    caplog.clear()
    e.select("t", first=10), e.select("t", [("==", "age", 1)]), e.select("t", fullscan=True)
    assert not caplog.records
    e.select("t"), e.count("t")
    assert [r.levelname for r in caplog.records] == ["CRITICAL"] * 2


def test_filters_reach_the_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS a", "id % 5 AS b").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    s = SpaceDef.of("t", [FieldDef("id", "unsigned"), FieldDef("a", "integer", True), FieldDef("b", "integer")], [IndexDef.on("pk", "id"), IndexDef.on("ab", "a", "b", unique=False)])
    e.attach(s, lambda: spark.read.parquet(str(tmp_path / "t")))
    text = e.select("t", [(">=", "ab", [3, 2])], first=5, fields=["id"]).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "PushedFilters: [Or(" in text
    text = e.count_frame("t", [("==", "b", 2)])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in text and "Sort" not in text
