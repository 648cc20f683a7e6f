"""Planner and conditions, without Spark."""

import pytest

from shardwell import MISSING, FieldDef, IndexDef, Part, SpaceDef
from shardwell import errors as E
from shardwell.functions.bucket import crc32c, function_of, mpcrc32, register, strcrc32
from shardwell.functions.predicates import path_steps
from shardwell.operators.results import cut_objects, cut_rows, flatten, unflatten_rows
from shardwell.plans.conditions import parse
from shardwell.plans.planner import plan
from shardwell.stats import RateLimiter, Settings

CUSTOMERS = SpaceDef.of(
    "customers",
    [("id", "unsigned"), ("bucket_id", "unsigned"), ("name", "string"), ("last_name", "string"), ("age", "number"), ("city", "string")],
    [IndexDef.on("id", "id"), IndexDef.on("age", "age", unique=False), IndexDef.on("full_name", Part("name", "unicode_ci"), Part("last_name", is_nullable=True), unique=False), None, IndexDef.on("hash", "city", type="HASH")],
)


@pytest.mark.parametrize(
    ("given", "text"),
    [
        ("x", 'Conditions should be table, got "string"'), ([5], 'Each condition should be table, got "number" (condition 1)'), ([("==",)], "Each condition should be"), ([("==", "a", 1, 2)], "Each condition should be"),
        ([(1, "a", 1)], 'condition[1] should be string, got "number"'), ([("!=", "a", 1)], "isn't a valid condition operator"), ([("==", "a", 1), ("==", 5, 1)], 'condition[2] should be string, got "number" (condition 2)'),
    ],
)
def test_parse_errors(given, text):
    with pytest.raises(E.ParseConditionError) as e:
        parse(given)
    assert text in e.value.text


def test_missing_is_not_none():
    a, b, c = parse([("<", "age"), ("<", "age", None), ("<", "age", MISSING)])
    assert a.values == c.values == () and b.values == (None,)
    assert parse(None) == []


def test_first_condition_that_an_index_serves_gives_the_order():
    p = plan(CUSTOMERS, parse([(">", "city", "x"), ("<=", "age", 5), ("==", "id", 1)]))
    assert (p.index.name, p.scan, p.descending, [k.field for k in p.key]) == ("age", 1, True, ["age", "id"])
    p = plan(CUSTOMERS, parse([("==", "name", "x")]))
    assert p.index.name == "full_name" and [k.field for k in p.key] == ["name", "last_name", "id"]
    p = plan(CUSTOMERS, [])
    assert (p.index.name, p.scan, p.operator) == ("id", None, ">=")


def test_backward_page_demotes_a_range_and_keeps_an_equality():
    after = {"id": 3, "age": 5, "name": "a", "last_name": "b"}
    assert plan(CUSTOMERS, parse([(">=", "age", 5)]), first=-2, after=after).scan is None
    assert plan(CUSTOMERS, parse([("==", "age", 5)]), first=-2, after=after).scan == 0
    with pytest.raises(E.SelectError, match="Negative first"):
        plan(CUSTOMERS, [], first=-2)


def test_fields_are_enriched_and_after_follows_them():
    p = plan(CUSTOMERS, parse([(">=", "age", 5)]), fields=["name"], after=("n", 44, 7))
    assert p.fields == ("name", "age", "id") and p.after == (44, 7)
    with pytest.raises(E.FilterFieldsError, match="doesn't contain field named \"no\""):
        plan(CUSTOMERS, [], fields=["no"])


def test_errors_of_indexes_and_types():
    with pytest.raises(E.NoIndexesError):
        plan(SpaceDef.of("s", [("id", "unsigned")], []), [])
    with pytest.raises(E.IndexTypeError):
        plan(SpaceDef.of("s", [("id", "unsigned")], [IndexDef.on("id", "id", type="HASH")]), [])
    with pytest.raises(E.SelectError, match="does not match index part type"):
        plan(CUSTOMERS, parse([("==", "id", "x")]))
    with pytest.raises(E.UnsupportedCollationError):
        Part("a", "klingon")


def test_sharding_key_from_conditions():
    s = SpaceDef.of("s", [("id", "unsigned"), ("name", "string"), ("age", "number")], [IndexDef.on("id", "id"), IndexDef.on("three", "age", "name", "id")], sharding_key=("name", "age"))
    assert plan(s, parse([("==", "three", [5, "x"])])).sharding_key == ("x", 5)
    assert plan(s, parse([("==", "three", [5]), ("==", "name", "y")])).sharding_key == ("y", 5)
    assert plan(s, parse([("==", "three", [5])])).sharding_key is None
    assert plan(s, parse([(">", "name", "y"), ("==", "age", 1)])).sharding_key is None
    assert plan(s, parse([("==", "three", [5, "x"])]), bucket_id=1).sharding_key is None


def test_default_buckets():
    assert [strcrc32(i) for i in range(1, 8)] == [477, 401, 2804, 1161, 1172, 1064, 693]
    assert [strcrc32(i) for i in (8, 9, 10, 22, 71, 92)] == [185, 1644, 569, 655, 1802, 2040]
    assert (strcrc32("Ptolemy"), strcrc32("Dimitrion"), strcrc32(("Viktor Pelevin", 58)), strcrc32(19)) == (234, 596, 2310, 1325)
    assert (strcrc32(1, 30000), strcrc32(2, 30000), mpcrc32(1)) == (12477, 21401, 1614)
    assert crc32c(b"123456789") ^ 0xFFFFFFFF == 0xE3069283
    register("mine", lambda key: key[0] % 10)
    assert function_of("mine")((27,)) == 7
    with pytest.raises(E.ShardingFuncError):
        function_of("nobody.knows")


def test_paths():
    assert path_steps('[3]["f2"][\'f3\']') == [3, "f2", "f3"] and path_steps("[6].a.b") == [6, "a", "b"] and path_steps('["age"]') == ["age"]
    with pytest.raises(E.GenFiltersError):
        path_steps("[6].a b")


def test_client_helpers():
    meta = [{"name": "id", "type": "unsigned"}, {"name": "age", "type": "number", "is_nullable": True}]
    assert cut_rows([(1, 2)], meta, ["id"]).rows() == [(1,)]
    with pytest.raises(E.FilterFieldsError):
        cut_rows([(1, 2)], meta, ["age"])
    assert cut_objects([{"id": 1, "age": 2}], ["age"]) == [{"age": 2}]
    assert unflatten_rows([(1, None)], meta) == [{"id": 1, "age": None}]
    for bad in ([(None, 1)], meta), ([(1, 1)], None):
        with pytest.raises(E.UnflattenError):
            unflatten_rows(*bad)
    row = {"id": 1, "name": "a", "last_name": "b", "age": 2, "city": "c"}
    assert flatten(row, CUSTOMERS, 7) == (1, 7, "a", "b", 2, "c")
    with pytest.raises(E.FlattenError, match="Unknown field"):
        flatten(row | {"x": 1}, CUSTOMERS)
    with pytest.raises(E.FlattenError, match="isn't nullable"):
        flatten({"id": 1}, CUSTOMERS)
    assert flatten({"id": 1}, CUSTOMERS, skip_nullability_check=True) == (1, None, None, None, None, None)


def test_settings_and_rate_limiter():
    assert Settings().changed(stats=True).stats and not Settings().stats
    with pytest.raises(E.CfgError):
        Settings().changed(stats="yes")
    with pytest.raises(TypeError):
        Settings().changed(nothing=1)
    now = [0.0]
    r = RateLimiter(60, 2, clock=lambda: now[0])
    assert [r.allow()[0] for _ in range(4)] == [True, True, False, False]
    now[0] = 61
    assert r.allow() == (True, 2)


def test_field_types():
    assert FieldDef("a", "unsigned").data_type.typeName() == "long" and FieldDef("a", "any").data_type.typeName() == "variant"
