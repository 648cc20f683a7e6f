"""Snapshots, writes, batch errors, read views, sharding and introspection."""

import pytest

from shardwell import Engine, FieldDef, IndexDef, SpaceDef
from shardwell import errors as E
from shardwell.functions.bucket import bucket_column, integer_bucket, strcrc32, text_column
from shardwell.operators import bulk
from shardwell.streaming import changes

CUSTOMERS = SpaceDef.of("customers", [("id", "unsigned"), ("bucket_id", "unsigned"), ("name", "string"), ("age", "number", True)], [IndexDef.on("id", "id"), IndexDef.on("bucket_id", "bucket_id", unique=False), IndexDef.on("age", "age", unique=False)])
DEVELOPERS = SpaceDef.of("developers", [("id", "unsigned"), ("bucket_id", "unsigned"), ("login", "string")], [IndexDef.on("id", "id"), IndexDef.on("login", "login")])


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), shards=2)
    e.create(CUSTOMERS)
    e.create(DEVELOPERS)
    return e


def ids(result):
    return [r[0] for r in result.rows()]


def test_single_rows(engine):
    row = [1, None, "Ann", 5]
    assert engine.insert("customers", row).rows() == [(1, 477, "Ann", 5)] and row == [1, None, "Ann", 5]
    with pytest.raises(E.EngineError, match="Duplicate key exists"):
        engine.insert("customers", [1, None, "Bob", 6])
    assert engine.insert_object("customers", {"id": 2, "name": "Bob"}, fields=["name", "age"]).rows() == [("Bob", None)]
    assert engine.replace("customers", [1, None, "Eve", 7], noreturn=True) is None
    assert engine.get("customers", 1).rows() == [(1, 477, "Eve", 7.0)] and engine.get("customers", 9).rows() == []
    assert engine.update("customers", 1, [("+", "age", 3), ("=", 3, "Zoe")]).rows() == [(1, 477, "Zoe", 10.0)]
    assert engine.update("customers", 9, [("+", "age", 3)]).rows() == []
    assert engine.upsert("customers", [1, None, "x", 1], [("-", "age", 4)]).rows() == [] and engine.get("customers", 1, fields=["age"]).rows() == [(6.0,)]
    engine.upsert_object("customers", {"id": 3, "name": "Kim", "age": 1}, [("=", "age", 100)])
    assert ids(engine.select("customers", fullscan=True)) == [1, 2, 3]
    assert engine.delete("customers", 2).rows() == [(2, 401, "Bob", None)] and engine.delete("customers", 2).rows() == []
    assert ids(engine.select("customers", fullscan=True)) == [1, 3] and engine.len("customers") == 2
    for bad, text in (([1], "got nil"), (["x", None, "a", 1], "type does not match"), ([-1, None, "a", 1], "type does not match"), ([5, 0, "a", 1], "Invalid bucket_id in data")):
        with pytest.raises(E.EngineError, match=text):
            engine.insert("customers", bad)
    with pytest.raises(E.BucketIDError, match="different bucket_id values"):
        engine.insert("customers", [5, 7, "a", 1], bucket_id=8)
    with pytest.raises(E.EngineError, match="primary index"):
        engine.update("customers", 1, [("=", "id", 3)])
    with pytest.raises(E.ParseOperationsError):
        engine.update("customers", 1, [("=", "no", 3)])
    with pytest.raises(TypeError):
        engine.upsert_object("customers", {"id": 1}, [], skip_nullability_check_on_flatten=True)
    assert engine.truncate("customers") and engine.len("customers") == 0


def test_batches_go_on_stop_or_roll_back(engine):
    shard = lambda i: engine._placement(DEVELOPERS).shard(strcrc32(i))
    one = [i for i in range(1, 40) if shard(i) == 1][:5]
    other = [i for i in range(1, 40) if shard(i) == 2][:2]
    rows = lambda: [[one[0], None, "a"], [one[1], None, "b"], [one[2], None, "a"], [one[3], None, "c"], [other[0], None, "a"]]
    result, errors = engine.insert_many("developers", rows())
    assert ids(result) == [one[0], one[1], one[3], other[0]]  # a login is unique within its shard
    assert [(e.class_name, e.operation_data[0]) for e in errors] == [("DuplicateKeyError", one[2])]
    engine.truncate("developers")
    result, errors = engine.insert_many("developers", rows(), stop_on_error=True)
    assert ids(result) == [one[0], one[1], other[0]] and [(e.class_name, e.operation_data[0]) for e in errors] == [("DuplicateKeyError", one[2]), ("NotPerformedError", one[3])]
    engine.truncate("developers")
    result, errors = engine.insert_many("developers", rows(), rollback_on_error=True)
    assert ids(result) == [other[0]] and sorted((e.text, e.operation_data[0]) for e in errors if e.class_name == "NotPerformedError") == sorted(("Operation with tuple was rollback", i) for i in (one[0], one[1], one[3]))
    engine.truncate("developers")
    result, errors = engine.insert_many("developers", rows()[:4], stop_on_error=True, rollback_on_error=True)
    assert result is None and len(errors) == 4 and engine.len("developers") == 0
    with pytest.raises(E.InsertManyError, match="At least one tuple"):
        engine.insert_many("developers", [])
    result, errors = engine.insert_object_many("developers", [{"id": one[0], "login": "q"}, {"id": one[1]}, {"id": one[2], "login": "r", "x": 1}])
    assert ids(result) == [one[0]] and [e.class_name for e in errors] == ["InsertManyError"] * 2
    result, errors = engine.replace_many("developers", [[one[0], None, "new"], [one[0], None, "newer"]])
    assert errors is None and engine.get("developers", one[0], fields=["login"]).rows() == [("newer",)]


def test_upserts_fold_within_a_batch(engine):
    result, errors = engine.upsert_many("customers", [([1, None, "a", 1], [("+", "age", 10)]), ([1, None, "a", 1], [("+", "age", 10)]), ([2, None, "b", 2], [("=", "name", "c")])])
    assert errors is None and result.rows() == []
    assert engine.select("customers", fullscan=True, fields=["id", "name", "age"]).rows() == [(1, "a", 11.0), (2, "b", 2.0)]
    engine.upsert_object_many("customers", [[{"id": 2, "name": "z"}, [("=", "name", "c"), ("+", "age", 1)]]])
    assert engine.get("customers", 2, fields=["name", "age"]).rows() == [("c", 3.0)]


def test_only_touched_files_are_written_anew(engine):
    for n in range(1, 7):
        engine.insert("customers", [n, None, "x", n])
    before = set(engine.store.snapshot("customers").of())
    engine.update("customers", 3, [("=", "name", "y")])
    after = set(engine.store.snapshot("customers").of())
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    got = changes(engine, "customers", engine.store.version("customers") - 1).select("id", "name", "change").collect()
    assert sorted(map(tuple, got)) == [(3, "x", -1), (3, "y", 1)]


def test_read_views_keep_their_moment(engine):
    engine.insert("customers", [1, None, "a", 1])
    view = engine.readview(name="v")
    engine.replace("customers", [1, None, "b", 1])
    engine.insert("customers", [2, None, "c", 1])
    assert engine.vacuum("customers") == 0
    assert [r[2] for r in view.select("customers", fullscan=True).rows()] == ["a"] and [r["name"] for r in view.pairs("customers", use_tomap=True)] == ["a"]
    with pytest.raises(E.SelectError, match="Readview does not support 'mode' option"):
        view.select("customers", mode="read")
    view.close(), view.close()
    with pytest.raises(E.ReadviewError, match="Read view is closed"):
        view.select("customers")
    assert engine.vacuum("customers") == 1 and ids(engine.select("customers", fullscan=True)) == [1, 2]


def test_two_writers_of_one_version(engine):
    engine.insert("customers", [1, None, "a", 1])
    base = engine.store.snapshot("customers")
    engine.store.commit("customers", base, base.files)
    with pytest.raises(E.CommitConflictError):
        engine.store.commit("customers", base, base.files)


def test_sharding(spark, tmp_path, engine):
    engine.insert_many("customers", [[n, None, "x", n] for n in range(1, 9)])
    engine.cfg(stats=True)
    plan = engine.select("customers", [("==", "id", 3)]).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan and "details" not in engine.stats("customers").get("select", {})  # one shard: no map-reduce
    engine.select("customers", [(">", "id", 3)], fullscan=True)
    assert engine.stats("customers")["select"]["details"]["map_reduces"] == 1
    assert sorted(ids(engine.select("customers", fullscan=True, bucket_id=477)) + ids(engine.select("customers", fullscan=True, bucket_id=2804))) == list(range(1, 9))
    keyed = SpaceDef.of("keyed", [("id", "unsigned"), ("bucket_id", "unsigned"), ("name", "string"), ("age", "number")], [IndexDef.on("id", "id")], sharding_key=("name",))
    engine.create(keyed)
    assert engine.insert("keyed", [1, None, "Ptolemy", 20]).rows() == [(1, 234, "Ptolemy", 20)]
    for call in (lambda: engine.get("keyed", 1), lambda: engine.delete("keyed", 1), lambda: engine.update("keyed", 1, [("=", "age", 1)])):
        with pytest.raises(E.ShardingKeyError, match="missed in primary index"):
            call()
    assert engine.get("keyed", 1, bucket_id=234).rows() == [(1, 234, "Ptolemy", 20.0)]
    mod = SpaceDef.of("mod", [("id", "unsigned"), ("bucket_id", "unsigned")], [IndexDef.on("id", "id")], sharding_func=lambda key: key[0] % 10 + 1)
    engine.create(mod)
    assert engine.insert("mod", [27]).rows() == [(27, 8)]
    first = SpaceDef.of("first", [("bucket_id", "unsigned"), ("id", "unsigned")], [IndexDef.on("pk", "bucket_id", "id")], sharding_key=("id",))
    engine.create(first)
    engine.insert("first", [None, 1])
    assert engine.get("first", [None, 1]).rows() == [(477, 1)]


def test_bucket_column_agrees_with_python(spark):
    rows = [(1, "Ptolemy"), (58, "Виктор"), (7, ""), (123456789, "é😀")]
    df = spark.createDataFrame(rows, "n long, s string")
    got = df.select(bucket_column([text_column(df["n"])]).alias("a"), bucket_column([df["s"], text_column(df["n"])]).alias("b"), bucket_column([df["s"]]).alias("c")).collect()
    assert [tuple(r) for r in got] == [(strcrc32(n), strcrc32((s, n)), strcrc32(s)) for n, s in rows]


def test_integer_buckets_agree_with_python(spark):
    values = [0, 1, -1, 9, 10, 58, 123456789, -123456789012, 2**63 - 1, -(2**63), *range(990, 1010)]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert [r[0] for r in df.select(integer_bucket(df["n"])).collect()] == [strcrc32(v) for v in values]


def test_two_racing_writers(engine):
    import threading

    engine.insert("customers", [1, None, "a", 1])
    base, done, failed = engine.store.snapshot("customers"), [], []
    gate = threading.Barrier(8)

    def write():
        gate.wait()
        try:
            done.append(engine.store.commit("customers", base, base.files))
        except E.CommitConflictError as e:
            failed.append(e)

    threads = [threading.Thread(target=write) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(failed) == 7 and engine.store.snapshot("customers").of() == base.of()


def test_a_large_batch_takes_seconds(engine):
    import time

    began = time.monotonic()
    result, errors = engine.insert_many("developers", [[n, None, f"login{n}"] for n in range(1, 10_001)])
    assert errors is None and len(result) == 10_000 and engine.len("developers") == 10_000
    result, errors = engine.replace_many("developers", [[n, None, f"other{n}"] for n in range(1, 10_001)])
    assert errors is None and engine.len("developers") == 10_000 and time.monotonic() - began < 60


def test_load_looks_keys_up(spark, engine):
    engine.load("developers", spark.range(1, 50).selectExpr("id", "concat('n', id) AS login"))
    for rows in (spark.range(40, 60).selectExpr("id", "concat('m', id) AS login"), spark.createDataFrame([(90, "x"), (90, "y")], "id long, login string")):
        with pytest.raises(E.EngineError, match="Duplicate key exists"):
            engine.load("developers", rows)
    assert engine.len("developers") == 49
    pairs = SpaceDef.of("pairs", [("a", "unsigned"), ("b", "string"), ("bucket_id", "unsigned"), ("v", "number", True)], [IndexDef.on("pk", "a", "b")])
    engine.create(pairs)
    engine.insert_many("pairs", [[n, f"b{n % 7}", None, n] for n in range(2000)])
    result, errors = engine.insert_many("pairs", [[n, f"b{n % 7}", None, n] for n in range(1990, 2010)])
    assert len(errors) == 10 and len(result) == 10 and engine.len("pairs") == 2010


def test_introspection_and_statistics(engine):
    engine.cfg(stats=True, stats_driver="metrics", stats_quantiles=True)
    engine.insert("customers", [1, None, "a", 1])
    with pytest.raises(E.EngineError):
        engine.insert("customers", [1, None, "a", 1])
    list(engine.pairs("customers"))
    s = engine.stats("customers")
    assert s["insert"]["ok"]["count"] == s["insert"]["error"]["count"] == s["select"]["ok"]["count"] == 1 and s["select"]["details"]["tuples_fetched"] == 1 and s["insert"]["ok"]["latency_quantile_recent"] > 0
    assert engine.reset_stats() and engine.stats() == {"spaces": {}}
    shown = engine.schema("customers")
    assert shown["format"][1] == {"name": "bucket_id", "type": "unsigned", "is_nullable": True} and [i["name"] for i in shown["indexes"].values()] == ["id", "age"]
    with pytest.raises(E.SchemaError):
        engine.schema("_hidden")
    info = engine.storage_info()
    assert sum(v["files"].get("customers", 0) for v in info.values()) == 1 and all(v["status"] == "running" for v in info.values())
    found = engine.locate("customers", 1)
    assert found["bucket_id"] == 477 and "customers" in found["file"] and engine.locate("customers", 5) is None
    assert engine.router_cache_clear()


def test_formats_grow_by_nullable_fields(engine):
    engine.insert("customers", [1, None, "a", 1])
    engine.alter(SpaceDef.of("customers", [*CUSTOMERS.fields, FieldDef("extra", "string", True)], CUSTOMERS.indexes))
    engine.insert("customers", [2, None, "b", 2, "new"])
    assert engine.select("customers", fullscan=True, fields=["id", "extra"]).rows() == [(1, None), (2, "new")]
    assert engine.update("customers", 1, [("=", "extra", "set")]).rows()[0][-1] == "set"
    with pytest.raises(E.SchemaError):
        engine.alter(CUSTOMERS)


def test_load_and_bulk(spark, engine):
    engine.load("customers", spark.range(1, 200).selectExpr("id", "concat('n', id) AS name", "cast(id AS double) AS age"))
    assert engine.len("customers") == 199 and engine.get("customers", 7).rows() == [(7, 693, "n7", 7.0)]
    table = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    batch = spark.createDataFrame([(2, 5, 0), (2, 6, 1), (3, 7, 2), (3, 8, 3)], "k long, v long, ordinal long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bulk.replace(table, batch, ["k"])) == [(1, 10), (2, 6), (3, 8)]
    good, bad = bulk.insert(table, batch, ["k"])
    assert rows(good) == [(1, 10), (2, 20), (3, 7)] and rows(bad.select("k", "v")) == [(2, 5), (2, 6), (3, 8)]
    from pyspark.sql import functions as F

    assert rows(bulk.upsert(table, batch, ["k"], {"v": bulk.Adding(F.lit(1))})) == [(1, 10), (2, 22), (3, 8)]
    assert rows(bulk.delete(table, spark.createDataFrame([(2,), (2,)], "k long"), ["k"])) == [(1, 10)]
