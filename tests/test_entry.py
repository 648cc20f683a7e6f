import decimal

import __spark_entry__


def test_every_oracle_has_its_query_and_the_flagship_runs(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) >= 130
    out = __spark_entry__.entry(spark)
    assert out.columns == ["o_orderkey", "o_custkey"] and out.count() == 10


def test_catalogue_against_duckdb(spark):
    import duckdb

    from shardwell import queries_kept
    from shardwell.queries import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda x: x.replace(tzinfo=None) if hasattr(x, "tzinfo") else float(x) if isinstance(x, decimal.Decimal) else round(x, 6) if isinstance(x, float) else x
    text = lambda rows: sorted(str([plain(x) for x in r]) for r in rows)
    for name in ("ge_first", "before_page", "null_le", "composite_lt", "json_path", "bucket_id", "upsert_many", "insert_many_errors", "shard_pruned", *queries_kept.QUERIES):
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, sf).select(*want.columns)
        assert text(map(tuple, got.collect())) == text(want.fetchall()), name
