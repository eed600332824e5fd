import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from works_risk.plans import driver_tables as D

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert 0 < len(rows) <= 20


@pytest.mark.parametrize("name", ["clean_ids", "classify", "mp_rank", "block_pairs", "rate_window", "impute"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("nation", "customer", "orders", "lineitem", "events", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries()[name](spark, FOLDER)
    got = db.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    order = [names.index(c) for c in sorted(names)]
    assert mine == sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def test_plans_have_no_cross_join(spark):
    plans = [D.flags(spark, FOLDER), D.works(spark, FOLDER), queries()["block_pairs"](spark, FOLDER), queries()["pair_bands"](spark, FOLDER)]
    for df in plans:
        text = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    scan = D.sanctions(spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_linestatus:string,l_shipdate:timestamp_ntz>" in scan
