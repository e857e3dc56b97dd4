"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from palimpsest.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(str(plain(x)) for x in r) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_point_lookup_reaches_the_scan(spark):
    plan = QUERIES["kv_point_get"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,42)" in plan


@pytest.mark.parametrize("name", ["repl_apply_committed", "repl_consistency_committed", "repl_values_committed", "net_summary", "repl_commit_forked", "repl_reconcile", "repl_linearizable_reads", "net_suite"])
def test_whole_log_where_it_is_longer_than_a_prefix(spark, name):
    sf, con = "/root/testdata/sf0.1", duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE[name]).df()
    assert rows(got) == rows(want)
    if name == "repl_apply_committed":
        assert got["index"].max() > 90_000
