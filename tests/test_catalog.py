"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from chunkspark.catalog import QUERIES, SQL

#: Queries with SQL that may return no rows here.
MAY_BE_EMPTY = {"p9_composite_keys"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    assert len(found) or name in MAY_BE_EMPTY
    want = want[list(found.columns)]
    assert sorted(map(str, found.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_diff_has_every_state(spark, sf_dir):
    assert {r.state for r in QUERIES["j2_sync_diff"](spark, sf_dir).collect()} == {"added", "modified", "deleted", "unchanged"}


def test_metrics_rank_differently(spark, sf_dir):
    l2, cosine, ip = ([r.vec_id for r in QUERIES[n](spark, sf_dir).collect()] for n in ("k1_knn_l2", "k2_knn_cosine", "k3_knn_ip"))
    assert l2 != cosine and l2 != ip
    assert QUERIES["p5_post_filter"](spark, sf_dir).count() < QUERIES["p6_pre_filter"](spark, sf_dir).count() == 10


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["p10_point_lookup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src7)]" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    assert "TakeOrderedAndProject" in QUERIES["k1_knn_l2"](spark, sf_dir)._jdf.queryExecution().toString()
