"""Every query that has SQL, against DuckDB over the same tables; plans that must not hold a cartesian product."""

import math

import duckdb
import pytest

from skylattice.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(([plain(v) for v in row] for row in got.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["pair_gate_hour", "pair_gate_grid", "radius_or_knn_edges", "nearest_gt", "asof_interpolate", "kalman_fold", "ema"])
def test_plans(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name in ("kalman_fold", "ema", "asof_interpolate"):
        assert "Python" not in plan and "Pandas" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "ReadSchema: struct<event_type:string,value:double>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
