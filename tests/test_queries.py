"""Every registered relational query against DuckDB."""

import math
import os

import duckdb
import pytest

from basalt import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{round(float(v), 3) + 0.0:.3f}"
    return str(list(v)) if hasattr(v, "__len__") else str(v).replace("+00:00", "")


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_duckdb(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    found = duck.execute(core.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in order] for r in df.collect())
    theirs = sorted([plain(dict(zip(names, r))[c]) for c in order] for r in found.fetchall())
    assert mine == theirs


def test_filters_reach_the_scan(spark):
    plan = core.engine(spark, SF).sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_ivf_recall(spark):
    from basalt.functions import vector
    from basalt.operators.relational import ivf_knn

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    total = hits = 0
    for r in df.filter("vec_id % 50 = 0").collect():
        exact = {x.vec_id for x in vector.knn(df, "embedding", list(r.embedding), 10, tie="vec_id").collect()}
        hits += len(exact & {x.vec_id for x in ivf_knn(df, "vec_id", "embedding", list(r.embedding), 10, cells=8, probes=6).collect()})
        total += 10
    assert hits >= 0.9 * total
