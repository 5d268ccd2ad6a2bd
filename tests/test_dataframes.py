"""DataFrame-level operators: semantics columns, vectors, quantified comparisons, sources, windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basalt.functions import pg, vector
from basalt.operators.relational import quantified
from basalt.sources import snapshots
from basalt.streaming import windows


def test_pg_columns(spark):
    row = spark.range(1).select(
        pg.float_to_int(F.lit(2.5)), pg.round_half_away(F.lit(-1.005), 1), pg.text_to_bool(F.lit("on")), pg.concat(F.lit("a"), F.lit(None), F.lit(1)), pg.substring(F.lit("hello"), F.lit(0), F.lit(3)), pg.left(F.lit("hello"), F.lit(-1)), pg.right(F.lit("hello"), F.lit(-4))
    ).first()
    assert tuple(row) == (3, -1.0, True, "a1", "he", "hell", "o")
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in df.orderBy(pg.order(F.col("x"), descending=True)).collect()] == [None, 2, 1]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [10.0, 10.0]), (5, None)], "id int, pos array<float>")
    assert [r.id for r in vector.knn(df, "pos", [1.5, 1.5], 3, tie="id").collect()] == [2, 3, 1]
    assert [r.id for r in vector.knn(df, "pos", [1.0, 0.0], 4, "cosine", tie="id").collect()] == [2, 3, 4, 1]
    assert spark.range(1).select(vector.text(vector.parse(F.lit("[1, 2.5]")))).first()[0] == "[1,2.5]"
    for bad in ("[]", "x", "[1,NaN]"):
        with pytest.raises(Exception):
            spark.range(1).select(vector.parse(F.lit(bad))).collect()
    with pytest.raises(Exception):
        df.select(vector.l2(F.col("pos"), vector.literal([1.0]))).collect()


@pytest.mark.parametrize("values", [[], [1, 2], [2, 2], [1, None], [None]])
@pytest.mark.parametrize("op", [">", ">=", "<", "<=", "=", "<>"])
def test_quantified(spark, values, op):
    xs = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "x int")
    some = spark.createDataFrame([(v,) for v in values], "v int")
    every = op != "<>"
    got = {r.x: r.q for r in xs.select("x", quantified(xs, F.col("x"), op, some, every).alias("q")).collect()}
    test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}[op]
    for x, q in got.items():
        each = [None if x is None or v is None else test(x, v) for v in values]
        stop = not every
        want = stop if stop in each else None if None in each else every
        assert q is want or q == want, (x, op, values, q, want)


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for f in ("parquet", "orc", "json"):
        snapshots.write(df, f"{tmp_path}/{f}", f)
        assert sorted(map(tuple, snapshots.read(spark, f"{tmp_path}/{f}", f, df.schema).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        snapshots.read(spark, "x", "exe")


def test_sliding_windows(spark):
    at = dt.datetime(2024, 1, 1, 0, 30)
    df = spark.createDataFrame([(at, "a", 1.0), (at + dt.timedelta(minutes=45), "a", 2.0)], "ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in windows.windowed(df, "1 hour", "30 minutes").collect()) == [(1, 1.0), (1, 2.0), (2, 3.0)]
