"""Dense vectors: arrays of float with the three distances, exact k nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """'[1,2,3]' -> array; at least one finite element, else an error."""
    v = F.from_json(text, "array<float>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(text.isNull(), F.lit(None)).when(bad, F.raise_error(F.concat(F.lit("invalid vector: "), text)).cast("array<float>")).otherwise(v)


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)).cast("float") for v in values))


def text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda e: F.regexp_replace(e.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error("different vector dimensions").cast("double")).otherwise(value)


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))))


def inner(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(a, b, lambda x, y: x * y))


def negative_inner(a: Column, b: Column) -> Column:
    return -inner(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is zero."""
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return _checked(a, b, F.when(norms == 0, 1.0).otherwise(1.0 - _sum(a, b, lambda x, y: x * y) / norms))


METRICS = {"l2": l2, "cosine": cosine, "ip": negative_inner}


def knn(df: DataFrame, column: str, query: list[float], k: int, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The k nearest rows with their distance: a top-k in every task, merged; null vectors are no neighbours."""
    found = df.filter(F.col(column).isNotNull()).withColumn("distance", METRICS[metric](F.col(column), literal(query)))
    return found.orderBy("distance", *([tie] if tie else [])).limit(k)
