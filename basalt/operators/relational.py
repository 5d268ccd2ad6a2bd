"""Relational operators that are more than one DataFrame call."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..sources.snapshots import folder


def quantified(df: DataFrame, x: Column, op: str, values: DataFrame, every: bool) -> Column:
    """x op ALL (every) or ANY (values) for a one-column DataFrame, as a Column in three-valued logic.

    The values are aggregated to one row (extremes and counts) on the executors."""
    v = F.col(values.columns[0])
    low, high, n, known = values.agg(F.min(v), F.max(v), F.count("*"), F.count(v)).first()
    if n == 0:
        return F.lit(every)
    low, high = F.lit(low), F.lit(high)
    compare = {">": lambda b: x > b, ">=": lambda b: x >= b, "<": lambda b: x < b, "<=": lambda b: x <= b}
    if op in compare:
        hard, easy = (high, low) if op[0] == ">" else (low, high)
        decided = ~compare[op](hard) if every else compare[op](easy)
    else:
        differs = (x != low) | (x != high)
        if (op == "=") == every:
            decided = differs
        else:
            raise ValueError(f"{op} {'ALL' if every else 'ANY'} is a semi or anti join")
    unknown = F.lit(None).cast("boolean") if known < n else F.lit(every)
    return F.when(x.isNull(), F.lit(None)).when(decided, F.lit(not every)).otherwise(unknown)


#: Rows that cells are fitted on at most, rows of a cell on average, cells at most.
FIT_ROWS, CELL_ROWS, MOST_CELLS = 100_000, 64, 4096


@dataclass
class AnnIndex:
    """An inverted file over a vector column: k-means cells fitted on a bounded sample, every row stored under its cell.

    The rows lie in a folder for each cell, so a search reads only the cells it probes; the centres (at most
    MOST_CELLS) stay with the driver.  Probing all cells is exact."""

    path: str
    column: str
    centres: list[list[float]]
    df: DataFrame

    @classmethod
    def build(cls, df: DataFrame, column: str, cells: int | None = None, seed: int = 7) -> AnnIndex:
        spark = df.sparkSession
        known = df.filter(F.col(column).isNotNull())
        n = known.count()
        cells = cells or max(1, min(MOST_CELLS, int(n**0.5 / 2), n // CELL_ROWS + 1))
        features = known.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
        path = f"{folder(spark)}/ann-{uuid.uuid4().hex}"
        if n:
            sample = features.orderBy(F.xxhash64(column)).limit(FIT_ROWS) if n > FIT_ROWS else features
            fitted = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_features", predictionCol="_cell").fit(sample.select("_features"))
            centres = [list(map(float, c)) for c in fitted.clusterCenters()]
            features = fitted.transform(features)
        else:
            centres, features = [[]], features.withColumn("_cell", F.lit(0))
        # A large cell is several files, so no task writes a hot cell alone.
        features.drop("_features").repartition("_cell", F.pmod(F.xxhash64(column), F.lit(8))).write.partitionBy("_cell").parquet(path)
        placed = spark.read.schema(f"{_ddl(known.schema)}, _cell int").parquet(path)
        return cls(path, column, centres, placed)

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """The rows of about the k nearest vectors by L2, with a column distance; probes: cells that are read."""
        probes = probes or max(1, -(-len(self.centres) // 3))
        near = sorted((sum((a - b) ** 2 for a, b in zip(c, query)), i) for i, c in enumerate(self.centres))[:probes]
        return vector.knn(self.df.filter(F.col("_cell").isin([i for _, i in near])).drop("_cell"), self.column, query, k)

    def drop(self) -> None:
        spark = self.df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def ivf_knn(df: DataFrame, key: str, column: str, query: list[float], k: int, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """Approximate k nearest neighbours by L2 through an index built for the purpose; for many queries keep an AnnIndex."""
    found = AnnIndex.build(df.select(key, column), column, cells).search(query, k, probes)
    return found.select(key, F.round("distance", 4).alias("distance"))
