"""Table snapshots and file formats: everything the engine reads and writes goes through Spark's sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where that is unset, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = None if held.isEmpty() else held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="basalt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The new folder that df is written to as Parquet, and df read back from it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: an immutable version without lineage."""
    return stored(df, name)[1]


def versions(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """The rows of several stored folders in one scan."""
    return spark.read.schema(schema).parquet(*paths)


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] = (), **options) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; one of {', '.join(FORMATS)}")
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)
