"""Scratch tables and table access shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters that contracts lower-case; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the contracts, as a Java regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the session names in spark.checkpoint.dir.

    Where that is unset a temporary folder is made and set on a local master; a cluster has no folder
    that its executors share, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="basalt-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            root = held.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that the running tidied functions of this thread have stored.
_running = threading.local()


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends here, and the
    files' size lets Spark judge which join sides are small enough to broadcast.

    Nothing reads the write's shuffles again, so their files go with it, not when the driver next happens
    to collect its garbage; while it runs they stay, so lost executors cost no more than usual."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    if getattr(_running, "made", None):
        _running.made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_lock, _writing = threading.Lock(), {}


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """CLEANUP is set while any write of the session runs; its former value comes back behind the last one."""
    with _lock:
        running, before = _writing.get(spark, (0, None))
        if not running:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing[spark] = running + 1, before
    try:
        yield
    finally:
        with _lock:
            running, before = _writing.pop(spark)
            if running > 1:
                _writing[spark] = running - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def _deleted(spark: SparkSession, root: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, root)


def tidied(name: str):
    """Decorate a function so that its result is stored under name and the tables it stored on the way are deleted."""

    def around(f):
        @functools.wraps(f)
        def run(*args, **options):
            _running.made = getattr(_running, "made", None) or []
            _running.made.append([])
            try:
                df = f(*args, **options)
                made, _running.made[-1] = _running.made[-1], []
                out = stored(df, name)
            finally:
                kept = _running.made.pop()
            if _running.made:
                _running.made[-1].extend(kept)
            for path in made:
                _deleted(out.sparkSession, path)
            return out

        return run

    return around


def trimmed() -> None:
    """Gives memory that this process has freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, a function for mapInArrow, that trims its worker when a task ends: Spark reuses workers for all tasks of all
    stages, and an executor would hold the largest task of each beside its heap."""

    def worker(batches):
        try:
            yield from run(batches)
        finally:
            trimmed()

    return worker


#: Bytes up to which a counted table is broadcast.
SMALL = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, to be broadcast if its counted rows make it small; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def small_lists(df: DataFrame, column: str, item_bytes: int) -> DataFrame:
    """The same for a table whose rows hold lists of any length in column: their items are counted."""
    items = df.agg(F.sum(F.size(column) + 2)).first()[0] or 0
    return F.broadcast(df) if items * item_bytes <= SMALL else df.hint("merge")


def ascii_lower(col):
    """A-Z lower-cased, nothing else."""
    return F.translate(col, UPPER, LOWER)
