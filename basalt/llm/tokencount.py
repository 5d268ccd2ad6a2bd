"""Token counts by separator scan.

Token files are flat: 16-bit little-endian token ids, each document closed by the end-of-document id,
no index.  The scan cuts every file into blocks, searches each block for the separator with one vectorised
comparison, and returns for a block the lengths that end in it and what is left open at its end.  A
prefix scan over the blocks of a file (sums and a segmented sum, as window functions over one row for
each block) numbers the documents and adds what earlier blocks left open, however many blocks a
document spans.

``write_tokens`` makes such files from documents with a public byte-level BPE vocabulary (its path is a
parameter; ids below 50,256, 50,256 is the separator).  Attempts write under names of their own; the rows of
the attempts that count name their files.

Defined results: a null or empty text is a document of no tokens; text that spells a special token is
ordinary text; tokens behind the last separator of a file are an unclosed document, counted too; an
empty file has no documents; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored, table
from .media import flushed

SEPARATOR = 50256

#: Where the vocabulary lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: How that vocabulary cuts text before merging (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a token file, bytes of a block of the scan, bytes that a task scans.
FILE, BLOCK, TASK = 128 << 20, 2 << 20, 32 << 20


def writer(path: str, vocabulary: str):
    def write(batches):
        import tiktoken
        from pyarrow import fs
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("ordinal", pa.int64())])
        store, place = fs.FileSystem.from_uri(path)
        out, name, size, ordinal = None, "", 0, 0

        def rows():
            nonlocal out, name, size, ordinal
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if out is None or size >= FILE:
                        if out is None:
                            store.create_dir(place, recursive=True)
                        else:
                            out.close()
                        name, size, ordinal = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = store.open_output_stream(f"{place}/{name}", compression=None, buffer_size=1 << 20)
                    data = np.array(encode(text.as_py() or "") + [SEPARATOR], "<u2").tobytes()
                    out.write(data)
                    yield 64, (key, f"{path}/{name}", ordinal)
                    size, ordinal = size + len(data), ordinal + 1

        for done in flushed(rows(), schema):
            yield done
        if out is not None:
            out.close()

    return write


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write token files below path; doc_id, path and ordinal of every document, stored.

    vocabulary: a path on the driver; Spark ships the file to the executors."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return stored(docs.select("doc_id", "text").mapInArrow(writer(path, os.path.basename(vocabulary)), "doc_id long, path string, ordinal long"), "token-documents")


def scanner(separator: int, size: int):
    """A function for mapInArrow; size: bytes of a block (an even number)."""

    def scan(batches):
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("lengths", pa.list_(pa.int64())), ("tail", pa.int64())])
        opened, source = None, None

        def rows():
            nonlocal opened, source
            for batch in batches:
                for path, block, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if path != opened:
                        store, place = fs.FileSystem.from_uri(path)
                        source, opened = store.open_input_file(place), path
                    at = block * size
                    data = np.frombuffer(source.read_at(min(size, length - at), at), "<u2")
                    ends = np.flatnonzero(data == separator)
                    lengths = np.diff(ends, prepend=-1) - 1
                    yield 8 * len(lengths) + 64, (path, block, lengths, len(data) - (int(ends[-1]) + 1 if len(ends) else 0))

        yield from flushed(rows(), schema)

    return scan


def scan_files(files: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """path, ordinal, n_tokens, closed of every document in files (path, length in bytes)."""
    blocks = files.filter("length > 1").select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / BLOCK))).alias("block"), "length")
    # Rows of blocks are tiny: the bytes to read give the number of tasks.
    tasks = int((files.agg(F.sum("length")).first()[0] or 0) // TASK) + 1
    tasks = max(tasks, files.sparkSession.sparkContext.defaultParallelism)
    found = stored(blocks.repartition(tasks, "path", "block").mapInArrow(scanner(separator, BLOCK), "path string, block long, lengths array<long>, tail long"), "token-blocks")
    order = Window.partitionBy("path").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row for each block goes through the scan; the lengths join their offsets afterwards.
    sums = found.select("path", "block", "tail", F.size("lengths").alias("n"))
    sums = sums.withColumn("segment", F.sum((F.col("n") > 0).cast("long")).over(order)).withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sums = sums.withColumn("open", F.sum("tail").over(Window.partitionBy("path", "segment").orderBy("block")))
    sums = sums.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("last", F.lead("block").over(order).isNull())
    placed = found.select("path", "block", "lengths").join(sums, ["path", "block"])
    closed = placed.select("path", "first", "carry", F.posexplode("lengths").alias("i", "n")).select("path", (F.col("first") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("n") + F.col("carry")).otherwise(F.col("n")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = sums.filter(F.col("last") & (F.col("open") > 0)).select("path", (F.col("first") + F.col("n")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    # What is open at a block without a separator includes the carry of the blocks before it, by its segment.
    return closed.unionByName(rest)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise all documents to flat files, then count the tokens of each by scanning the files."""
    path = scratch(spark, "tokens")
    written = write_tokens(table(spark, sf_dir, "documents"), path)
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select(F.regexp_replace("path", "^.*/", "").alias("name"), "length")
    named = written.select("path").distinct().withColumn("name", F.regexp_replace("path", "^.*/", ""))  # files of lost attempts drop out
    counted = scan_files(stored(named.join(files, "name").select("path", "length"), "token-files"))
    return written.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens")
