"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes (2**BITS buckets) of its words, word pairs and pairs that
skip one word; words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
Training is follow-the-regularised-leader with one learning rate for each coordinate and an L1 term,
so most weights are exactly zero and the model is a few thousand (bucket, weight) rows, at most
2**BITS of them: that bound is what allows it to be broadcast.

Training rows: at most TRAIN_ROWS labelled documents outside the held-out fold, the ones whose ids
hash lowest (the same ones in every run), of these as many as have TRAIN_BYTES of features together (4 bytes for
each distinct feature of a text); their features are computed by all executors, and one task
runs the sequential updates.  Scoring covers every document in one pass without a shuffle.

Defined results: a null or empty text has the bias only; a null label does not train; several labels
of one id train as their largest; repeated documents each get their score; no labels give a model of
bias zero (score 0.5 is avoided: a model without training rows scores 0); labels, lang, source and
doc_id are no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, table
from .tokens import ALNUM, MULTIPLIER, grams, mix, text_bytes, word_hashes

BITS = 20
#: Bounds of the training sample.
TRAIN_ROWS, TRAIN_BYTES = 12288, 256 << 20
FOLDS = 5

#: Texts whose features are held at once.
SLICE = 256

#: Rate, its smoothing, L1 (for TRAIN_ROWS rows; it shrinks with the root of fewer), L2 and passes of the training.  Rate and
#: L1 were chosen by log loss on fold 1, learning from folds 2 to 4.
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 12.0, 1.0, 4


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every gram, repeats included."""
    words, begins = word_hashes(*text_bytes(column), ALNUM)
    rows, out = [], []
    for kind in range(3):
        if kind < 2:
            x, places = grams(words, begins, kind + 1)
        else:  # the first and the last of three
            _, places = grams(words, begins, 3)
            count = np.diff(places)
            take = np.repeat(begins[:-1] - places[:-1], count) + np.arange(places[-1])
            x = mix(words[take] * MULTIPLIER + words[take + 2] + np.uint64(2)) if len(take) else words[:0]
        rows.append(np.repeat(np.arange(len(column)), np.diff(places)))
        out.append((x >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(out)


def _featured(batches):
    schema = pa.schema([("order", pa.int64()), ("label", pa.int32()), ("features", pa.binary())])
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        rows, found = features(batch.column(2))
        keys = np.unique(rows.astype(np.int64) << BITS | found)
        cut = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
        found = (keys & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=schema)


def ftrl(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights after EPOCHS passes; the last one is the bias (never regularised by L1)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    penalty = np.full(len(z), L1 * np.sqrt(len(rows) / TRAIN_ROWS))
    penalty[-1] = 0

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * penalty[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= penalty[at], 0, w)

    for _ in range(EPOCHS):
        for at, label in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def _trained(batches):
    rows = []
    for batch in batches:
        for label, found in zip(batch.column(1).to_pylist(), batch.column(2)):
            rows.append((np.append(np.frombuffer(found.as_buffer(), np.int32), 1 << BITS), label))
    if rows:
        w = ftrl(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], schema=pa.schema([("bucket", pa.int32()), ("weight", pa.float64())]))


def held_out(doc_id="doc_id"):
    """Whether the id is in the fold that no label is learned from (a null id is not)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (sparse), learned from at most ``rows`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # TRAIN_ROWS pairs at most, whatever the input: fit to broadcast.
    chosen = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", "text")
    found = texts.mapInArrow(lean(_featured), "order long, label int, features binary")
    # TRAIN_ROWS rows at most: one task holds them, and no more than TRAIN_BYTES of features.
    before = Window.orderBy("order", "features", "label").rowsBetween(Window.unboundedPreceding, 0)
    found = found.repartition(1).withColumn("bytes", F.sum(F.length("features")).over(before)).filter(F.col("bytes") <= TRAIN_BYTES).select("order", "label", "features")
    model = found.sortWithinPartitions("order", "features", "label").mapInArrow(lean(_trained), "bucket int, weight double").toPandas()
    return model["bucket"].to_numpy(np.int32), model["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with a column score (0 to 1)."""
    buckets, weights = model
    held = docs.sparkSession.sparkContext.broadcast((buckets, weights))
    trained = len(buckets) > 0

    @F.pandas_udf("double")
    def scored(texts):
        at, w = held.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        sums = []
        for part in range(0, len(texts), SLICE):
            column = pa.Array.from_pandas(texts.iloc[part : part + SLICE], type=pa.large_string())
            rows, found = features(column)
            hit = dense[found] != 0
            keys = np.unique(rows[hit].astype(np.int64) << BITS | found[hit])
            sums.append(np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], minlength=len(column)) + dense[-1])
        import pandas as pd

        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(sums), -35, 35))) if sums else [], dtype="float64")

    return docs.withColumn("score", scored(text) if trained else F.lit(0.0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
