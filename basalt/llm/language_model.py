"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

Units are the bytes of UTF-8 text (any language, no vocabulary to cut), ORDER at most: an n-gram is a
40-bit number, exact, whose context and suffix are shifts and masks.  Every language has a model of its
own, counted over all of its trusted documents.  Counting is map-side combined; lower orders count the
distinct left extensions; discounts, back-off weights and interpolated probabilities come from joins of the
count tables on (language, n-gram), which Spark shards by hash.

Scoring looks every position up: the probability of the longest stored n-gram, times the back-off
weights of the longer contexts.  Where the model's counted rows are few (SMALL), every worker reads it from
the shared folder; a larger model is joined, sharded, with the documents' distinct n-grams instead.  Both ways give
the same perplexities (tests compare them).

A document is kept if its perplexity is at most its language's threshold: the QUANTILE of the perplexities of trusted
documents of the language that were held out of training (every FOLDS-th by hash of the id).  A language with fewer than
FEW such documents has no tail of its own: its threshold is its median times the same quantile of all held-out
documents' perplexities over their languages' medians.  Where all languages together have fewer than FEW, that
quantile is at least the prediction limit (Student's t) of a log-normal law with the ratios' deviation.

Defined results: null and empty texts have no perplexity and are kept; a null language is a language
of its own; a language without held-out trusted text takes the quantile over all languages, and without any
trusted text at all every document is kept; null labels are not trusted; repeated rows are scored
alike; an empty table gives no rows; other columns are ignored; texts are scored whole.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, small, stored, table
from .media import flushed
from .tokens import mix, slices, text_bytes

ORDER = 5
#: FEW documents leave one above the quantile on average.
QUANTILE, FEW, FOLDS = 0.995, 200, 5


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ORDER bytes that ends at each byte (zeros stand before a text), and n + 1 offsets."""
    raw, offsets = text_bytes(column)
    x, lead = np.zeros(len(raw), np.uint64), np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(raw))
    for back in range(ORDER):
        part = np.zeros(len(raw), np.uint64)
        part[back:] = raw[: len(raw) - back] if back else raw
        part[at - lead < back] = 0
        x |= part << np.uint64(8 * back)
    return x, offsets


def _counted(batches):
    """(lang, text) -> lang, gram, n: n-grams of ORDER, summed for each part of a batch."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for part in slices(batch):
            langs = part.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _ = packed(part.column(1).filter(pa.array([x == lang for x in langs])))
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], schema=schema)


def train(texts: DataFrame) -> DataFrame:
    """lang, k, gram, logp, backoff of the model of texts (lang, text); lang is not null.

    logp: of the gram's last byte after the others; backoff: log of the weight that the gram, as a context,
    leaves to shorter ones (null where it is none).
    """
    top = stored(texts.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c")), "counts")
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        counts[k] = stored(counts[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("c")), "counts")
    every = None
    for k in range(1, ORDER + 1):
        c = F.col("c")
        n = [F.sum((c == i).cast("long")) for i in (1, 2, 3, 4)]
        of = counts[k].groupBy("lang").agg(*(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5 * i) for i in (1, 2, 3)]
        of = of.select("lang", *(F.least(F.greatest(x, F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i, x in enumerate(d, 1)))
        of = small(stored(of, "discounts"), 64)  # a row for each language: a hot language's counts are not shuffled to one task
        level = counts[k].join(of, "lang").withColumn("d", F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3")))
        level = level.withColumn("context", F.shiftright("gram", 8))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("kept_back"))
        contexts = stored(contexts.select("lang", "context", "total", (F.col("kept_back") / F.col("total")).alias("left")), "contexts")
        level = level.join(contexts, ["lang", "context"])
        if k == 1:
            level = level.withColumn("p", (c - F.col("d")) / F.col("total") + F.col("left") / 256)
        else:
            lower = every.filter(F.col("k") == k - 1).select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower, ["lang", "suffix"]).withColumn("p", (c - F.col("d")) / F.col("total") + F.col("left") * F.col("lower"))
            shorter = contexts.select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("gram"), F.col("left").alias("left_new"))
            # The context of zeros before a text ends no gram: it is a row without a probability of its own.
            every = every.join(shorter, ["lang", "k", "gram"], "full").withColumn("left", F.coalesce("left_new", "left")).drop("left_new")
        level = level.select("lang", F.lit(k).alias("k"), "gram", "p", F.lit(None).cast("double").alias("left"))
        if k == 1:
            root = contexts.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), F.lit(1 / 256).alias("p"), "left")
            level = level.unionByName(root)
        every = stored(level if every is None else every.unionByName(level), "model")
        if k == ORDER:
            return stored(every.select("lang", "k", "gram", F.log("p").alias("logp"), F.log("left").alias("backoff")), "language-model")


class Lookup:
    """Open-addressing table of (lang, k, gram) in arrays, for vectorised lookups."""

    def __init__(self, lang: np.ndarray, k: np.ndarray, gram: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        self.bits = max(4, int(1.5 * len(gram)).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max)
        self.logp, self.backoff = np.zeros(1 << self.bits), np.full(1 << self.bits, np.nan)
        key = self.key(lang.astype(np.uint64), k.astype(np.uint64), gram.astype(np.uint64))
        slot, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            at, row = slot[one], left[one]
            self.keys[at], self.logp[at], self.backoff[at] = key[row], logp[row], backoff[row]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, slot = left[rest], slot[rest] + (~free[rest])
            slot &= (1 << self.bits) - 1

    @staticmethod
    def key(lang, k, gram):
        return lang << np.uint64(44) | k << np.uint64(40) | gram

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.copy()) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is absent."""
        out, slot, left = np.full(len(key), -1), self.slot(key), np.arange(len(key))
        while len(left):
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (held != np.iinfo(np.uint64).max)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def log_probabilities(self, lang: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(grams), np.float64), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            mask = np.uint64((1 << 8 * k) - 1)
            at = self.find(self.key(lang[left], np.uint64(k), grams[left] & mask))
            hit = (at >= 0) & ~np.isnan(self.logp[at])
            out[left[hit]] += self.logp[at[hit]]
            left = left[~hit]
            context = self.find(self.key(lang[left], np.uint64(k - 1), (grams[left] & mask) >> np.uint64(8)))
            weight = np.where(context >= 0, self.backoff[context], 0)
            out[left] += np.nan_to_num(weight)
        out[left] -= np.log(256)
        return out


_held: dict = {}


def load(files: list[str]) -> tuple[Lookup, dict[str, int]]:
    """The stored model's table, and the number of each language in it."""
    from pyarrow import fs
    from pyarrow import parquet

    parts = []
    for f in files:
        store, place = fs.FileSystem.from_uri(f)
        parts.append(parquet.ParquetFile(store.open_input_file(place)).read())
    model = pa.concat_tables(parts)
    lang = model["lang"].combine_chunks().dictionary_encode() if len(model) else pa.array([], pa.string()).dictionary_encode()
    lookup = Lookup(lang.indices.to_numpy(), *(model[c].to_numpy() for c in ("k", "gram", "logp", "backoff")))  # null is nan
    return lookup, {x: i for i, x in enumerate(lang.dictionary.to_pylist())}


def scorer(files: list[str]):
    """A function for mapInArrow; each worker process reads the model once, from the shared folder."""

    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log_p", pa.float64())])
        if _held.get("files") != files:
            _held.clear()
            _held.update(files=files, model=load(files))
        lookup, place = _held["model"]
        for batch in batches:
            for part in slices(batch):
                names = part.column(2).to_pylist()
                grams, offsets = packed(part.column(3))
                sizes = np.diff(offsets)
                lang = np.repeat(np.array([place.get(x, len(place)) for x in names], np.uint64), sizes)
                sums = np.zeros(len(grams) + 1)
                np.cumsum(lookup.log_probabilities(lang, grams), out=sums[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sizes), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], schema=schema)

    return run


def _distinct(batches):
    """(row, doc_id, lang, text) -> the n-grams of each text with their numbers."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def rows():
        for batch in batches:
            for row, key, lang, i in zip(*(batch.column(j).to_pylist() for j in range(3)), range(batch.num_rows)):
                found, n = np.unique(packed(batch.column(3).slice(i, 1))[0], return_counts=True)
                for g, c in zip(found.view(np.int64).tolist() or [None], n.tolist() or [0]):
                    yield 40, (row, key, lang, g, c)

    yield from flushed(rows(), schema)


def score_sharded(rows: DataFrame, model: DataFrame) -> DataFrame:
    """row, doc_id, lang, n_bytes, log_p by joins of the documents' n-grams with the model, order by order."""
    grams = rows.mapInArrow(_distinct, "row long, doc_id long, lang string, gram long, n long").withColumns({"log_p": F.lit(0.0), "open": F.lit(True)})
    for k in range(ORDER, 0, -1):
        mask = (1 << 8 * k) - 1
        own = model.filter((F.col("k") == k) & F.col("logp").isNotNull()).select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), "logp")
        above = model.filter(F.col("k") == k - 1).select(F.col("lang").alias("_cl"), F.col("gram").alias("_c"), F.coalesce("backoff", F.lit(0.0)).alias("weight"))
        grams = grams.withColumn("_k", F.when(F.col("open"), F.col("gram").bitwiseAND(F.lit(mask))))
        grams = grams.join(own, (F.col("lang") == F.col("_l")) & (F.col("_k") == F.col("_g")), "left").join(above, (F.col("lang") == F.col("_cl")) & (F.shiftright("_k", 8) == F.col("_c")), "left")
        step = F.when(~F.col("open"), 0.0).when(F.col("logp").isNotNull(), F.col("logp")).otherwise(F.coalesce("weight", F.lit(0.0)))
        grams = grams.withColumns({"log_p": F.col("log_p") + step, "open": F.col("open") & F.col("logp").isNull()}).drop("_k", "_l", "_g", "logp", "_cl", "_c", "weight")
    log_p = F.col("log_p") - F.when(F.col("open"), float(np.log(256))).otherwise(0.0)
    return grams.groupBy("row", "doc_id", "lang").agg(F.sum("n").alias("n_bytes"), F.coalesce(F.sum(F.when(F.col("gram").isNotNull(), log_p * F.col("n"))), F.lit(0.0)).alias("log_p"))


def score(docs: DataFrame, model: DataFrame, limit: int = SMALL) -> DataFrame:
    """row, doc_id, lang, n_bytes, log_p of every document (doc_id, lang, text); lang is not null."""
    rows = docs.select(F.xxhash64("doc_id", "lang", "text").alias("row"), "doc_id", "lang", "text")
    if model.count() * 24 > limit:
        counted = stored(rows.groupBy("row", "doc_id", "lang", "text").agg(F.count("*").cast("int").alias("copies")), "distinct")
        copies = counted.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "copies")
        same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))
        scored = score_sharded(counted.drop("copies"), model).join(copies, same)
        return scored.select("row", "doc_id", "lang", "n_bytes", "log_p", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return rows.mapInArrow(scorer(sorted(model.inputFiles())), "row long, doc_id long, lang string, n_bytes long, log_p double")


def student(q: float, freedom: int) -> float:
    """The q quantile of Student's t, by its expansion around the normal one."""
    z = NormalDist().inv_cdf(q)
    return z + (z**3 + z) / (4 * freedom) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * freedom**2)


def quality(docs: DataFrame, trusted: DataFrame, limit: int = SMALL) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep of every document; trusted: ids (doc_id)."""
    named = docs.select("doc_id", F.coalesce(F.concat(F.lit("l:"), F.col("lang")), F.lit("none")).alias("lang"), "text")
    ids = stored(trusted.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held_out")).distinct(), "trusted")
    model = train(named.join(small(ids.filter("NOT held_out"), 24), F.col("doc_id") == F.col("_id")).select("lang", "text"))
    scored = score(named, model, limit).withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))
    scored = stored(scored, "scored")
    test = scored.join(small(ids.filter("held_out"), 24), F.col("doc_id") == F.col("_id")).filter("perplexity IS NOT NULL")
    cut = lambda x, q: F.percentile_approx(x, F.lit(q), F.lit(10000))
    own = stored(test.groupBy("lang").agg(F.count("*").alias("n"), cut("perplexity", 0.5).alias("median"), cut("perplexity", QUANTILE).alias("own")), "limits")
    over = test.join(small(own, 64), "lang").select("perplexity", (F.col("perplexity") / F.col("median")).alias("ratio"))
    n, tail, overall, spread = over.agg(F.count("*"), cut("ratio", QUANTILE), cut("perplexity", QUANTILE), F.stddev_samp(F.log("ratio"))).first()
    if 1 < n < FEW:
        tail = max(tail, math.exp(student(QUANTILE, n - 1) * spread * math.sqrt(1 + 1 / n)))
    limit = F.when(F.col("n") >= FEW, F.col("own")).otherwise(F.col("median") * F.lit(tail).cast("double"))
    out = scored.join(small(own, 64), "lang", "left").withColumn("threshold", F.coalesce(limit, F.lit(overall).cast("double")))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", F.when(F.col("lang") != "none", F.substring("lang", 3, 1 << 30)).alias("lang"), "n_bytes", "perplexity", "threshold", keep.alias("keep"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: documents labelled quality 1 and not toxic."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)
