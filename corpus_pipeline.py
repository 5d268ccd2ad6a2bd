"""The corpus pipeline: five stages over documents, each one operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents (the
last one returns the mix: how many words to take of each document); ``run`` writes every stage's result to the
shared folder and reads it again for the next.

Repeated rows, nulls, empty and very long texts are handled as the operators' docstrings say.  Decisions are joined
back to rows by doc_id (null equal to null) and a hash of id and text, so rows that share an id are decided by
their own texts; of equal rows the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontamination, jaccard, lines, mixing, toxicity
from basalt.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A character that line dedup does not strip.
VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from the labels of these documents."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("score < 0.5").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones; a document that loses all its lines goes."""
    kept = lines.dedup(docs.select(COLUMNS), min_chars=1)
    emptied = (F.col("n_kept") < F.col("n_lines")) & ~F.col("text").rlike(VISIBLE)
    kept = kept.filter(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col("n_kept") < F.col("n_lines"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard of 0.8 or more): that of the smallest
    doc_id, null last; of its equal rows, one."""
    groups = stored(jaccard.jaccard_components(docs, 5, 8, 10).filter("n_links > 0"), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = groups.groupBy("root").agg(F.min(order).alias("kept"))
    fate = groups.join(kept, "root").groupBy("doc_id", "row").agg((F.first("kept")["row"] == F.col("row")).alias("stays"), F.count("*").alias("n"))
    fate = stored(fate.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "stays", "n"), "fates")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    decided = keyed.join(fate, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    repeated = F.coalesce(F.col("stays") & (F.col("n") > 1), F.lit(False))
    if fate.filter(repeated).isEmpty():
        return decided.filter("stays IS NULL OR stays").select(COLUMNS)
    once = decided.filter("stays IS NULL OR stays").filter(~repeated).select(COLUMNS)
    return once.unionByName(decided.filter(repeated).dropDuplicates(["doc_id", "row"]).select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule of the benchmark does not hit."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = stored(found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("dkey").alias("_key")).distinct(), "contaminated")
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("dkey"))
    return keyed.join(hit, (F.col("dkey") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of the documents that the mix takes words from."""
    mixed = mixing.mix(docs, F.array("source"), F.col("text"), lambda i: i % 3 + 1)
    return mixed.filter("taken > 0").select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", detoxify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express a trained model or MinHash lines; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
