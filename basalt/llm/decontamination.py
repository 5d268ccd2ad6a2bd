"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.  The index holds a
posting (document, position, term) for every training token that some test item also uses (no test
item can ask for another term), plus one row with the length of each document.  It is written once,
by the tasks that read the documents: an index sharded by document, without a shuffle.

Phrases are found from the rarest test terms on.  Every window of WINDOW consecutive item words (all
words of a shorter item) is anchored at its rarest term, by counts over the whole index.  The anchor's
postings, shifted by its offset in the item, give candidate alignments (document, item, shift); the
offset-adjusted list of the window's second rarest term is intersected with them; the alignments left
are checked against the postings of all item terms.  A run of at least WINDOW matching positions
on one alignment is an occurrence of all its windows.

Proximity: an item is near in a document if around an occurrence of its rarest term, at most SPAN words away, there are
NEAR of its distinct terms (two at least), in any order.  The postings around the occurrences are intersected by
cells of SPAN positions and the exact distance.

Joins with the test side are broadcast only where Spark sees that its stored files are small; joins of
large sides are equi-joins on (document, position, term), (document) or (term), which Spark may split.

Defined results: null or empty texts have no words and no hits; an item without words occurs
nowhere; an item repeated under one id counts once, under several ids for each; a null item_id adds
hits but is not listed; repeated documents give equal rows; empty tables give no hits (or no rows);
other columns are ignored; long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stored, table

WINDOW = 13

#: Distance and share of an item's distinct terms for proximity.
SPAN, NEAR = 26, 0.5

#: What separates words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def test_terms(benchmark: DataFrame) -> DataFrame:
    """ikey, item_id, n (words), ipos, tid, term of every item word; ikey tells apart texts and ids."""
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("ikey"), words(F.col("text")).alias("w")).distinct()
    split = items.select("ikey", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term"))
    return split.withColumn("tid", F.xxhash64("term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings dkey, pos, tid of the documents' tokens in terms; a row with null tid has pos = length."""
    vocabulary = stored(terms.select("term", "tid").distinct(), "vocabulary")
    tokens = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dkey"), F.posexplode(F.array_append(words(F.col("text")), F.lit(None).cast("string"))).alias("pos", "word"))
    found = tokens.join(vocabulary, F.col("word") == F.col("term"), "left").filter(F.col("tid").isNotNull() | F.col("word").isNull())
    return stored(found.select(F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"), "dkey", "pos", "tid"), "postings")


def posting_counts(index: DataFrame) -> DataFrame:
    return stored(index.filter("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("n_postings")), "posting-counts")


def anchors(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The rarest and second rarest positions of all windows: ikey, ipos, tid, ipos2, tid2."""
    rare = terms.join(counts, "tid", "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    length = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - length + 1), F.least(F.col("ipos"), F.col("n") - length))
    placed = rare.select("ikey", F.explode(starts).alias("start"), F.struct("n_postings", "ipos", "tid").alias("p"))
    two = placed.groupBy("ikey", "start").agg(F.slice(F.array_sort(F.collect_list("p")), 1, 2).alias("p"))  # at most `window` terms each
    two = two.filter(F.col("p")[0]["n_postings"] > 0)
    second = F.coalesce(F.try_element_at("p", F.lit(2)), F.col("p")[0])
    return two.select("ikey", F.col("p")[0]["ipos"].alias("ipos"), F.col("p")[0]["tid"].alias("tid"), second["ipos"].alias("ipos2"), second["tid"].alias("tid2")).distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """dkey, ikey, item_id, first, last: maximal runs of document words that repeat item words, at
    least ``window`` long (or the whole item, if shorter)."""
    postings = index.filter("tid IS NOT NULL").select("dkey", "pos", "tid")
    held = stored(anchors(terms, counts, window), "anchors")
    one = postings.join(held, "tid").select("dkey", "ikey", (F.col("pos") - F.col("ipos")).alias("shift"), (F.col("pos") - F.col("ipos") + F.col("ipos2")).alias("pos"), F.col("tid2").alias("tid"))
    lists = postings.join(held.select(F.col("tid2").alias("tid")).distinct(), "tid", "left_semi")
    aligned = stored(one.join(lists, ["dkey", "pos", "tid"], "left_semi").select("dkey", "ikey", "shift").distinct(), "alignments")
    wanted = aligned.join(terms.select("ikey", "ipos", "tid", "n", "item_id"), "ikey").withColumn("pos", F.col("shift") + F.col("ipos"))
    near = postings.join(stored(aligned.select("dkey").distinct(), "aligned-documents"), "dkey", "left_semi")
    hit = wanted.join(near, ["dkey", "pos", "tid"], "left_semi")
    run = F.row_number().over(Window.partitionBy("dkey", "ikey", "shift").orderBy("ipos"))
    runs = hit.withColumn("run", F.col("ipos") - run).groupBy("dkey", "ikey", "item_id", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n"))).select("dkey", "ikey", "item_id", "first", "last")


def proximity_matches(index: DataFrame, terms: DataFrame, counts: DataFrame, span: int = SPAN, share: float = NEAR) -> DataFrame:
    """dkey, ikey, pos, n_terms: occurrences of items' rarest terms with at least ``share`` of the item's distinct
    terms (two at least), itself included, at most ``span`` positions away."""
    postings = index.filter("tid IS NOT NULL").select("dkey", "pos", "tid")
    own = stored(terms.groupBy("ikey", "tid").agg(F.min("ipos").alias("ipos")), "item-terms")
    need = own.groupBy("ikey").agg(F.greatest(F.lit(2), F.ceil(share * F.count("*"))).alias("need"))
    rare = own.join(counts, "tid").groupBy("ikey").agg(F.min(F.struct("n_postings", "ipos", "tid"))["tid"].alias("tid"))
    around = stored(postings.join(stored(rare, "rarest"), "tid").select("dkey", "ikey", "pos"), "around")
    cell = F.floor(F.col("pos") / span)
    cells = around.select("dkey", "ikey", F.col("pos").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = postings.withColumn("cell", cell).join(cells, ["dkey", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= span)
    held = near.join(own.select("ikey", "tid"), ["ikey", "tid"]).select("dkey", "ikey", "at", "tid").distinct().groupBy("dkey", "ikey", "at").agg(F.count("*").alias("n_terms"))
    return held.join(need, "ikey").filter("n_terms >= need").select("dkey", "ikey", F.col("at").alias("pos"), "n_terms")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """doc_id, dkey, n_words, n_hit, n_items, items_sha256, contaminated for every document; with a span also n_near (items near in it)."""
    terms = stored(test_terms(benchmark), "test-terms")
    index = build_index(docs, terms)
    counts = posting_counts(index)
    runs = stored(phrase_matches(index, terms, counts, window), "matches")
    hits = runs.select("dkey", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("dkey").agg(F.count("*").alias("n_hit"))
    items = runs.select("dkey", F.col("item_id").cast("string").alias("item")).distinct().groupBy("dkey").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    rows = index.filter("tid IS NULL").select("doc_id", "dkey", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hits.join(items, "dkey"), "dkey", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    columns = ["doc_id", "dkey", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")]
    if span is not None:
        near = proximity_matches(index, terms, counts, span).select("dkey", "ikey").distinct().groupBy("dkey").agg(F.count("*").alias("n_near"))
        out = out.join(near, "dkey", "left")
        columns.append(F.coalesce("n_near", F.lit(0)).alias("n_near"))
    return out.select(*columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN).drop("dkey")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM m GROUP BY doc_id),
tw AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
ti AS (SELECT item_id, term, MIN(ipos) AS ipos FROM (SELECT item_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS ipos FROM i) GROUP BY item_id, term),
pc AS (SELECT term, COUNT(*) AS c FROM tw GROUP BY term),
ra AS (SELECT item_id, term FROM ti JOIN pc USING (term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c, ipos) = 1),
nd AS (SELECT item_id, GREATEST(2, CEIL(COUNT(*) * 0.5)) AS need FROM ti GROUP BY item_id),
np AS (SELECT a.doc_id, ra.item_id, a.pos, COUNT(DISTINCT b.term) AS n_terms FROM ra JOIN tw a ON a.term = ra.term JOIN tw b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos - 26 AND a.pos + 26
  JOIN ti ON ti.item_id = ra.item_id AND ti.term = b.term GROUP BY a.doc_id, ra.item_id, a.pos),
nr AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_near FROM np JOIN nd USING (item_id) WHERE n_terms >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  COALESCE(items_sha256, sha256('')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated,
  CAST(COALESCE(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
