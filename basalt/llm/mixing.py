"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources that a document belongs to).  A
min-cost flow routes word capacity from patterns to source quotas; the cost of a pattern's k-th
repetition rises with k (convex), so fresh text is used before repeats.  The flow is then turned
into documents: a pattern's documents are laid on a line in the order of a seeded hash, copy after
copy, and every source takes the stretch of the line that the flow granted it.  The document in
which a stretch ends is taken in part, so quotas are met to the word.

The corpus is touched by DataFrame operations only: one aggregation by pattern, one by hash bucket
(a distributed prefix sum: a hot source is spread over its buckets), one window inside buckets.
Only the pattern totals (one row for each pattern) reach the driver, and the flow is found there: its time grows
with the square of the number of patterns (README), whatever the number of documents.

Defined results: null text has size 0; a null source is a source of its own and sorts last; empty
tables give no rows; documents of size 0 take 0; repeated rows are separate documents, ordered by
hash and id (equal rows are interchangeable); other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, WORD, table

#: Rows of a bucket of the prefix sum, on average.
BUCKET_ROWS = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above most * size; what is cut goes to the others."""
    left, out = Fraction(sum(sizes)), [None] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources.

    Successive shortest paths with potentials.  Arcs: start -> pattern (one for each repetition k,
    capacity the pattern's words, cost k), pattern -> member source, source -> end (its quota).
    """
    n_p, n = len(patterns), len(patterns) + len(quotas) + 2
    start, end = n - 2, n - 1
    head, room, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, r, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(head))
            head.append(y), room.append(r), cost.append(v)

    routes = []
    for p, (members, words) in enumerate(patterns):
        for k in range(most):
            arc(start, p, words, k)
        for s in members:
            routes.append((p, s, len(head)))
            arc(p, n_p + s, most * words, 0)
    for s, q in enumerate(quotas):
        arc(n_p + s, end, q, 0)
    height = [0] * n
    while True:
        far, via, heap = {start: 0}, {}, [(0, start)]
        done = set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                y, v = head[e], d + cost[e] + height[x] - height[head[e]]
                if room[e] > 0 and v < far.get(y, v + 1):
                    far[y], via[y] = v, e
                    heapq.heappush(heap, (v, y))
        if end not in far:
            break
        for x in range(n):
            height[x] += far.get(x, far[end])
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = head[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow: list[dict[int, int]] = [{} for _ in patterns]
    for p, s, e in routes:
        if room[e ^ 1]:
            flow[p][s] = room[e ^ 1]
    return flow


def prefix_sums(docs: DataFrame, group: str, size: str, order: list[str], bucket: Column) -> DataFrame:
    """before: the sum of size over the rows of the group that precede a row.

    bucket: long, rising with order.  Sums of whole buckets come from one small aggregation; inside
    a bucket a window adds the rest, so no task holds a group.
    """
    docs = docs.withColumn("_bucket", bucket)
    sums = docs.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return docs.join(sums, docs[group].eqNullSafe(sums["_g"]) & (docs["_bucket"] == sums["_b"])).withColumn("before", F.col("_ahead") + F.col("_in")).drop("_bucket", "_in", "_g", "_b", "_ahead")


def mix(docs: DataFrame, members: Column, text: Column, weight_of, most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, members, size, taken and pieces (words taken for each source).

    members: array of the names of the sources that hold the document (null names are allowed).
    weight_of: position of a source in code point order, null last -> its integer weight.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", members.alias("members"), word_count(text).alias("size"))
    named = sized.withColumn("pattern", F.to_json(F.struct(F.array_sort(F.array_distinct("members")).alias("m")), {"ignoreNullFields": "false"}))
    totals = named.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    sources = sorted({s for r in totals for s in r["members"]}, key=lambda s: (s is None, s))
    place = {s: i for i, s in enumerate(sources)}
    member_sizes = [0] * len(sources)
    for r in totals:
        for s in set(r["members"]):
            member_sizes[place[s]] += r["words"]
    # With overlaps a document counts once for every source that holds it when limits are set, but once in the total.
    total = sum(r["words"] for r in totals)
    targets = water_fill(member_sizes, [weight_of(i) for i in range(len(sources))], most)
    if sum(member_sizes) != total and sum(member_sizes):
        targets = [t * total / sum(member_sizes) for t in targets]
    quotas = [int(t + Fraction(1, 2)) for t in targets]
    patterns = [(tuple(sorted({place[s] for s in r["members"]})), r["words"]) for r in totals]
    flow = min_cost_flow(patterns, quotas, most)
    rows = []
    for r, (who, words), given in zip(totals, patterns, flow):
        cuts, at = [], 0
        for s in who:
            cuts.append((s, at, at + given.get(s, 0)))
            at += given.get(s, 0)
        rows.append((r["pattern"], words, at, cuts, member_sizes[who[0]] if who else 0, float(targets[who[0]]) if who else 0.0, max(1, r["rows"] // BUCKET_ROWS)))
    plan = spark.createDataFrame(rows, "pattern string, pattern_words long, flow long, cuts array<struct<s:int,a:long,b:long>>, source_size long, target double, buckets long")
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    spread = F.conv(F.substring("_hash", 1, 12), 16, 10).cast("long")
    # A plan of few patterns and stretches is broadcast, a larger one joined by pattern.
    lean = sum(200 + 2 * len(r[0]) + 32 * len(r[3]) for r in rows) <= SMALL
    lined = named.join(F.broadcast(plan) if lean else plan, "pattern").withColumn("_hash", seeded)
    # bucket = floor(hash * buckets / 2^48), kept within long by using the hash's first 32 bits
    lined = prefix_sums(lined, "pattern", "size", ["_hash", "doc_id"], F.shiftright(F.shiftright(spread, 16) * F.col("buckets"), 32))
    def covered(a: Column, b: Column) -> Column:
        return sum((F.greatest(F.lit(0), F.least(b, k * F.col("pattern_words") + F.col("before") + F.col("size")) - F.greatest(a, k * F.col("pattern_words") + F.col("before"))) for k in range(most)), F.lit(0)).cast("long")

    pieces = F.transform("cuts", lambda c: F.struct(c["s"].alias("source_no"), covered(c["a"], c["b"]).alias("words")))
    return lined.select("doc_id", "members", "size", "source_size", "target", covered(F.lit(0), F.col("flow")).alias("taken"), pieces.alias("pieces"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is in one source; weights 1, 2, 3 repeat in code point order, null last."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source"), F.col("text"), lambda i: i % 3 + 1).select("doc_id", "size", "source_size", "target", "taken")


#: Water filling in closed form: by rising size/weight, a source is full while its limit lies below its share of what the fuller ones leave.
OP9_SQL = """
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, COALESCE(SUM(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        SUM(w) OVER (ORDER BY 3 * source_size / w DESC, source DESC) AS w_left, SUM(source_size) OVER () AS total FROM w),
f AS (SELECT *, 3 * source_size * w_left < (total - below) * w AS is_full FROM o),
l AS (SELECT arg_max(total - below, (total - below) / w_left) AS words_left, arg_max(w_left, (total - below) / w_left) AS w_left FROM f WHERE NOT is_full),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(l.words_left * w AS DOUBLE) / CAST(l.w_left AS DOUBLE) END AS target FROM f, l),
h AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(FLOOR(t.target + 0.5) AS BIGINT) AS quota,
        COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(GREATEST(0, LEAST(quota, before + size) - before) + GREATEST(0, LEAST(quota, source_size + before + size) - source_size - before)
     + GREATEST(0, LEAST(quota, 2 * source_size + before + size) - 2 * source_size - before) AS BIGINT) AS taken
FROM h
"""
