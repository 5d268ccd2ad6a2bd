"""Leaves of nodes that share keys, and the join of leaves.

Nodes (texts, lines) are found near each other by keys that linked nodes share.  Instead of all pairs of
a key, nodes are gathered into stars: a node belongs to the centre (the smallest node) of most of its keys.
A star is cut into leaves of LEAF_NODES nodes and LEAF_BYTES bytes at most.  Two leaves meet if some key has
nodes in both; a leaf meets itself.  Small stars whose centres belong, in a few steps, to a star of several leaves (variants of one
text that happen to share most keys with another variant) are put together, else each would meet all leaves of the large one.  So every two nodes that share a key meet in one task, once, whatever
the number of their keys; a hot key is many leaves, and a task holds two of them.

``links`` compares the sets of two leaves by counting shared elements: rare ones pair by pair, common
ones by products of 0/1 matrices.  What leaves a task is not pairs but, for each node, the
weight of its partners, and a spanning forest of the links.

A leaf's id is a hash of its star and part; if two leaves had one id they would be one larger leaf.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Nodes and bytes of a leaf; stars on the way to a large one; elements held by so many nodes of a task at most are paired one by one; columns of a matrix;
#: sets that are compared pair by pair; results that a task holds; data that is decoded at once (a meeting's at least).
LEAF_NODES, LEAF_BYTES, HOPS, RARE, COLUMNS, FEW, FLUSHED, POOL = 1024, 2 << 20, 3, 6, 2048, 4, 256, 1 << 16


def gathered(shared: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored members (node, leaf) and meetings (la, lb, leaf, side) of shared (key, node, centre).

    weights: node, bytes of every node.  side is false for la's nodes, true for lb's.
    """
    votes = shared.filter("node <> centre").groupBy("centre", "node").agg(F.count("*").alias("n"))
    best = votes.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("star"))
    # A centre without a centre of its own stands at its star's head.
    heads = shared.select(F.col("centre").alias("node")).distinct().join(best, "node", "left_anti").withColumn("star", F.col("node"))
    starred = stored(best.unionByName(heads).join(weights, "node"), "stars")
    parts = F.greatest(F.ceil(F.count("*") / (LEAF_NODES // 2)), F.ceil(F.sum("bytes") / (LEAF_BYTES // 2))).cast("int")
    sizes = stored(starred.groupBy("star").agg(parts.alias("parts")), "star-sizes")
    up = best.select(F.col("node").alias("star"), F.col("star").alias("parent")).join(sizes, "star").join(sizes.select(F.col("star").alias("parent"), (F.col("parts") > 1).alias("large")), "parent").select("star", "parent", "large")
    up = stored(up, "star-parents")
    above = up
    for _ in range(HOPS):  # the nearest large star on the way up
        onward = up.select(F.col("star").alias("_s"), F.col("parent").alias("_p"), F.col("large").alias("_l"))
        above = above.join(onward, ~F.col("large") & (F.col("parent") == F.col("_s")), "left").select("star", F.coalesce("_p", "parent").alias("parent"), F.coalesce("_l", "large").alias("large"))
    above = above.filter("large").select("star", "parent")
    small_ones = sizes.filter("parts = 1").join(above, "star").select("star", F.xxhash64("parent", F.lit("children")).alias("bundle"))
    starred = stored(starred.join(small_ones, "star", "left").select("node", "bytes", F.coalesce("bundle", "star").alias("star")), "stars")
    sizes = starred.groupBy("star").agg(parts.alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))).otherwise(0)
    members = stored(starred.join(sizes, "star").select("node", F.xxhash64("star", part.cast("int")).alias("leaf")), "members")
    where = shared.select("key", "node").join(members, "node").select("key", "leaf").distinct()
    several = where.groupBy("key").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).filter("low < high").select("key")
    open_ = stored(where.join(several, "key"), "open-keys")
    other = open_.select(F.col("key").alias("_k"), F.col("leaf").alias("_l"))
    across = open_.join(other, (F.col("key") == F.col("_k")) & (F.col("leaf") < F.col("_l"))).select(F.col("leaf").alias("la"), F.col("_l").alias("lb")).distinct()
    own = members.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("leaf").alias("la"), F.col("leaf").alias("lb"))
    pairs = stored(across.unionByName(own), "leaf-pairs")
    first = pairs.select("la", "lb", F.col("la").alias("leaf"), F.lit(False).alias("side"))
    second = pairs.filter("la <> lb").select("la", "lb", F.col("lb").alias("leaf"), F.lit(True).alias("side"))
    return members, first.unionByName(second)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (la, lb, side, node, ...) such that a task has all rows of its pairs of leaves, one pair after the other."""
    return rows.repartition("la", "lb").sortWithinPartitions("la", "lb", "side", "node")


def meetings(batches, width: int):
    """(la, lb, number of la's nodes, columns of width values each) of each pair of leaves, from dealt batches (la, lb, side, node, ...)."""
    now, held = None, [[] for _ in range(width)]
    for batch in batches:
        la, lb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero((la[1:] != la[:-1]) | (lb[1:] != lb[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            key = int(la[a]), int(lb[a])
            if key != now:
                if now is not None and len(held[0]) > 1:
                    yield *now, held
                now, held = key, [[] for _ in range(width)]
            for i in range(width):
                held[i].extend(batch.column(2 + i).slice(a, b - a).to_pylist())
    if now is not None and len(held[0]) > 1:
        yield *now, held


def pooled(found):
    """Lists of such meetings (data in the last column) with two sides each, of POOL data at least."""
    held, size = [], 0
    for la, lb, columns in found:
        if la == lb or columns[0].count(False) not in (0, len(columns[0])):
            held.append((la, lb, columns))
            size += sum(map(len, columns[-1]))
            if size >= POOL:
                yield held
                held, size = [], 0
    if held:
        yield held


def overlaps(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Sizes of the intersections of the first n sets with the others (with all, if n is their number); sets are sorted and distinct."""
    own = n == len(sets)
    if len(sets) <= FEW:  # pair by pair
        out = np.zeros((len(sets), len(sets)), np.int64)
        for i, a in enumerate(sets):
            out[i, i] = len(a)
            for j in range(i + 1 if own else max(i + 1, n), len(sets)):
                b = sets[j]
                at = np.searchsorted(b, a)
                out[i, j] = out[j, i] = (b[np.minimum(at, len(b) - 1)] == a).sum() if len(b) else 0
        return out if own else out[:n, n:]
    all_ = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(all_))
    out = np.zeros((n, len(sets) if own else len(sets) - n), np.float32)
    for c in range(1 if own else 2, RARE + 1):
        at = starts[counts == c]
        for i in range(c):
            for j in range(i if own else i + 1, c):
                x, y = owner[at + i], owner[at + j]  # x < y, as owners rise within an element
                if own:
                    np.add.at(out, (x, y), 1)
                    if i != j:
                        np.add.at(out, (y, x), 1)
                else:
                    use = (x < n) & (y >= n)
                    np.add.at(out, (x[use], y[use] - n), 1)
    wide = np.flatnonzero(counts > RARE)
    for at in range(0, len(wide), COLUMNS):
        some = wide[at : at + COLUMNS]
        matrix = np.zeros((len(sets), len(some)), np.float32)
        total = counts[some]
        places = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
        matrix[owner[places], np.repeat(np.arange(len(some)), total)] = 1
        out += matrix[:n] @ (matrix if own else matrix[n:]).T
    return out.astype(np.int64)


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric relation, the smallest index that each index reaches."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


LINKED = "node long, other long, weight long"


def linked(decode, num: int, den: int):
    """A function for mapInArrow over dealt rows (la, lb, side, node, copies, data): rows (node, null, weight of the
    node's partners) and (node, other, null) that connect what links at Jaccard num / den.  decode: data of many nodes -> their sets."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        held: list[tuple[list, list, list]] = []

        def flushed():
            nodes, others, weights = (sum((h[i] for h in held), []) for i in range(3))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(weights, pa.int64())], schema=schema)

        def decoded():
            for some in pooled(meetings(batches, 4)):
                sets = iter(decode([x for *_, columns in some for x in columns[-1]]))
                for la, lb, (sides, nodes, copies, _) in some:
                    yield la, lb, sides, nodes, copies, list(itertools.islice(sets, len(sides)))

        for la, lb, sides, nodes, copies, sets in decoded():
            n = sides.count(False)
            size = np.array([len(s) for s in sets])
            both = overlaps(sets, n)
            a, b = size[:n], size if la == lb else size[n:]
            near = (den * both >= num * (a[:, None] + b[None, :] - both)) & (both > 0)
            nodes, copies = np.array(nodes), np.array(copies)
            if la == lb:
                np.fill_diagonal(near, False)
                weight = near @ copies
                square = near
            else:
                weight = np.concatenate([near @ copies[n:], near.T @ copies[:n]])
                square = np.zeros((len(sets), len(sets)), bool)
                square[:n, n:], square[n:, :n] = near, near.T
            some = np.flatnonzero(weight)
            if len(some):
                label = forest(square[np.ix_(some, some)])
                hang = np.flatnonzero(label != np.arange(len(some)))
                none = [None] * len(some)
                held.append((nodes[some].tolist(), none, weight[some].tolist()))
                held.append((nodes[some[hang]].tolist(), nodes[some[label[hang]]].tolist(), none[: len(hang)]))
                if len(held) >= FLUSHED:
                    yield flushed()
        if held:
            yield flushed()

    return run
