"""N-gram Jaccard join: a count-vector R-tree over a directory of subspaces, then exact verification.

A document is the set of its distinct word n-grams.  Texts with equal sets are one node.  A node's
n-grams are hashed into GROUPS groups, and the counts of the groups are its point.  For sets A and B that link
at Jaccard r, |A xor B| <= D = (1 - r) / r * min(|A|, |B|), and |A and B| <= sum of min(a_g, b_g) over
the groups g of any grouping; a box's corner of largest counts bounds all its points.

Boxes over more than a few count vectors of unrelated texts overlap in every coordinate (README has figures of
such a tree), so the upper levels of the tree are a directory of subspaces: fine groups are dealt into
D + 2 subspaces, and by the pigeonhole principle a linked pair has equal coordinates in at least two of them.  A
directory entry is a subspace with one value, a box shrunk to a point in these coordinates, so its lookup is an
equality and loses no link.  Sizes are cut into classes such that linked sets lie in the same or in
adjoining classes; D is the class's.

Nodes of common entries that an exact sketch leaves a partner (sketches.py) are bulk-loaded into leaves (leaves.py).  Two leaves that meet are joined as
R-trees are: box against box, point against box, point against point, each by the summed minima.  Counts of few groups say little
about very long sets; those are compared by wide sketches, in each key before they are gathered and again before sets travel.  What no
bound rules out is verified by its exact set, leaf by leaf; every link between different texts is found, counted
for both ends, and closed to components.

Defined results: null and empty texts have no n-grams and link with nothing; a text of fewer words
has one n-gram; repeated documents and ids are linked through their texts; documents with a null doc_id take part
like others, and a component is named by its smallest doc_id that is not null (null if it has none); an
empty table gives no rows; other columns are ignored.  A node's id is 64 bits of the digest of its set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boxes
from .common import dropped, lean, small, stored, table, tidied
from .components import components
from .leaves import LINKED, dealt, gathered, linked, meetings
from .media import flushed
from .packed import ENTERED, entered, parts_for, shared_keys
from .sketches import BITS, near_partners, odd_sketch, possible, wide_sketch
from .tokens import MULTIPLIER, SPACED, grams, mix, slices, text_bytes, word_hashes

#: Growth of size classes.
GROWTH = 1.4


class Classes:
    """Size classes for a threshold of num / den; class c holds sizes bounds[c] .. bounds[c + 1] - 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]
        while self.bounds[-1] < 1 << 40:
            b = self.bounds[-1]
            self.bounds.append(max(b * den // num + 1, int(b * GROWTH)))

    def of(self, n: int) -> list[tuple[int, int]]:
        """(class, subspaces) under which a set of n is entered."""
        c = int(np.searchsorted(self.bounds, n, "right")) - 1
        out = [(c, self.subspaces(c))]
        if c and n * self.num <= (self.bounds[c] - 1) * self.den:  # a set of the class below can be near enough
            out.append((c - 1, self.subspaces(c - 1)))
        return out

    def subspaces(self, c: int) -> int:
        return (self.den - self.num) * (self.bounds[c + 1] - 1) // self.num + 2


def entries(grams_: np.ndarray, classes: Classes) -> np.ndarray:
    """Directory keys of a sorted set: one for each subspace that is not empty (all, if several are)."""
    mixed = mix(grams_ ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    out = []
    for c, k in classes.of(len(grams_)):
        # Subspace of a gram: floor(top 32 bits * k / 2^32), rising with the sorted grams.
        edges = -((-np.arange(k + 1, dtype=np.int64) << 32) // k)
        edge = np.searchsorted(grams_ >> np.uint64(32), edges.astype(np.uint64))
        empty = np.diff(edge) == 0
        keys = mix(sums[edge[1:]] - sums[edge[:-1]] + np.arange(k, dtype=np.uint64) * MULTIPLIER + np.uint64((c + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        # Two subspaces at least are equal in a linked pair: with one empty at most, one of them is not empty.
        out.append(keys if empty.sum() > 1 else keys[~empty])
    return np.concatenate(out)


def gram_sets(column: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text."""
    words, begins = word_hashes(*text_bytes(column), SPACED)
    all_, places = grams(words, begins, n)
    for i in range(len(column)):
        if places[i] < places[i + 1]:
            yield np.unique(all_[places[i] : places[i + 1]])
        elif begins[i] < begins[i + 1]:
            yield grams(words[begins[i] : begins[i + 1]], np.array([0, begins[i + 1] - begins[i]]), int(begins[i + 1] - begins[i]))[0] ^ np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def node_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)


def _sized(n: int):
    """(row, doc_id, text) -> row, doc_id, n_shingles, node (null without n-grams), the node's point, odd sketch and (if it is wider) wide sketch."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("point", pa.binary()), ("sketch", pa.binary()), ("wide", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sizes, nodes, points, sketches, wides = [], [], [], [], []
                for found in gram_sets(part.column(2), n):
                    sizes.append(len(found))
                    nodes.append(node_id(found) if len(found) else None)
                    points.append(boxes.point(found).tobytes() if len(found) else None)
                    sketches.append(odd_sketch(found) if len(found) else None)
                    wides.append(wide_sketch(found) if 2 * len(found) > BITS else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.array(sketches, pa.binary()), pa.array(wides, pa.binary())], schema=schema)

    return run


def _entries(n: int, num: int, den: int):
    """batch (text) -> nodes and their directory keys, for packed.entered."""
    classes = Classes(num, den)

    def found(batch):
        for part in slices(batch):
            nodes, keys, seen = [], [], set()
            for x in gram_sets(part.column(0), n):
                if len(x) and (node := node_id(x)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    keys.append(entries(x, classes))
            if nodes:
                yield np.array(nodes, np.int64), np.cumsum([0, *map(len, keys)]), np.concatenate(keys), None

    return found


def _sets(n: int):
    """(node, copies, text) -> node, copies, size, wide sketch and the set, where the text is the node's."""
    schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("grams", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for part in slices(batch):
                    for node, copies, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), gram_sets(part.column(2), n)):
                        if len(found) and node_id(found) == node:
                            yield 9 * len(found), (node, copies, len(found), wide_sketch(found), found.tobytes())

        yield from flushed(rows(), schema)

    return run


def _possible(test):
    """Dealt rows (la, lb, side, node, size, data) -> la, lb, side, node of the nodes that have a possible partner by
    test(data, sizes, number of la's nodes or None within a leaf)."""
    schema = pa.schema([("la", pa.int64()), ("lb", pa.int64()), ("side", pa.bool_()), ("node", pa.int64())])

    def run(batches):
        def rows():
            for la, lb, (sides, nodes, sizes, data) in meetings(batches, 4):
                n = sides.count(False)
                if la != lb and n in (0, len(sides)):
                    continue
                left = test(data, np.array(sizes, np.int64), None if la == lb else n)
                for i in np.flatnonzero(left).tolist():
                    yield 512, (la, lb, sides[i], nodes[i])

        yield from flushed(rows(), schema)

    return run


def _boxed(num: int, den: int):
    return lambda data, sizes, n: boxes.joined(np.frombuffer(b"".join(data), np.uint16).reshape(len(data), -1), sizes, n, num, den)


def _sketched(num: int, den: int):
    return lambda data, sizes, n: near_partners(data, sizes, n, num, den)


def _decoded(data: list[bytes]):
    return (np.frombuffer(x, np.uint64) for x in data)


@tidied("groups")
def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents that it links with, copies included), row (xxhash64 of doc_id
    and text) and root (the same for the documents of a component; null where there is no link) of every document.

    Documents link at Jaccard >= num / den."""
    # The hash of id and text stands for a text where texts are read again; what is read is checked by its node.
    docs = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    sized = stored(docs.mapInArrow(lean(_sized(n)), "row long, doc_id long, n_shingles long, node long, point binary, sketch binary, wide binary"), "sizes")
    counted = sized.filter("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.min("point").alias("point"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide"))
    nodes = stored(counted, "nodes")
    directory = nodes.agg(F.sum(2 * (den - num) * F.col("size") / num + 4)).first()[0] or 0
    parts = parts_for(int(directory), False)
    entries_ = docs.select("text").mapInArrow(lean(entered(parts, _entries(n, num, den))), ENTERED)
    shared = stored(shared_keys(entries_, parts), "shared-keys")
    near = possible(shared, nodes.select("node", "size", "sketch"), num, den, nodes.select("node", "size", F.coalesce("wide", "sketch").alias("sketch")))
    members, meet = gathered(near, nodes.select("node", (8 * F.col("size")).alias("bytes")))
    points = members.join(nodes, "node").select("node", "leaf", "size", "point")
    place = "la long, lb long, side boolean, node long"
    left = stored(dealt(points.join(meet, "leaf").select("la", "lb", "side", "node", "size", "point")).mapInArrow(lean(_possible(_boxed(num, den))), place), "left")
    dropped(shared)
    wanted = stored(left.select("node").distinct().join(nodes, "node").select("node", "copies", F.col("row").alias("_row")), "wanted")
    texts = docs.join(small(wanted, 32), F.col("row") == F.col("_row")).select("node", "copies", "text")
    # Repeated rows of one id and text give a set several times.
    sets = stored(texts.mapInArrow(lean(_sets(n)), "node long, copies long, size long, sketch binary, grams binary"), "sets")
    sketches = sets.select("node", "size", "sketch").dropDuplicates(["node"])
    near = stored(dealt(left.join(sketches, "node").select("la", "lb", "side", "node", "size", "sketch")).mapInArrow(lean(_possible(_sketched(num, den))), place), "near")
    sets = sets.select("node", "copies", "grams").join(near.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    links = stored(dealt(near.join(sets, "node").select("la", "lb", "side", "node", "copies", "grams")).mapInArrow(lean(linked(_decoded, num, den)), LINKED), "links")
    labels = components(links.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    partners = links.filter("other IS NULL").groupBy("node").agg(F.sum("weight").alias("partners"))
    rooted = nodes.select("node", "low", "copies").join(partners, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.select("node", "low", "root", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")).filter("n_links > 0"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "root", "component_id", "n_links")
    named = stored(named, "named").withColumnsRenamed({"node": "_node", "component_id": "_component", "n_links": "_links"})
    component = F.when(F.col("_node").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return sized.join(small(named, 32), F.col("node") == F.col("_node"), "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("_links", F.lit(0)).alias("n_links"), "row", "root")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles (the hashing lower-cases A-Z), Jaccard of at least 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 9, 10).drop("row", "root")
