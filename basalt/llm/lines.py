"""Fuzzy line dedup by MinHash.

A line (stripped, of min_chars characters at least) is the set of its 5-character shingles; one with fewer
characters than that has no shingles and is grouped with its equals only.  Equal
lines are one node.  The query and the pipeline take every non-empty line (min_chars = 1).  ROWS * BANDS permutations of the shingle hashes give a signature, its BANDS
band keys give the candidates: at similarity 0.8 a pair shares a key with probability 0.996, at 0.9
with 0.999996.  One bit of each of the first SKETCH minima is a node's sketch; a node of a small key
whose sketch differs from all others there in five standard deviations more places than those of pairs at the threshold
do on average is let go (of pairs at 0.8 about 1 in 100,000).

Keys travel packed (packed.py).  Lines with a long passage in common share keys without being near, and many have it; so the nodes of
a key are compared by odd sketches (sketches.py), which lose no link.  What has a possible partner is gathered in leaves (leaves.py), and every two nodes of leaves that
meet are verified by the exact Jaccard similarity of their shingle sets.  Links
are closed to components by distributed union-find, and of each component one line stays: the one
that comes first by (doc_id, line number).  Line texts are read again from the documents, once, for nodes with
candidates only.

Defined results: a null text has no lines and stays null; empty lines, and those under min_chars, always stay; a document
with a null doc_id stays as it is and takes no part; equal rows are decided alike, so a repeated
row keeps what the first keeps; rows that share a doc_id with different texts are documents of their own, in the order of a hash of
the text; a document all of whose lines go has an empty text; an empty table gives
no rows; other columns pass through ``dedup`` untouched.  Node ids are 64 bits of a line's digest.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lean, small, small_lists, stored, table, tidied
from .components import components
from .leaves import LINKED, dealt, gathered, linked
from .media import flushed
from .packed import ENTERED, entered, parts_for, shared_keys
from .sketches import BITS, TOGETHER, odd_sketches, possible
from .tokens import MULTIPLIER, mix

SHINGLE, ROWS, BANDS, SKETCH = 5, 5, 14, 64
#: What dedup takes as min_chars if nothing is given.
MIN_CHARS = 20

#: Characters of texts that are hashed at once (their hashes stay in a core's cache); hashes whose minima are taken together.
BLOCK, LANES = 1 << 16, 16

#: Odd factors: each permutes the (already mixed) 32-bit hashes.
FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * MULTIPLIER).astype(np.uint32) | np.uint32(1)


def shingles(chars: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters from each place on (the last places' hashes are of fewer)."""
    wide = np.zeros(len(chars) + SHINGLE - 1, np.uint64)
    wide[: len(chars)] = chars
    x = wide[: len(chars)].copy()
    for i in range(1, SHINGLE):
        x *= MULTIPLIER
        x += wide[i : i + len(chars)]
        x ^= x >> np.uint64(31)
    return mix(x)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def line_id(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def wide_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the joined lines' shingles; where each line begins; how many shingles it has (with repeats)."""
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.zeros(len(lines), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    return shingles(code_points("\n".join(lines))), starts, sizes - SHINGLE + 1


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line of SHINGLE characters at least."""
    return signatures(lines)[0]


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each line of SHINGLE characters at least, and its sketch: one bit of each of SKETCH minima."""
    wide, starts, sizes = wide_shingles(lines)
    # Each line's hashes fill whole columns of LANES, the last one with repeats of its first hash.
    columns = -(-sizes // LANES)
    cuts = np.concatenate([[0], np.cumsum(columns)[:-1]])
    at = np.arange(columns.sum() * LANES) - np.repeat(cuts * LANES, columns * LANES)
    at[at >= np.repeat(sizes, columns * LANES)] = 0
    x = np.ascontiguousarray((wide[at + np.repeat(starts, columns * LANES)] >> np.uint64(32)).astype(np.uint32).reshape(-1, LANES).T)
    low, y = np.empty((ROWS * BANDS, len(lines)), np.uint32), np.empty_like(x)
    for i in range(ROWS * BANDS):
        np.multiply(x, FACTORS[i], out=y)
        np.minimum.reduceat(np.minimum.reduce(y, axis=0), cuts, out=low[i])
    keys = np.zeros((BANDS, len(lines)), np.uint64)
    for row in range(ROWS):
        keys = mix(keys * MULTIPLIER + low[row::ROWS] + np.arange(row + 1, ROWS * BANDS + 1, ROWS, dtype=np.uint64)[:, None])
    bits = low[:SKETCH] * np.uint32(MULTIPLIER & np.uint64(0xFFFFFFFF)) >> np.uint32(31)
    sketch = np.bitwise_or.reduce(bits.astype(np.uint64) << np.arange(SKETCH, dtype=np.uint64)[:, None], axis=0)
    return np.ascontiguousarray(keys.T).view(np.int64), sketch


def most_places(num: int, den: int) -> int:
    """Places of SKETCH in which the sketches of a pair worth verifying differ."""
    p = (den - num) / den * 0.5
    return int(SKETCH * p + 5 * (SKETCH * p * (1 - p)) ** 0.5)


def blocks(column: pa.Array, min_chars: int):
    """Lists of (text number, line number, stripped line) of the lines that take part, of about BLOCK characters."""
    out, size = [], 0
    for i, text in enumerate(column):
        for no, line in enumerate((text.as_py() or "").split("\n")):
            line = line.strip()
            if len(line) >= max(min_chars, 1):
                out.append((i, no, line))
                size += len(line)
                if size >= BLOCK:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def _placed(min_chars: int):
    """(row, doc_id, text) -> row, doc_id, line_no, node and characters of each line."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("node", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for rows in blocks(batch.column(2), min_chars):
                text, numbers, lines = zip(*rows)
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), pa.array(numbers, pa.int32()), pa.array(map(line_id, lines), pa.int64()), pa.array(map(len, lines), pa.int32())], schema=schema)

    return run


def _entries(min_chars: int):
    """batch (text) -> nodes, band keys and sketches of the lines with shingles, for packed.entered."""

    def found(batch):
        for rows in blocks(batch.column(0), max(min_chars, SHINGLE)):
            lines = list(dict.fromkeys(line for _, _, line in rows))
            keys, sketch = signatures(lines)
            yield np.fromiter(map(line_id, lines), np.int64, len(lines)), np.arange(len(lines) + 1) * BANDS, keys.ravel(), sketch

    return found


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, without what it costs beyond a sort (several times the sort, for a line)."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def line_set(line: str) -> np.ndarray:
    return distinct(shingles(code_points(line))[: max(len(line) - SHINGLE + 1, 0)])


def line_sets(lines: list[str]):
    """The line_set of each line, hashed in blocks."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and size < BLOCK:
            size += len(lines[end])
            end += 1
        wide, starts, sizes = wide_shingles(lines[at:end])
        for a, n in zip(starts.tolist(), sizes.tolist()):
            yield distinct(wide[a : a + max(n, 0)])
        at = end


def _lines(batches):
    """Rows (wanted: line_no and node of lines, text) -> node, line, its characters, size of its set and its odd sketch."""
    schema = pa.schema([("node", pa.int64()), ("line", pa.string()), ("n", pa.int32()), ("size", pa.int64()), ("sketch", pa.binary())])

    def described(found: list[tuple[int, str]]):
        sets = line_sets([line for _, line in found])
        for some in itertools.batched(found, TOGETHER):
            members = list(itertools.islice(sets, len(some)))
            for (node, line), own, sketch in zip(some, members, odd_sketches(members)):
                yield len(line) + BITS // 8, (node, line, len(line), len(own), sketch)

    def rows():
        found, size = [], 0
        for batch in batches:
            for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = (text.as_py() or "").split("\n")
                own = [(w["node"], lines[w["line_no"]].strip()) for w in wanted if w["line_no"] < len(lines)]
                own = [(node, line) for node, line in own if line_id(line) == node]
                found += own
                size += sum(len(line) for _, line in own)
                if size >= BLOCK:
                    yield from described(found)
                    found, size = [], 0
        yield from described(found)

    yield from flushed(rows(), schema)


@tidied("removals")
def removals(docs: DataFrame, num: int = 8, den: int = 10, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (xxhash64 of doc_id and text), gone: the numbers (from 0) of the lines that go, for documents that lose any."""
    known = docs.filter("doc_id IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    places = stored(known.mapInArrow(lean(_placed(min_chars)), "row long, doc_id long, line_no int, node long, n int"), "places")
    parts = parts_for(places.filter(F.col("n") >= SHINGLE).count() * BANDS, True)
    entries = known.select("text").mapInArrow(lean(entered(parts, _entries(min_chars))), ENTERED)
    shared = stored(shared_keys(entries, parts, most_places(num, den), True), "shared-keys")
    first = places.groupBy("node").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("f"), F.count("*").alias("copies"))
    nodes = stored(first.select("node", "f.doc_id", "f.row", "f.line_no", "copies"), "line-nodes")
    asked = small(stored(shared.select("node").distinct(), "asked"), 16)
    wanted = stored(nodes.join(asked, "node").groupBy("row").agg(F.collect_list(F.struct("line_no", "node")).alias("wanted")), "wanted")
    # A document's list holds lines of its own only; repeated rows give a line several times.
    texts = known.join(small_lists(wanted.withColumnRenamed("row", "_row"), "wanted", 16), F.col("row") == F.col("_row")).select("wanted", "text")
    lines = stored(texts.mapInArrow(lean(_lines), "node long, line string, n int, size long, sketch binary"), "lines")
    near = possible(shared, lines.select("node", "size", "sketch").dropDuplicates(["node"]), num, den)
    dropped(shared)
    members, meet = gathered(near, lines.select("node", (8 * F.col("n")).cast("long").alias("bytes")).distinct())
    texts = members.join(lines.select("node", "line"), "node").dropDuplicates(["node"])
    rows = texts.join(meet, "leaf").select("la", "lb", "side", "node", F.lit(1).cast("long").alias("copies"), "line")
    links = stored(dealt(rows).mapInArrow(lean(linked(line_sets, num, den)), LINKED).filter("other IS NOT NULL"), "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked_nodes = small(stored(labels.select("node", "root").unionByName(labels.select(F.col("root").alias("node"), "root").distinct()), "linked-nodes"), 24)
    # A line that occurs once and links with none decides nothing.
    rooted = nodes.join(linked_nodes, "node", "left").filter("root IS NOT NULL OR copies > 1").select("node", F.struct("doc_id", "row", "line_no").alias("f"), F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    keepers = rooted.groupBy("root").agg(F.min("f").alias("keep"))
    decided = stored(rooted.join(keepers, "root").select("node", "keep"), "decided")
    lost = places.join(small(decided, 56), "node").filter((F.col("row") != F.col("keep.row")) | (F.col("line_no") != F.col("keep.line_no")))
    return lost.groupBy("row").agg(F.collect_set("line_no").alias("gone"))


def dedup(docs: DataFrame, num: int = 8, den: int = 10, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text lacking the lines that go, n_lines and n_kept."""
    gone = removals(docs, num, den, min_chars).select(F.col("row").alias("_row"), F.col("gone").alias("_gone"))

    @F.pandas_udf("string")
    def without(texts, lists):
        return pd.Series(["\n".join(x for i, x in enumerate(text.split("\n")) if i not in some) if text is not None else None for text, some in ((t, set(g) if g is not None else ()) for t, g in zip(texts, lists))], dtype="object")

    lost = F.col("_gone").isNotNull()
    n = F.when(F.col("text").isNull(), 0).otherwise(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    joined = docs.join(small_lists(gone, "_gone", 8), row == F.col("_row"), "left")
    changed = F.when(lost, without(F.when(lost, F.col("text")), "_gone")).otherwise(F.col("text"))
    return joined.withColumns({"n_lines": n, "n_kept": n - F.when(lost, F.size("_gone")).otherwise(0), "text": changed}).drop("_row", "_gone")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1).select("doc_id", "n_lines", "n_kept", "text")
