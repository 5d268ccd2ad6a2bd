"""Odd sketches: an exact test that drops most false candidates of a key.

A set's odd sketch holds, for BITS groups of hashed elements, whether their number is odd.  Two sketches differ in no more
places than the sets have elements apart, and sets that link at Jaccard num / den are at most
(den - num) / (den + num) * (|A| + |B|) elements apart, so no link is lost.  Texts with a long passage in common share
keys and are told apart here, many of them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .tokens import MULTIPLIER, mix

#: Bits of a sketch; nodes of a key that are compared in one task (twice as many, if a key has more); sets whose sketches are made together.
BITS, KEY_NODES, TOGETHER = 1024, 4096, 128


def odd_sketch(found: np.ndarray, bits: int = BITS) -> bytes:
    """The parities of a set's numbers of elements by hash; bits is a power of two."""
    return np.packbits(np.bincount((found >> np.uint64(32)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1).tobytes()


def odd_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The odd_sketch of each set; sets of about TOGETHER make the least work."""
    if not sets:
        return []
    own = np.repeat(np.arange(len(sets)) * BITS, [len(x) for x in sets])
    odd = np.bincount(own + (np.concatenate(sets) >> np.uint64(32)).astype(np.int64) % BITS, minlength=len(sets) * BITS).astype(np.uint8) & 1
    return [x.tobytes() for x in np.packbits(odd).reshape(len(sets), -1)]


def wide_sketch(found: np.ndarray) -> bytes:
    """A sketch of two bits an element at least: it tells apart sets of any size, at a 32nd of their bytes or a 16th."""
    return odd_sketch(found, max(BITS, 1 << (2 * len(found) - 1).bit_length()))


def near_partners(sketches: list[bytes], sizes: np.ndarray, n: int | None, num: int, den: int) -> np.ndarray:
    """Which wide sketches leave their set a partner: the first n against the others, or (n is None) all against all.

    Sets that link are in equal or neighbouring widths; the wider sketch is folded."""
    words = [np.frombuffer(x, np.uint64) for x in sketches]
    width, left = np.array([len(w) for w in words]), np.zeros(len(words), bool)
    for w in np.unique(width).tolist():
        some = np.flatnonzero((width == w) | (width == 2 * w))
        m = np.stack([words[i] if width[i] == w else words[i][:w] ^ words[i][w:] for i in some])
        exact, size, first = width[some] == w, sizes[some], some < (0 if n is None else n)
        step = max(1, (1 << 20) // m.size)
        for at in range(0, len(some), step):
            mine = slice(at, at + step)
            apart = np.bitwise_count(m[mine, None] ^ m[None]).sum(2, dtype=np.int64)
            close = (num + den) * apart <= (den - num) * (size[mine, None] + size[None])
            close &= exact[mine, None] | exact[None]
            close &= some[mine, None] != some[None]
            if n is not None:
                close &= first[mine, None] != first[None]
            left[some[mine]] |= close.any(1)
            left[some] |= close.any(0)
    return left


def group_labels(near: np.ndarray) -> np.ndarray:
    """For symmetric relations (groups, g, g) the smallest index that each index reaches."""
    label = np.broadcast_to(np.arange(near.shape[1], dtype=np.int32), near.shape[:2]).copy()
    while True:
        low = label.copy()
        for at in range(0, near.shape[1], 256):  # stripes of large groups
            part = np.where(near[:, at : at + 256], label[:, None, :], np.int32(near.shape[1])).min(2)
            low[:, at : at + 256] = np.minimum(low[:, at : at + 256], part)
        low = np.minimum(low, np.take_along_axis(low, low.astype(np.int64), 1))
        if (low == label).all():
            return label
        label = low


def _possible(num: int, den: int):
    """Rows (key, low, high, side, node, size, sketch, whole), by blocks of a key -> key and node of those with a possible partner.

    Where a block is a whole key, the key is told apart for nodes that no chain of possible partners connects."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def tested(rows: pa.Table):
        key, low, high, side, node, size = (rows.column(i).to_numpy() for i in range(6))
        sketch = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint64).reshape(len(key), -1)
        whole = rows.column(7).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        counts, keep, named = np.diff(starts, append=len(key)), np.zeros(len(key), bool), key.copy()
        for g in np.unique(counts[counts > 1]).tolist():
            at, step = starts[counts == g], (1 << 15) // (g * g) + 1
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                places = some[:, None] + np.arange(g)
                near = np.zeros((len(some), g, g), bool)
                for part in range(0, g, 256):
                    mine = places[:, part : part + 256]
                    apart = sum(np.bitwise_count(sketch[mine, w][:, :, None] ^ sketch[places, w][:, None, :]).astype(np.int32) for w in range(sketch.shape[1]))
                    close = (num + den) * apart <= (den - num) * (size[mine][:, :, None] + size[places][:, None, :])
                    close &= node[mine][:, :, None] != node[places][:, None, :]
                    near[:, part : part + 256] = close & ((low[mine] == high[mine])[:, :, None] | (side[mine][:, :, None] != side[places][:, None, :]))
                keep[places] |= near.any(2)
                one = places[whole[some]]
                if len(one):
                    label = np.take_along_axis(node[one], group_labels(near[whole[some]]).astype(np.int64), 1)
                    named[one] = mix((key[one] ^ label).view(np.uint64) * MULTIPLIER + key[one].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(named[keep]), pa.array(node[keep])], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows from the start of a block on
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                key, low, high = (part.column(i).to_numpy() for i in range(3))
                ends = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
                last = held and tuple(held[-1].column(i)[-1].as_py() for i in range(3))
                if held and last != (key[0], low[0], high[0]):
                    yield tested(pa.Table.from_batches(held))
                    held = []
                if len(ends):
                    yield tested(pa.Table.from_batches([*held, part.slice(0, int(ends[-1]) + 1)]))
                    held, part = [], part.slice(int(ends[-1]) + 1)
                held.append(part)
        if held:
            yield tested(pa.Table.from_batches(held))

    return run


def _wide(num: int, den: int):
    """The same rows with wide sketches -> key and node of those that these leave a partner in a block."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def tested(block: tuple[int, int, int], rows: list[tuple]):
        rows.sort(key=lambda x: x[0] != block[1])
        sides, nodes, sizes, sketches = zip(*rows)
        n = None if block[1] == block[2] else sides.count(block[1])
        left = np.flatnonzero(near_partners(sketches, np.array(sizes, np.int64), n, num, den))
        return [(block[0], nodes[i]) for i in left.tolist()]

    def run(batches):
        now, held = None, []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], schema=schema)

        for batch in batches:
            found = []
            for key, low, high, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (key, low, high) != now:
                    if len(held) > 1:
                        found += tested(now, held)
                    now, held = (key, low, high), []
                held.append(row)
            if found:
                yield batch_of(found)
        if len(held) > 1:
            yield batch_of(tested(now, held))

    return run


def _dealt(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """key, low, high, side, node, size, sketch, whole: the nodes of each key by pairs of its blocks."""
    blocks = shared.groupBy("key").agg(F.ceil(F.count("*") / KEY_NODES).cast("int").alias("blocks"))
    rows = shared.select("key", "node").join(sketches, "node").join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "size", "sketch", (F.col("blocks") == 1).alias("whole"))
    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def possible(shared: DataFrame, sketches: DataFrame, num: int, den: int, wide: DataFrame | None = None) -> DataFrame:
    """key, node, centre of shared (key, node) for the nodes that the odd sketches leave a partner of their key; what is
    not connected in a key has another one.

    wide: node, size and wide sketch, which then tell apart in each key the large sets that BITS bits can't."""
    left = stored(_dealt(shared, sketches).mapInArrow(lean(_possible(num, den)), "key long, node long").distinct(), "possible")
    if wide is not None:
        left = stored(_dealt(left, wide).mapInArrow(lean(_wide(num, den)), "key long, node long").distinct(), "possible-wide")
    centres = left.groupBy("key").agg(F.min("node").alias("centre"))
    return stored(left.join(centres, "key").select("key", "node", "centre"), "possible-keys")
