"""Keys that several nodes share, found in packed shuffles.

Entries (key, node, sketch) travel as binary rows of many entries, not as a row each: a task writes, for
each of a number of parts, what it has found for it, and the parts are sorted and compared in arrays.  Nodes
that a task has seen are not entered again (equal texts have equal keys), so copies cost one entry
for each task and no key is hot by copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import MULTIPLIER, mix

#: Bytes of a part, on average; entries held before they are written; nodes that a task remembers; largest group whose pairs are all tested by sketch.
PART, HELD, SEEN, TESTED = 2 << 20, 1 << 18, 1 << 18, 48

ENTERED = "part int, entries binary"


def parts_for(entries: int, sketched: bool) -> int:
    """A number of parts for so many entries."""
    return max(16, entries * (24 if sketched else 16) // PART + 1)


def entered(parts: int, found: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]):
    """A function for mapInArrow.  found: batch -> parts of (nodes, places where each node's keys begin (n + 1), keys, sketch of each node or None)."""
    schema = pa.schema([("part", pa.int32()), ("entries", pa.binary())])

    def run(batches):
        held, size, seen = [], 0, set()

        def rows():
            all_ = np.concatenate(held)
            part = (all_["key"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            all_, part = all_[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = [*cuts[1:].tolist(), len(all_)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array([all_[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary())], schema=schema)

        for batch in batches:
            for nodes, begins, keys, sketch in found(batch):
                new = np.zeros(len(nodes), bool)
                for i, x in enumerate(nodes.tolist()):
                    if x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                count = np.diff(begins)
                take = np.repeat(new, count)
                some = np.zeros(int(take.sum()), entry(sketch is not None))
                some["key"], some["node"] = keys[take].view(np.uint64), np.repeat(nodes, count)[take]
                if sketch is not None:
                    some["sketch"] = np.repeat(sketch, count)[take]
                held.append(some)
                size += len(some)
                if size >= HELD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    return run


def entry(sketched: bool) -> np.dtype:
    return np.dtype([("key", "<u8"), ("node", "<i8")] + [("sketch", "<u8")] * sketched)


def near_any(sketch: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Whether each entry's sketch is near another's of its group; groups beyond TESTED are taken as they are."""
    keep = np.ones(len(sketch), bool)
    for g in np.unique(counts[counts <= TESTED]).tolist():
        at = starts[counts == g]
        for some in (at[i : i + (1 << 18) // (g * g) + 1] for i in range(0, len(at), (1 << 18) // (g * g) + 1)):
            x = sketch[some[:, None] + np.arange(g)]
            near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= most
            near[:, np.arange(g), np.arange(g)] = False
            keep[some[:, None] + np.arange(g)] = near.any(2)
    return keep


def groups(all_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries without repeats of those keys that several nodes have; where each key starts, and its number of nodes."""
    if not len(all_):
        return all_, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(all_["key"], kind="stable")
    key = all_["key"][order]
    same = key[1:] == key[:-1]
    more = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some = all_[order[more]]
    some = some[np.lexsort((some["node"], some["key"]))]
    fresh = np.concatenate([[True], (some["key"][1:] != some["key"][:-1]) | (some["node"][1:] != some["node"][:-1])]) if len(some) else np.zeros(0, bool)
    some = some[fresh]
    starts = np.flatnonzero(np.concatenate([[True], some["key"][1:] != some["key"][:-1]])) if len(some) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(some))
    wide = np.repeat(counts > 1, counts)
    starts = np.cumsum(counts[counts > 1]) - counts[counts > 1]
    return some[wide], starts, counts[counts > 1]


def set_names(node: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key for each group that depends on its set of nodes only."""
    if not len(node):
        return np.zeros(0, np.uint64)
    return mix(np.add.reduceat(mix(node.view(np.uint64) * MULTIPLIER + MULTIPLIER), starts) + counts.astype(np.uint64))


def _shared(sketched: bool, most: int, by_set: bool):
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("centre", pa.int64())])

    def done(held: list[bytes]):
        some, starts, counts = groups(np.frombuffer(b"".join(held), entry(sketched)))
        if sketched:
            some, starts, counts = groups(some[near_any(some["sketch"], starts, counts, most)])
        node, key = np.ascontiguousarray(some["node"]), np.ascontiguousarray(some["key"])
        if by_set:
            key = np.repeat(set_names(node, starts, counts), counts)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(np.repeat(node[starts], counts))], schema=schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if held:
                        yield done(held)
                    now, held = part, []
                held.append(data.as_py())
        if held:
            yield done(held)

    return run


def shared_keys(entries: DataFrame, parts: int, most: int | None = None, by_set: bool = False) -> DataFrame:
    """key, node, centre (the key's smallest node) of keys that several nodes share, from entries (part, entries).

    most: places in which the sketches of two nodes worth comparing may differ (None: there are no sketches).  A node
    that is near no other of its key is left out, unless the key has more than TESTED nodes.
    by_set: keys with the same nodes (near nodes share most of their keys) become one key, named by these nodes."""
    tasks = max(1, parts // 4)
    dealt = entries.repartition(tasks, "part").sortWithinPartitions("part")
    shared = dealt.mapInArrow(lean(_shared(most is not None, most or 0, by_set)), "key long, node long, centre long")
    return shared.distinct() if by_set else shared
