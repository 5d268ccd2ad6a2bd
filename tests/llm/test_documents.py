"""Operators over documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import boxes, common, decontamination, jaccard, language_model, leaves, lines, media, mixing, packed, sketches, tokencount, tokens, toxicity
from basalt.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a int, node string, size int, root string"
WORDS = [f"{a}{b}" for a in "the of and ta ro mi ku ze".split() for b in ("", "n", "st", "ler", "vo")]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    out = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "one"), (None, "one two")]
    for i in range(10, 10 + n):
        kind = rng.random()
        if kind < 0.5 or len(out) < 20:
            out.append((i, "\n".join(make(rng.randint(3, 60)) for _ in range(rng.randint(1, 6)))))
        else:
            words = re.split(r"(\s)", rng.choice(out[8:])[1])
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append((i, "".join(words)))
    out.append((900, make(30000)))
    out += [out[12], out[12]]
    return out


@pytest.fixture(scope="module")
def docs():
    return documents()


def frame(spark, rows):
    rng = random.Random(5)
    return spark.createDataFrame([(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "ä"]), len(t or ""), 1, "x", 2, "y") for i, t in rows], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(names, pairs):
    up = {x: x for x in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in names}


def test_word_hashes_in_small_blocks(monkeypatch):
    texts = ["The  cat sat\n on", "the cat", "", None, "x", " CAT the", "éa É", "word " * 500, "y" * 300, "z"]
    whole = tokens.word_hashes(*tokens.text_bytes(pa.array(texts)))
    for block in (16, 64, 1000):
        monkeypatch.setattr(tokens, "BLOCK", block)
        tokens._powers.clear()
        part = tokens.word_hashes(*tokens.text_bytes(pa.array(texts)))
        assert all(np.array_equal(a, b) for a, b in zip(whole, part))
    assert list(np.diff(whole[1])) == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sliced = tokens.word_hashes(*tokens.text_bytes(pa.array(texts).slice(4)))
    assert np.array_equal(sliced[0], whole[0][whole[1][4] :])


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (3, 2)]
    want = groups({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def linked_rows(rows, n, num, den):
    """Brute force over rows: (doc_id, n_shingles, component_id, n_links) of each."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root, links, low = groups(range(len(rows)), pairs), [0] * len(rows), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[root[i]] = min(key, low.get(root[i], key))
    return [(key, len(sets[i]), low.get(root[i]), links[i]) for i, (key, _) in enumerate(rows)], pairs


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 8, 10), (1, 5, 10)])
def test_jaccard_components(spark, docs, n, num, den):
    chain = [f"c{i}" for i in range(60)]
    rows = docs + [(2001, " ".join(chain)), (None, " ".join(chain[:-2] + ["x", "y"])), (2002, " ".join(["z"] + chain[1:-2] + ["x", "y"])), (None, "alone " * 3 + "here"), (None, "alone " * 3 + "here")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(frame(spark, rows), n, num, den).collect()), key=str)
    want, pairs = linked_rows(rows, n, num, den)
    assert pairs and got == sorted(want, key=str)


def test_jaccard_many_variants_of_one_text(spark):
    """A group whose members are near a common text but mostly not near each other."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(frame(spark, rows), 3, 9, 10).collect())
    assert got == sorted(linked_rows(rows, 3, 9, 10)[0])


def test_jaccard_large_group(spark, monkeypatch):
    """A group of several leaves, each of several boxes, with a hot key; and texts that only share a passage with it."""
    monkeypatch.setattr(leaves, "LEAF_NODES", 40)
    monkeypatch.setattr(boxes, "NODE", 8)
    rng = random.Random(10)
    base = [f"{rng.choice(WORDS)}{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"v{i}"
        if i % 3 == 0:
            w[rng.randrange(80)] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:40] + [f"{rng.choice(WORDS)}{rng.random()}" for _ in range(40)])) for i in range(20)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(frame(spark, rows), 3, 9, 10).collect())
    assert got == sorted(linked_rows(rows, 3, 9, 10)[0])


def test_overlaps_and_bounds():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 120), dtype=np.uint64) * tokens.MULTIPLIER) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (leaves.overlaps(sets, 40) == want).all() and (leaves.overlaps(sets, 15) == want[:15, 15:]).all()
    assert (leaves.overlaps(sets[:2], 1) == want[:1, 1:2]).all() and (leaves.overlaps(sets[:2], 2) == want[:2, :2]).all()
    points, sizes = np.array([boxes.point(s) for s in sets]), np.array([len(s) for s in sets])
    near = boxes.bounded(points, sizes, points, sizes, 1, 2)
    assert near[(2 * want >= sizes[:, None] + sizes[None, :] - want) & (want > 0)].all() and not near.all()
    assert list(leaves.forest(np.array([[0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0], [0, 1, 0, 0]], bool))) == [0, 1, 0, 1]


def test_line_dedup(spark, docs):
    rows = docs + [(950, "A line that is repeated in many documents, word for word.\nshort\nshort"), (951, "x\nA line that is repeated in many documents, word for word.\r\nA line that is repeated in many documents; word for word."), (952, "A line that is repeated in many documents, word for word.")]
    got = [(r.doc_id, r.text, r.n_lines, r.n_kept, r.lang, r.a) for r in lines.dedup(frame(spark, rows)).collect()]
    at = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if i is not None and len(line.strip()) >= lines.MIN_CHARS:
                at.setdefault(line.strip(), set()).add((i, no))
    k = lines.SHINGLE
    sets = {x: {x[j : j + k] for j in range(len(x) - k + 1)} for x in at}
    named = groups(sets, [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    first = {}
    for x, places in at.items():
        first[named[x]] = min(first.get(named[x], (1 << 60, 0)), min(places))
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for no, x in enumerate(parts) if i is None or len(x.strip()) < lines.MIN_CHARS or first[named[x.strip()]] == (i, no)]
        want.append((i, None if t is None else "\n".join(kept), len(parts) if t is not None else 0, len(kept) if t is not None else 0))
    assert sorted((g[:4] for g in got), key=str) == sorted(want, key=str)
    assert any(w[2] > w[3] for w in want) and all(g[5] == 1 for g in got)
    assert lines.dedup(frame(spark, rows).limit(0)).collect() == []


def test_line_dedup_of_every_line(spark, docs):
    """Brute force without a least length: lines without shingles link with their equals only."""
    rows = docs + [(960, "ab\nHaanth.\nabc\n\nab"), (961, "ab\n \nHaanth.\nabd\n\tHaanth. \n"), (962, "short line 12\nabcde\naaaaaa"), (963, "short line 12\nabcdf\naaaaaaaa\nshort line 13")]
    got = [(r.doc_id, r.text, r.n_lines, r.n_kept) for r in lines.dedup(frame(spark, rows), min_chars=1).collect()]
    at, k = {}, lines.SHINGLE
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip():
                at.setdefault(line.strip(), set()).add((i, no))
    sets = {x: {x[j : j + k] for j in range(len(x) - k + 1)} for x in at}
    named = groups(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    first = {}
    for x, places in at.items():
        first[named[x]] = min(first.get(named[x], (1 << 60, 0)), min(places))
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for no, x in enumerate(parts) if i is None or not x.strip() or first[named[x.strip()]] == (i, no)]
        want.append((i, None if t is None else "\n".join(kept), len(parts) if t is not None else 0, len(kept) if t is not None else 0))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (960, "ab\nHaanth.\nabc\n", 5, 4) in got and (961, " \nabd\n", 6, 3) in got


def test_line_dedup_empties_documents(spark):
    line = "A line that is repeated in many documents, word for word."
    kept = corpus_pipeline.dedup_lines(spark, frame(spark, [(1, line + "\nHaanth."), (2, "Haanth.\n\n" + line), (3, "\n"), (4, None)]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_band_recall():
    rng = random.Random(2)
    hit = total = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(240))
        b = list(a)
        b[rng.randrange(240)] = "#"
        b[rng.randrange(240)] = "%"
        b = "".join(b)
        x, y = set(lines.line_set(a).tolist()), set(lines.line_set(b).tolist())
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            keys = lines.band_keys([a, b])
            hit += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert total > 200 and hit >= 0.97 * total


def test_line_recall_of_bands_and_sketches(spark):
    """Planted pairs at a similarity of 0.8 to 0.9, through keys, sketches, leaves and verification."""
    rng = random.Random(12)
    texts, planted = [], 0
    for i in range(300):
        a = "".join(rng.choice("abcdefghijklm ") for _ in range(200)).strip().ljust(200, "x")
        b = list(a)
        for _ in range(3):
            b[rng.randrange(200)] = "#"
        x, y = set(lines.line_set(a).tolist()), set(lines.line_set("".join(b)).tolist())
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            planted += 1
            texts += [(2 * i, a), (2 * i + 1, "".join(b))]
    kept = {r.doc_id: r.n_kept for r in lines.dedup(spark.createDataFrame(texts, "doc_id long, text string"), min_chars=1).collect()}
    assert planted > 150 and all(kept[i] for i, _ in texts if i % 2 == 0)
    assert sum(not kept[i] for i, _ in texts if i % 2) >= 0.97 * planted


def test_line_dedup_of_a_large_family(spark, monkeypatch):
    """More variants of a line than are tested by sketch, in several leaves."""
    monkeypatch.setattr(leaves, "LEAF_NODES", 30)
    rng = random.Random(13)
    base = [rng.choice(WORDS) for _ in range(40)]
    rows = []
    for i in range(130):
        w = list(base)
        w[rng.randrange(40)] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()
    assert sorted(r.doc_id for r in got if r.n_kept) == [0]


def test_line_keys_of_the_same_nodes_are_compared_once(spark, monkeypatch):
    """Near lines share most of their keys; their sketches and texts travel for one of them, and texts of documents not at all."""
    rng, rows, sets, plans = random.Random(14), [], [], []
    for i in range(60):
        w = [rng.choice(WORDS) for _ in range(30)]
        rows.append((3 * i, " ".join(w)))
        for j in range(1, rng.randint(2, 3)):
            rows.append((3 * i + j, " ".join([*w[:-1], f"v{j}"])))

    def possible(shared, *rest):
        sets.extend(tuple(r.s) for r in shared.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("s")).collect())
        return sketches.possible(shared, *rest)

    def stored(df, name, *rest):
        if name == "lines":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, name, *rest)

    monkeypatch.setattr(lines, "possible", possible)
    monkeypatch.setattr(lines, "stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in got if r.n_kept) == [3 * i for i in range(60)]
    assert len(sets) == len(set(sets)) >= 60 and all(len(set(x)) == len(x) > 1 for x in sets)
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_sets_and_odd_sketches_of_many_lines():
    rng = random.Random(15)
    some = ["", "a", "abcd", "abcde", "aaaaaaaaaaaa", *("".join(rng.choice("abc ") for _ in range(rng.randint(0, 400))) for _ in range(300)), "", "ab"]
    sets = list(lines.line_sets(some))
    want = [np.unique(lines.shingles(lines.code_points(x))[: max(len(x) - lines.SHINGLE + 1, 0)]) for x in some]
    assert len(sets) == len(some) and all((a == b).all() and len(a) == len(b) for a, b in zip(sets, want))
    assert sketches.odd_sketches(sets) == [sketches.odd_sketch(x) for x in want] and sketches.odd_sketches([]) == []


def test_small_meetings_are_decoded_together():
    """Own leaves, meetings of two, and one whose second side is missing, over batches that cut them."""
    rng, rows, want = random.Random(16), [], set()
    for k in range(60):
        base = "".join(rng.choice("abcdefgh ") for _ in range(120))
        other = k if k % 2 else k + 1000
        side = [False, k % 2 == 0 and k != 30, k % 2 == 0 and k != 30]
        for i, line in enumerate((base, base + "x", "y" * 50)):
            rows.append((k, other, side[i], 10 * k + i, 1, line))
        if k != 30:
            want.add((10 * k + 1, 10 * k))
    calls = []

    def decode(data):
        calls.append(len(data))
        return lines.line_sets(data)

    columns = ["la", "lb", "side", "node", "copies", "data"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows[at : at + 50]]) for at in range(0, len(rows), 50)]
    out = [r for b in leaves.linked(decode, 8, 10)(iter(batches)) for r in b.to_pylist()]
    assert {(r["node"], r["other"]) for r in out if r["other"] is not None} == want
    assert sorted((r["node"], r["weight"]) for r in out if r["other"] is None) == sorted((x, 1) for pair in want for x in pair)
    assert sum(calls) == 3 * 59 and len(calls) <= 2


def test_wide_sketches_tell_long_sets_of_a_key_apart(spark, monkeypatch):
    """Long sets that share a passage and no more are let go before they are gathered, in one block or several; links stay."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    passage = draw(1000)
    sets = [np.concatenate([passage, draw(7000 + 10 * i)]) for i in range(40)]
    sets += [np.concatenate([sets[3][:7300], draw(600)]), sets[5][: 7 * len(sets[5]) // 8]]
    shared = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(len(sets))], "key long, node long")
    table = lambda sketch: spark.createDataFrame([(i, len(x), bytearray(sketch(x))) for i, x in enumerate(sets)], "node long, size long, sketch binary")
    odd, wide = table(sketches.odd_sketch), table(sketches.wide_sketch)
    assert len({r.node for r in sketches.possible(shared, odd, 8, 10).collect()}) == 42
    for nodes in (4096, 10):
        monkeypatch.setattr(sketches, "KEY_NODES", nodes)
        rows = sketches.possible(shared, odd, 8, 10, wide).collect()
        assert sorted(r.node for r in rows) == [3, 3, 5, 5, 40, 40, 41, 41]
        assert {r.centre for r in rows} == {3}


def test_wide_sketches_lose_no_link():
    """Sets from a few to thousands of elements, also across the width at which a sketch doubles."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (3, 40, 500, 512, 520, 1020, 1030, 4000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0, 0.03, 0.09, 0.3):
            k = int(len(base) * share)
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])))
        sets.append(np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)))
    size, wide = np.array([len(x) for x in sets]), [sketches.wide_sketch(x) for x in sets]
    link = np.array([[i != j and 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    left = sketches.near_partners(wide, size, None, 8, 10)
    assert left[link.any(1)].all() and not left[4::5][2:].any()
    cross = np.arange(len(sets)) < 13
    left = sketches.near_partners(wide, size, 13, 8, 10)
    assert left[(link & (cross[:, None] != cross[None])).any(1)].all()


def test_packed_groups():
    all_ = np.array([(1, 5, 0), (2, 5, 0), (1, 5, 0), (3, 6, 7), (3, 4, 7), (3, 9, (1 << 64) - 1), (9, 1, 0)], packed.entry(True))
    some, starts, counts = packed.groups(all_)
    assert list(some["node"]) == [4, 6, 9] and list(starts) == [0] and list(counts) == [3]
    assert list(packed.near_any(some["sketch"], starts, counts, 10)) == [True, True, False]
    for few in (all_[:0], all_[:1], all_[[0, 2]]):
        some, starts, counts = packed.groups(few)
        assert len(some) == len(starts) == len(counts) == 0 == len(packed.near_any(some["sketch"], starts, counts, 10))


def test_decontamination(spark, docs):
    rng = random.Random(4)
    items = [(1, "Ta ro mi ku ze tan ron"), (2, None), (3, "..."), (None, "one two")] + [(10 + i, " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(77, "the the the the the the the the the the the the the the the")]
    rows = list(docs)
    for i in range(15):
        w = rng.choice(items[4:])[1].split()
        cut = rng.randrange(len(w))
        rows.append((2000 + i, "filler words, " + " ".join(w[cut:] if i % 3 else w).upper() + ", more filler " * rng.randint(0, 30)))
    rows.append((3000, "the " * 40 + "one, two"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    got = sorted((tuple(r) for r in decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("dkey", F.lit(1))).drop("dkey").collect()), key=str)
    want = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p] == v[s] and w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        names |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want, key=str) and any(w[2] for w in want)


def test_proximity(spark, docs):
    """Occurrences of the rarest term with enough of the item's terms around them, against brute force."""
    items = [(1, "alpha beta gamma"), (2, "ta ro mi ku ze tan"), (3, "the the the"), (4, None), (5, "delta epsilon")]
    rows = [(1, "gamma x alpha y beta"), (2, "alpha " + "x " * 50 + "beta " + "x " * 50 + "gamma"), (3, "x " * 7 + "delta " + "x " * 8 + "epsilon"), (4, "x " * 7 + "delta " + "x " * 7 + "epsilon")] + [r for r in docs if r[0] is not None and r[0] != 900][:40]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    terms = decontamination.test_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = decontamination.build_index(frame(spark, rows), terms)
    name = {r.dkey: r.doc_id for r in index.filter("tid IS NULL").collect()}
    item = {r.ikey: r.item_id for r in terms.collect()}
    got = {(name[r.dkey], item[r.ikey], r.pos, r.n_terms) for r in decontamination.proximity_matches(index, terms, decontamination.posting_counts(index), 8, 0.6).collect()}
    total, want = {}, set()
    for _, t in rows:
        for w in split(t):
            total[w] = total.get(w, 0) + 1
    for key, text in items:
        own = list(dict.fromkeys(split(text)))
        known = [(total[w], i, w) for i, w in enumerate(own) if w in total]
        for i, t in rows if known else []:
            w = split(t)
            for p in (p for p in range(len(w)) if w[p] == min(known)[2]):
                n = len(set(own) & set(w[max(0, p - 8) : p + 9]))
                if n >= max(2, -(-6 * len(own) // 10)):
                    want.add((i, key, p, n))
    assert got - want == set() and want - got == set()
    assert {x[0] for x in want} >= {1, 4} and not {x[0] for x in want} & {2, 3}


def test_mixing(spark, docs):
    got = mixing.mix(frame(spark, docs), F.array("source"), F.col("text"), lambda i: i % 3 + 1).collect()
    again = mixing.mix(frame(spark, docs).repartition(7), F.array("source"), F.col("text"), lambda i: i % 3 + 1).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(docs)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.pieces)
        by.setdefault(r.members[0], [0, 0, r.source_size, r.target])
        by[r.members[0]][0] += r.taken
        by[r.members[0]][1] += r.size
    assert all(abs(t - v[3]) <= 1 and s == v[2] for v in by.values() for t, s in [v[:2]])
    assert abs(sum(v[3] for v in by.values()) - sum(v[1] for v in by.values())) < 1e-6
    assert mixing.water_fill([0, 0], [1, 2], 3) == [0, 0] and [int(x) for x in mixing.water_fill([10, 1000], [9, 1], 3)] == [30, 980]
    assert mixing.mix(frame(spark, docs).limit(0), F.array("source"), F.col("text"), lambda i: 1).collect() == []


def test_mixing_overlaps(spark):
    rows = [(i, "w " * 10, ["a"] if i < 40 else ["a", "b"] if i < 60 else ["b"]) for i in range(70)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, m array<string>"), F.col("m"), F.col("text"), lambda i: [1, 3][i]).collect()
    assert [sum(p.words for r in got for p in r.pieces if p.source_no == s) for s in (0, 1)] == [175, 525]
    assert all(r.taken <= 20 for r in got) and sum(r.taken for r in got if "b" in r.members) == 525  # nothing thrice, "a" from fresh text
    flow = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 10)], [10, 20], 3)
    assert flow == [{0: 10}, {1: 10}, {1: 10}]


def test_media_round_trip(spark, docs):
    rows = media.media_table(frame(spark, docs)).mapInArrow(media._read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    want = []
    for i, t in docs:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert len({r.media_sha256 for r in rows}) == len({t or "" for _, t in docs})


def test_media_probe(spark):
    payload = bytes(range(256)) * 100
    track = media.tracks(memoryview(media.pack(payload)))[0]
    assert media.unpack(memoryview(media.pack(payload)), track) == payload and track["codec"] == "raw "
    assert all(media.pack(payload)[a : a + n] == payload[i * 4096 : i * 4096 + 64] for i, (a, n) in enumerate(media.key_ranges(track)))
    sized = dict(track, fixed=0, sizes=(3, 5, 7, 9), n=4, stsc=[(1, 3, 1), (2, 1, 1)], offsets=(100, 500), stss=(2, 4))
    assert media.key_ranges(sized) == [(103, 5), (500, 9)]
    df = spark.createDataFrame([(bytearray(media.pack(payload)),), (None,), (bytearray(b"junk, no boxes"),), (bytearray(),)], "media binary")
    got = media.probe(df).collect()
    assert got[0].codec == "raw " and got[0].duration_s == len(payload) / 8000 and len(got[0].keyframes) == 7
    assert got[1].error is None and got[1].codec is None and got[2].error and got[3].error


@pytest.mark.parametrize("block", [64, 2 << 20])
def test_token_counts(spark, docs, tmp_path, monkeypatch, block):
    ids = [[random.Random(100 * i + j).randrange(50000) for j in range(n)] for i, n in enumerate([3, 0, 500, 1, 0, 0, 40])]
    flat = [x for d in ids for x in [*d, tokencount.SEPARATOR]]
    monkeypatch.setattr(tokencount, "BLOCK", block)
    sizes = []
    for name, tail in (("a", []), ("b", [1, 2, 3]), ("c", list(range(200)))):
        (tmp_path / name).write_bytes(np.array(flat + tail, "<u2").tobytes())
        sizes.append((str(tmp_path / name), 2 * len(flat + tail)))
    (tmp_path / "d").write_bytes(b"")
    files = spark.createDataFrame(sizes + [(str(tmp_path / "d"), 0)], "path string, length long")
    got = sorted((r.path[-1], r.ordinal, r.n_tokens, r.closed) for r in tokencount.scan_files(files).collect())
    want = sorted([(x, i, len(d), True) for x in "abc" for i, d in enumerate(ids)] + [("b", 7, 3, False), ("c", 7, 200, False)])
    assert got == want


def test_token_counts_against_the_tokenizer(spark, docs, monkeypatch):
    """Writer, scan over many blocks and join back, against the tokenizer itself."""
    import base64

    import tiktoken

    monkeypatch.setattr(tokencount, "BLOCK", 128)
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("test", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    monkeypatch.setattr(tokencount, "table", lambda *_: frame(spark, docs + [(7000, "<|endoftext|> as text")]).repartition(3))
    got = sorted(((r.doc_id, r.n_tokens) for r in tokencount.op8_token_counts(spark, "").collect()), key=str)
    assert got == sorted(((i, len(encode(t or ""))) for i, t in docs + [(7000, "<|endoftext|> as text")]), key=str)


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [(None, "x"), (1, None), (2, ""), (3, "y " * 20000)], [(1, None, None), (5000, 1, 1)]
    for i in range(10, 500):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(40)] + (["vilest", "insult"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(10, 500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= s <= 1 for s in got.values()) and len(model[0]) < 5000
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(5), toxicity.train(docs.repartition(3), labels)).collect()}
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert [r.h for r in docs.filter("doc_id IS NULL").select(toxicity.held_out().alias("h")).collect()] == [False]


def test_ftrl_against_plain_python():
    """The same updates one coordinate at a time."""
    rng = random.Random(14)
    rows = [(np.array(sorted({rng.randrange(50) for _ in range(8)} | {1 << toxicity.BITS}), np.int32), rng.randrange(2)) for _ in range(60)]
    z, n, penalty = {}, {}, toxicity.L1 * (60 / toxicity.TRAIN_ROWS) ** 0.5

    def weight(i):
        p = 0 if i == 1 << toxicity.BITS else penalty
        if abs(z.get(i, 0)) <= p:
            return 0.0
        return -(z[i] - (p if z[i] > 0 else -p)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    got = toxicity.ftrl(rows)
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


def test_language_model(spark):
    rng = random.Random(6)
    rows = [(None, "the ta", None), (1, None, "en"), (2, "", "en"), (3, "zz", None)] + [(i, " ".join(rng.choice(WORDS) for _ in range(60)), "en" if i % 2 else "de") for i in range(10, 120)] + [(i, "".join(rng.choice("#%&*|") for _ in range(200)), "en") for i in range(200, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(10, 100)] + [(None,)], "doc_id long")
    a = {r.doc_id: r for r in language_model.quality(docs, trusted).collect()}
    b = {r.doc_id: r for r in language_model.quality(docs, trusted, 0).collect()}
    assert len(a) == len({r[0] for r in rows}) == len(b)
    for i in a:
        assert a[i].keep == b[i].keep and (a[i].perplexity is None) == (b[i].perplexity is None)
        assert a[i].perplexity is None or abs(a[i].perplexity / b[i].perplexity - 1) < 1e-4
    # The threshold is a quantile of 14 documents here: what resembles them is kept but for its tail, the rest is not.
    assert sum(a[i].keep for i in range(10, 120)) >= 107 and not any(a[i].keep for i in range(200, 210))
    assert all(a[i].keep == (a[i].perplexity <= a[i].threshold) for i in range(10, 120)) and len({(r.lang, r.threshold) for r in a.values() if r.lang}) == 2
    assert a[2].perplexity is None and a[2].keep and a[None].lang is None
    model = language_model.train(docs.filter("doc_id BETWEEN 10 AND 100").select("lang", "text"))
    sums = model.filter("k = 2").groupBy("lang", F.shiftright("gram", 8).alias("c")).agg(F.sum(F.exp("logp")).alias("p")).collect()
    assert sums and all(r.p < 1.0001 for r in sums)  # what is missing is the back-off mass


def test_language_model_repeated_rows(spark):
    """Each input row has its row in the result, with a model in the workers and with a sharded one."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(20)), "en") for i in range(20)]
    rows += [rows[3]] * 3 + [(None, "the ta", None)] * 2 + [(30, None, "en")] * 2
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in range(15)], "doc_id long")
    a, b = (sorted(((r.doc_id, r.lang, r.n_bytes, round(r.perplexity or 0, 2), r.keep) for r in language_model.quality(docs, trusted, limit).collect()), key=str) for limit in (language_model.SMALL, 0))
    assert len(a) == len(rows) and a == b


def kneser_ney(texts, order):
    """Plain interpolated modified Kneser-Ney over bytes: a function (context bytes, byte) -> probability."""
    padded = [bytes(order) + t.encode() for t in texts]
    counts = {order: {}}
    for t in padded:
        for i in range(order, len(t)):
            g = t[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discounts, sums = {}, {}
    for k, c in counts.items():
        n = [sum(x == i for x in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discounts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5 * i, 0.1), i - 0.1) for i in (1, 2, 3)]
        for g, x in c.items():
            total, back = sums.get(g[:-1], (0, 0))
            sums[g[:-1]] = total + x, back + discounts[k][min(x, 3)]

    def p(context, byte):
        k = len(context) + 1
        lower = p(context[1:], byte) if context else 1 / 256
        if context not in sums:
            return lower
        total, back = sums[context]
        x = counts[k].get(context + bytes([byte]), 0)
        return (x - discounts[k][min(x, 3)]) / total + back / total * lower

    return p


def test_kneser_ney_against_plain_python(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(12)), "en") for i in range(30)]
    rows += rows[:3] + [(50, "éx zu", "en"), (51, "ta" * 30, "en")]
    trained = [r for r in rows if r[0] < 25]
    model = kneser_ney([t for _, t, _ in trained], language_model.ORDER)
    want = []
    for i, t, _ in rows:
        raw = bytes(language_model.ORDER) + t.encode()
        want.append((i, sum(np.log(model(raw[j - language_model.ORDER + 1 : j], raw[j])) for j in range(language_model.ORDER, len(raw)))))
    schema = "doc_id long, text string, lang string"
    trained_model = language_model.train(spark.createDataFrame(trained, schema).select("lang", "text"))
    for limit in (language_model.SMALL, 0):
        got = sorted((r.doc_id, r.log_p) for r in language_model.score(spark.createDataFrame(rows, schema), trained_model, limit).collect())
        assert [g[0] for g in got] == [w[0] for w in sorted(want)] and all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, sorted(want)))
