"""The pipeline's stages, each on what its predecessor kept."""

import random
import re
import subprocess
import sys

import pytest

import corpus_pipeline
from basalt.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "the of and ta ro mi ku ze".split() for b in ("", "n", "st", "ler", "vo")]


def test_stages(spark):
    from basalt.llm.common import stored, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stored(stage(spark, docs, sf), name)
        if n < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert set(after) <= set(before) and len(after) >= 0.5 * len(before)
            if name != "line_dedup":
                assert all(before[i] == t for i, t in after.items())
    rows = docs.collect()
    assert rows and all(0 < r.taken <= 3 * r.size for r in rows)


def corpus():
    """Toxic, copied, nearly copied, contaminated and clean documents, with nulls, repeated rows and shared ids."""
    rng = random.Random(21)
    make = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))
    item = make(30)
    clean = [make(80) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, make(30) + " vilest insult " + make(30)) for i in range(40)]
    rows += [(200, "intro " + item + " " + make(20)), (201, make(400) + " " + item)]
    base = clean[0].split()
    for i in range(5):
        w = list(base)
        w[20 + i] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows += [rows[3], rows[3], (3, clean[4] + " " + make(200)), (None, clean[5]), (None, make(50)), (400, None), (401, ""), (402, "one"), (403, "one"), (404, make(20000))]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in rows], [(1, item), (2, None)]


def write(spark, folder, rows, items):
    labels = [(i, 1, int("insult" in (t or ""))) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS root").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    write(spark, str(tmp_path), rows, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r.doc_id), str(r.text))
    # Toxicity: what the labels call toxic goes, the rest stays, empty and null texts too.
    got = sorted(map(key, corpus_pipeline.detoxify(spark, docs, str(tmp_path)).collect()))
    assert got == sorted((str(i), str(t)) for i, t, *_ in rows if "insult" not in (t or ""))
    # Line dedup: documents here are lines; of each component of lines the first by doc_id stays, null ids stay.
    got = sorted(map(key, corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()))
    sets = {t.strip(): {t.strip()[k : k + lines.SHINGLE] for k in range(len(t.strip()) - lines.SHINGLE + 1)} for _, t, *_ in rows if t}
    near = lambda a, b: a == b or bool(sets[a] and sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    first = {}
    for a in sets:  # components here are cliques
        first[a] = min(i for i, t, *_ in rows if i is not None and t and near(a, t.strip())) if any(i is not None and t and near(a, t.strip()) for i, t, *_ in rows) else None
    assert got == sorted((str(i), str(t)) for i, t, *_ in rows if i is None or not t or first[t.strip()] == i)
    # Near-duplicates: one row of each component stays, that of the smallest id, null last.
    got = sorted(map(key, corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t, *_ in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    links = lambda a, b: bool(sets[a]) and bool(sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    group, left = {}, set(range(len(rows)))
    while left:
        todo, found = [left.pop()], set()
        while todo:
            x = todo.pop()
            found.add(x)
            for y in [y for y in left if links(x, y)]:
                left.discard(y)
                todo.append(y)
        for x in found:
            group[x] = found
    groups = {frozenset(g) for g in group.values()}
    assert len(got) == len(groups) and max(map(len, groups)) >= 4
    ids = [str(min((rows[x][0] for x in g if rows[x][0] is not None), default=None)) for g in groups]
    assert sorted(x[0] for x in got) == sorted(ids)
    assert {x[1] for x in got} <= {str(t) for _, t, *_ in rows}
    # Decontamination.
    got = sorted(map(key, corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()))
    assert got == sorted((str(i), str(t)) for i, t, *_ in rows if i != 200 and i != 201)
    # The whole run, and empty tables.
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 40
    write(spark, str(tmp_path / "empty"), rows[:1], items[:1])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


HELD = """
import psutil
from basalt.llm import packed
run, size = %s, psutil.Process().memory_info
before = size().rss
pin = []
def made(batches):
    held = [bytes(90000) + b"x" for _ in range(3000)]
    pin.append(bytes(90000) + b"y")  # what lies behind keeps the freed memory from the top of the heap
    yield len(held)
list(run(made)(iter([])))
print((size().rss - before) >> 20)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="memory is given back by the GNU C library")
def test_workers_give_memory_back():
    """What a task has freed does not stay with the worker that the next stages use again."""
    grown = lambda run: int(subprocess.run([sys.executable, "-c", HELD % run], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).stdout)
    assert grown("lambda f: f") > 150
    assert grown("packed.lean") < 60
