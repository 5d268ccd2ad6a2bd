"""End-to-end statements on small tables: queries, DML, constraints, functions."""

import pytest

from basalt.operators.catalog import EngineError, Sequence
from basalt.plans.dialect import DialectError
from basalt.plans.engine import Engine


@pytest.fixture
def e(spark):
    return Engine(spark)


def one(e, text, params=()):
    return e.execute(text, params).rows()[0][0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("5/2", 2), ("-7/2", -3), ("10%3", 1), ("-5", -5), ("CAST('42' AS INT)", 42), ("CAST(3.7 AS INT)", 4), ("CAST(-2.5 AS INT)", -3), ("true::TEXT", "true"), ("NULLIF(5,5)", None),
        ("SUBSTRING('hello' FROM 2 FOR 3)", "ell"), ("substring('hello', -1, 3)", "h"), ("TRIM(LEADING ' ' FROM '  hello  ')", "hello  "), ("ltrim('xxab','x')", "ab"), ("REPLACE('aXb','X','--')", "a--b"),
        ("POSITION('lo' IN 'hello')", 4), ("strpos('hello','z')", 0), ("LEFT('hello',2)", "he"), ("LEFT('hello',-2)", "hel"), ("RIGHT('hello',2)", "lo"), ("RIGHT('hello',-2)", "llo"), ("CEIL(4.2)", 5), ("FLOOR(4.8)", 4),
        ("ROUND(4.567,2)", 4.57), ("ROUND(-2.5)", -3.0), ("MOD(10,3)", 1), ("POWER(2,10)", 1024.0), ("SQRT(144)", 12.0), ("concat('a',NULL,1)", "a1"), ("'a' || NULL", None), ("'off'::bool", False), ("'yes'::bool", True),
        ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("5 NOT BETWEEN 1 AND NULL", None), ("3 IN (1, NULL)", None), ("3 NOT IN (3, NULL)", False), ("'100%' LIKE '100\\%'", True), ("'Alice' ILIKE 'aL%'", True),
        ("1 IS DISTINCT FROM NULL", True), ("coalesce(NULL, 2)", 2), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE NULL WHEN NULL THEN 1 ELSE 0 END", 0), ("'it''s'", "it's"), ("'a\\b'", "a\\b"),
        ("'[1,0]' <-> '[4,4]'", 5.0), ("'[1,2]' <#> '[3,4]'", -11.0), ("'[0,0]' <=> '[1,1]'", 1.0), ("1 > ALL (SELECT 0)", True), ("1 > ALL (SELECT 1 WHERE false)", True), ("1 = ANY (SELECT 2)", False),
    ],
)
def test_scalars(e, text, want):
    got = one(e, f"SELECT {text}")
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("text", ["SELECT 1/0", "SELECT 'x'::int", "SELECT '[1,2]' <-> '[1]'"])
def test_run_time_errors(e, text):
    with pytest.raises(Exception):
        e.execute(text).rows()


def test_dialect_errors(e):
    for text in ("SELECT FROM WHERE", "SELECT 1 +", "SELECT * FROM (SELECT 1)", "SELECT 'a", "SELECT '[1,x]' <-> '[1]'"):
        with pytest.raises((DialectError, EngineError)):
            e.execute(text)
    with pytest.raises(EngineError, match="does not exist"):
        e.execute("SELECT * FROM nope")
    with pytest.raises(EngineError, match="unsupported"):
        e.execute("VACUUM x")


def test_constraints_and_atomicity(e):
    e.execute("CREATE TABLE pk (id int PRIMARY KEY, name text, email text UNIQUE)")
    assert e.execute("INSERT INTO pk VALUES (1, 'a', NULL), (2, 'b', NULL)").tag == "INSERT 0 2"
    with pytest.raises(EngineError, match='unique constraint "pk_pkey"'):
        e.execute("INSERT INTO pk VALUES (3, 'c', 'x'), (1, 'd', 'y')")
    with pytest.raises(EngineError, match="not-null"):
        e.execute("INSERT INTO pk (name) VALUES ('z')")
    with pytest.raises(EngineError, match='"pk_pkey"'):
        e.execute("UPDATE pk SET id = 5")
    assert sorted(e.execute("SELECT id FROM pk").rows()) == [(1,), (2,)]
    e.execute("UPDATE pk SET email = 'x' WHERE id = 1")
    with pytest.raises(EngineError, match='"pk_email_key"'):
        e.execute("UPDATE pk SET email = 'x' WHERE id = 2")
    e.execute("CREATE TABLE cpk (a int, b int, c text, PRIMARY KEY (a, b))")
    e.execute("INSERT INTO cpk VALUES (1, 1, 'x'), (1, 2, 'y')")
    with pytest.raises(EngineError, match="unique constraint"):
        e.execute("INSERT INTO cpk VALUES (1, 1, 'z')")
    e.execute("CREATE TABLE IF NOT EXISTS cpk (a int)")
    e.execute("DROP TABLE IF EXISTS nothing")
    e.execute("DROP TABLE cpk")
    with pytest.raises(EngineError, match="does not exist"):
        e.execute("SELECT * FROM cpk")


def test_serial_defaults_returning(e):
    e.execute("CREATE TABLE s (id serial PRIMARY KEY, name text DEFAULT 'anon', n int)")
    assert sorted(e.execute("INSERT INTO s (name, n) VALUES ('a', 1), (DEFAULT, 1 + 1) RETURNING id, upper(name)").rows()) == [(1, "A"), (2, "ANON")]
    assert sorted(e.execute("SELECT * FROM s").rows()) == [(1, "a", 1), (2, "anon", 2)]
    assert e.execute("UPDATE s SET n = n * 10 WHERE id = 2 RETURNING *").rows() == [(2, "anon", 20)]
    assert e.execute("DELETE FROM s WHERE n > 5 RETURNING id, n + 1").rows() == [(2, 21)]
    assert e.execute("DELETE FROM s").tag == "DELETE 1"


def test_sequences(e):
    e.execute("CREATE SEQUENCE q START WITH 100 INCREMENT BY 10")
    assert [one(e, "SELECT nextval('q')") for _ in range(2)] == [100, 110]
    assert one(e, "SELECT currval('q')") == 110 and one(e, "SELECT setval('q', 50)") == 50 and one(e, "SELECT nextval('q')") == 60
    q = Sequence()
    assert q.nextval(3) == 1 and q.nextval() == 4


def test_correlated_and_null_keys(e):
    e.execute("CREATE TABLE u (id int, name text)")
    e.execute("INSERT INTO u VALUES (1,'alice'),(2,'bob'),(NULL,'none')")
    e.execute("CREATE TABLE o (user_id int, score int)")
    e.execute("INSERT INTO o VALUES (1,100),(1,200),(2,50),(NULL,7)")
    assert sorted(e.execute("SELECT name, (SELECT sum(score) FROM o WHERE user_id = id) FROM u").rows(), key=str) == [("alice", 300), ("bob", 50), ("none", None)]
    assert sorted(e.execute("SELECT name, score FROM u JOIN o ON id = user_id").rows()) == [("alice", 100), ("alice", 200), ("bob", 50)]
    assert e.execute("SELECT name FROM u WHERE id NOT IN (SELECT user_id FROM o)").rows() == []
    with pytest.raises(Exception):
        e.execute("SELECT (SELECT score FROM o)").rows()
    with pytest.raises(Exception, match="(?i)group"):
        e.execute("SELECT id, count(*) FROM u").rows()
    with pytest.raises(Exception, match="(?i)ambiguous"):
        e.execute("SELECT id FROM u a JOIN u b ON a.id = b.id").rows()


def test_order_and_names(e):
    df = e.sql("SELECT x, x + 1, count(*) FROM (VALUES (1), (NULL), (2)) AS v(x) GROUP BY x ORDER BY x DESC")
    assert df.columns == ["x", "?column?", "count"] and [r[0] for r in df.collect()] == [None, 2, 1]
    assert [r[0] for r in e.sql("SELECT x FROM (VALUES (1), (NULL), (2)) AS v(x) ORDER BY x").collect()] == [1, 2, None]
    assert e.execute("SELECT $1 + $2, $3", [1, 2, "it's"]).rows() == [(3, "it's")]
    assert Engine.kinds("SELECT 1; INSERT INTO t VALUES (1); begin") == ["SELECT", "INSERT", "BEGIN"]
    assert e.execute("SET x = 1").tag == "SET" and e.execute("BEGIN").tag == "OK"


def test_vector_tables(e):
    e.execute("CREATE TABLE items (id int, embedding vector(3))")
    e.execute("INSERT INTO items VALUES (1,'[1,0,0]'),(2,'[0,1,0]'),(3,'[1,1,0]'),(4,NULL)")
    assert [r[0] for r in e.execute("SELECT id FROM items ORDER BY embedding <-> '[1,0,0]' LIMIT 2").rows()] == [1, 3]
    assert e.execute("SELECT id FROM items WHERE embedding <#> '[0,2,0]' < -1 ORDER BY id").rows() == [(2,), (3,)]


def test_engines_do_not_see_each_other(spark, e):
    other = Engine(spark)
    for x, v in ((e, 1), (other, 2)):
        x.execute("CREATE TABLE same (v int)")
        x.execute(f"INSERT INTO same VALUES ({v})")
    assert one(e, "SELECT v FROM same") == 1 and one(other, "SELECT v FROM same") == 2
    e.execute("DROP TABLE same")
    assert one(other, "SELECT v FROM same") == 2


def test_distinct_on_keeps_the_order(e):
    v = "(VALUES (1, 2), (1, 5), (3, 1), (2, 9), (3, 4)) AS v(k, x)"
    assert e.execute(f"SELECT DISTINCT ON (k) k, x FROM {v} ORDER BY k DESC, x LIMIT 1").rows() == [(3, 1)]
    assert e.execute(f"SELECT DISTINCT ON (k) k, x FROM {v} ORDER BY 1 DESC, x DESC").rows() == [(3, 4), (2, 9), (1, 5)]
    assert e.execute(f"SELECT DISTINCT ON (k) x AS y FROM {v} ORDER BY k, x OFFSET 1").rows() == [(9,), (1,)]
    assert sorted(e.execute(f"SELECT DISTINCT ON (k) k FROM {v} UNION ALL SELECT 7").rows()) == [(1,), (2,), (3,), (7,)]


def test_failed_ddl_changes_nothing(e):
    e.execute("CREATE TABLE a (k int)")
    e.execute("INSERT INTO a VALUES (1), (2)")
    e.execute("CREATE TABLE b (k int)")
    with pytest.raises(EngineError, match="already exists"):
        e.execute("ALTER TABLE a RENAME TO b")
    e.execute("ALTER TABLE a ADD COLUMN x int")
    with pytest.raises(EngineError, match="already exists"):
        e.execute("ALTER TABLE a RENAME COLUMN x TO k")
    e.execute("ALTER TABLE a DROP COLUMN x")
    for text in ("DROP TABLE a, missing", "TRUNCATE a, missing"):
        with pytest.raises(EngineError, match="does not exist"):
            e.execute(text)
    assert one(e, "SELECT count(*) FROM a") == 2
    with pytest.raises(EngineError, match="unique"):
        e.execute("ALTER TABLE a ADD COLUMN u int DEFAULT 3 UNIQUE")
    e.execute("INSERT INTO a VALUES (3)")
    e.execute("ALTER TABLE a ADD COLUMN u int UNIQUE")
    e.execute("INSERT INTO a VALUES (4, 5)")
    with pytest.raises(EngineError, match="unique"):
        e.execute("INSERT INTO a VALUES (5, 5)")
    e.execute("DROP TABLE IF EXISTS a, missing")
    with pytest.raises(EngineError):
        e.execute("SELECT * FROM a")


def test_serial_columns(e):
    e.execute("CREATE TABLE t (k int)")
    e.execute("INSERT INTO t VALUES (7), (8)")
    e.execute("ALTER TABLE t ADD COLUMN id serial")
    e.execute("INSERT INTO t (k) VALUES (9)")
    assert sorted(r[0] for r in e.execute("SELECT id FROM t").rows()) == [1, 2, 3] and e.execute("SELECT k FROM t WHERE id = 3").rows() == [(9,)]
    assert sorted(e.execute("UPDATE t SET id = DEFAULT WHERE k > 7 RETURNING k, id > 3").rows()) == [(8, True), (9, True)]
    assert one(e, "SELECT count(DISTINCT id) FROM t") == 3


def test_upsert(e):
    e.execute("CREATE TABLE t (k int PRIMARY KEY, a text, n int DEFAULT 1)")
    e.execute("INSERT INTO t (k, a) VALUES (1, 'x'), (2, 'y')")
    up = "ON CONFLICT (k) DO UPDATE SET a = excluded.a, n = t.n + 1"
    assert sorted(e.execute(f"INSERT INTO t (k, a) VALUES (2, 'z'), (3, 'w') {up} RETURNING k, n").rows()) == [(2, 2), (3, 1)]
    assert e.execute(f"INSERT INTO t (k, a) VALUES (1, 'q') {up} WHERE t.a <> 'x'").tag == "INSERT 0 0"
    assert e.execute("INSERT INTO t (k, a) VALUES (3, 'no'), (4, 'p'), (4, 'r') ON CONFLICT DO NOTHING").tag == "INSERT 0 1"
    assert sorted(e.execute("SELECT * FROM t").rows()) == [(1, "x", 1), (2, "z", 2), (3, "w", 1), (4, "p", 1)]
    with pytest.raises(EngineError, match="unique"):
        e.execute(f"INSERT INTO t (k) VALUES (9), (9) {up}")
    with pytest.raises(EngineError, match="matching"):
        e.execute("INSERT INTO t (k) VALUES (9) ON CONFLICT (a) DO NOTHING")
    assert one(e, "SELECT count(*) FROM t") == 4


def test_merge(e):
    e.execute("CREATE TABLE t (k int PRIMARY KEY, v int)")
    e.execute("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    e.execute("CREATE TABLE s (k int, v int)")
    e.execute("INSERT INTO s VALUES (2, 5), (3, 0), (4, 40), (5, 0)")
    text = "MERGE INTO t USING s ON t.k = s.k WHEN MATCHED AND s.v = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET v = t.v + s.v WHEN NOT MATCHED AND s.v > 0 THEN INSERT VALUES (s.k, s.v)"
    assert e.execute(text).tag == "MERGE 3"
    assert sorted(e.execute("SELECT * FROM t").rows()) == [(1, 10), (2, 25), (4, 40)]
    e.execute("INSERT INTO s VALUES (2, 6)")
    with pytest.raises(EngineError, match="second time"):
        e.execute("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v")
    assert sorted(e.execute("SELECT * FROM t").rows()) == [(1, 10), (2, 25), (4, 40)]


def test_views_copy_and_settings(e, tmp_path):
    e.execute("CREATE TABLE t (k int, a text)")
    e.execute("CREATE VIEW v AS SELECT k * 2 AS d FROM t WHERE a <> 'no'")
    e.execute("INSERT INTO t VALUES (1, 'yes'), (2, 'no'), (3, 'a,b')")
    assert sorted(e.execute("SELECT d FROM v").rows()) == [(2,), (6,)]
    with pytest.raises(EngineError, match="is a view"):
        e.execute("INSERT INTO v VALUES (1)")
    e.execute("CREATE OR REPLACE VIEW v AS SELECT max(k) AS d FROM t")
    assert one(e, "SELECT d FROM v") == 3
    e.execute("DROP VIEW v")
    assert e.execute(f"COPY t TO '{tmp_path}/t' WITH (FORMAT csv, HEADER)").tag == "COPY 3"
    assert e.execute(f"COPY t FROM '{tmp_path}/t' WITH (FORMAT csv, HEADER true)").tag == "COPY 3"
    assert e.execute(f"COPY (SELECT k FROM t) TO '{tmp_path}/p' WITH (FORMAT parquet)").tag == "COPY 6" and one(e, "SELECT count(*) FROM t WHERE a = 'a,b'") == 2
    e.execute("SET search_path TO 'x'")
    assert one(e, "SHOW search_path") == "x"
    assert "UnresolvedRelation" in e.tree("SELECT k FROM t")
    e.function("twice", lambda x: None if x is None else 2 * x, "int")
    assert one(e, "SELECT sum(twice(k)) FROM t") == 24


def test_vector_index(e):
    e.execute("CREATE TABLE p (id int, pos vector(2))")
    e.execute("INSERT INTO p VALUES " + ", ".join(f"({i}, '[{i % 10},{i // 10}]')" for i in range(100)))
    e.execute("CREATE INDEX near ON p USING hnsw (pos vector_l2_ops)")
    e.execute("CREATE INDEX plain ON p (id)")
    with pytest.raises(EngineError, match="already exists"):
        e.execute("CREATE INDEX near ON p (id)")
    index = e.catalog.get("public", "p").indexes["near"][1]
    assert sorted(r.id for r in e.nearest("near", [4.1, 4.1], 1, probes=len(index.centres)).collect()) == [44]
    assert len(e.nearest("near", [4.1, 4.1], 5).collect()) == 5
    e.execute("INSERT INTO p VALUES (500, '[4.1,4.1]')")
    assert e.nearest("near", [4.1, 4.1], 1).first().id == 500  # built again for the new version
    e.execute("CREATE UNIQUE INDEX u ON p (pos)")
    with pytest.raises(EngineError, match="unique"):
        e.execute("INSERT INTO p VALUES (501, '[4.1,4.1]')")
    e.execute("DROP INDEX near")
    with pytest.raises(EngineError, match="does not exist"):
        e.nearest("near", [0.0, 0.0], 1)


def test_inserts_append(spark, e):
    """An insert writes its own rows only, and many inserts stay one flat plan."""
    e.execute("CREATE TABLE t (k int)")
    for i in range(35):
        e.execute(f"INSERT INTO t VALUES ({i})")
    table = e.catalog.get("public", "t")
    assert sorted(r[0] for r in e.execute("SELECT k FROM t").rows()) == list(range(35)) and len(table.added) < 35
    assert table.df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2


def test_command_line(capsys, spark):
    from basalt.__main__ import main

    assert main(["-c", "SELECT 1 + 1 AS two; SELECT 'x' AS y", "--timing"]) == 0
    out = capsys.readouterr().out
    assert "two" in out and "2" in out and "x" in out and "Time:" in out
    assert main(["-c", "SELECT nope"]) == 1
