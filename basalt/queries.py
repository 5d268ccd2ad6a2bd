"""Registered queries of the relational engine, each with the SQL that DuckDB runs for it.

Most are written in the engine's own dialect: the text goes through the translator and Catalyst.  Others use
the DataFrame operators directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import pg, vector
from .operators import catalog, relational
from .plans.engine import Engine
from .streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, text: str | None = None) -> Engine:
    """An engine over the tables that a text mentions (all, without one); only their schemas are read here."""
    out = Engine(spark)
    for name in TABLES:
        if text is None or name in text:
            out.register(name, t(spark, sf_dir, name))
    return out


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query of the dialect; the oracle's text is the same unless given."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text)
    SQL[name] = oracle or text


@query("""SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity > 10 GROUP BY c_mktsegment HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 10""")
def flagship(spark, sf):
    lines = t(spark, sf, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"), revenue.alias("revenue")).filter("n_lines > 10").orderBy(F.desc("revenue")).limit(10)


# Scans, projections, predicates

dialect("scan_project", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
dialect("scan_star", "SELECT * FROM nation")
dialect("scan_qualified_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
dialect("filter_and_or", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
dialect("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
dialect("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
dialect("filter_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3, NULL)")
dialect("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
dialect("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS' AND p_name NOT LIKE 'a_%'")
dialect("filter_ilike", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand#1%'")
dialect("filter_is_null", "SELECT n_nationkey, NULLIF(n_regionkey, 2) IS NULL AS is_two, NULLIF(n_regionkey, 1) IS NOT NULL AS not_one FROM nation WHERE NULLIF(n_regionkey, 0) IS NOT NULL")
dialect("filter_is_distinct", "SELECT n_nationkey, NULLIF(n_regionkey, 2) IS DISTINCT FROM 1 AS a, NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM NULL AS b FROM nation")
dialect("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders")
dialect("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
dialect("coalesce_nullif", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 3), -1) AS v FROM nation")
dialect("arith_intdiv_mod", "SELECT o_orderkey, o_custkey / 7 AS q, o_custkey % 7 AS r, mod(o_orderkey, 5) AS m, -o_custkey / 2 AS neg FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r, mod(o_orderkey, 5) AS m, -CAST(trunc(o_custkey / 2) AS BIGINT) AS neg FROM orders")
dialect("arith_float", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
dialect("cast_types", "SELECT p_partkey, p_retailprice::int AS whole, p_size::float8 AS f, (p_partkey)::text || '!' AS s, CAST('42' AS INT) + p_size AS n, (p_size > 20)::text AS b, 'yes'::bool AS y, 'on'::bool AS o FROM part", "SELECT p_partkey, CAST(floor(p_retailprice + 0.5) AS INT) AS whole, p_size::DOUBLE AS f, p_partkey::VARCHAR || '!' AS s, CAST('42' AS INT) + p_size AS n, (p_size > 20)::VARCHAR AS b, true AS y, true AS o FROM part")
dialect("one_row", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, NULL AS n, TRUE AND NULL AS u, 5 BETWEEN 1 AND 9 AS b")
dialect("values_source", "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v(a, b) WHERE v.a > 1")

# Functions

dialect("string_concat", "SELECT c_custkey, concat(c_name, NULLIF(c_mktsegment, 'BUILDING'), '-', c_nationkey) AS a, c_name || '/' || c_mktsegment AS b FROM customer")
dialect("string_upper_lower_length", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n FROM part")
dialect("string_substring_trim", "SELECT p_partkey, substring(p_name FROM 2 FOR 3) AS a, substr(p_type, 4) AS b, trim(LEADING 'B' FROM p_brand) AS c, rtrim(p_type, 'SREL') AS d, btrim('  x ') AS e, trim(BOTH FROM ' y ') AS f FROM part", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substr(p_type, 4) AS b, ltrim(p_brand, 'B') AS c, rtrim(p_type, 'SREL') AS d, 'x' AS e, 'y' AS f FROM part")
dialect("string_replace_position", "SELECT p_partkey, replace(p_type, 'S', 'zz') AS a, position('A' IN p_type) AS b, strpos(p_name, 'e') AS c, left(p_name, 3) AS d, right(p_name, 2) AS e, left(p_brand, -2) AS f, right(p_brand, -2) AS g FROM part")
dialect("math_ceil_floor_round", "SELECT p_partkey, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice) AS r FROM part", "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice) AS r FROM part")
dialect("math_power_sqrt_abs", "SELECT c_custkey, abs(c_acctbal) AS a, power(c_nationkey, 2) AS p, sqrt(c_nationkey) AS s FROM customer")
dialect("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS l FROM lineitem")

# Joins

dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
dialect("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
dialect("join_full", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) n FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) s ON n_nationkey = s_nationkey")
dialect("join_cross", "SELECT r1.r_name AS a, n_name AS b FROM region r1 CROSS JOIN nation")
dialect("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
dialect("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("join_non_equi", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON b.n_nationkey > a.r_regionkey * 5")
dialect("join_self", "SELECT a.s_suppkey AS a, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey GROUP BY a.s_suppkey")
dialect("join_threeway", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
dialect("join_using", "SELECT n_nationkey, x.k FROM nation JOIN (SELECT n_nationkey, n_regionkey * 2 AS k FROM nation WHERE n_regionkey > 1) x USING (n_nationkey)")
dialect("join_null_keys", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT NULLIF(r_regionkey, 2) AS r_regionkey FROM region) b ON a.k = b.r_regionkey")

# Subqueries

dialect("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
dialect("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
dialect("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("not_in_null_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM nation WHERE n_regionkey = 1)")
dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
dialect("correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
dialect("correlated_aggregate", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)")
dialect("all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier)")
dialect("all_empty_subquery", "SELECT r_regionkey FROM region WHERE r_regionkey > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)")
dialect("any_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region)")
dialect("eq_any_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT r_regionkey FROM region)")
dialect("derived_table", "SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n > 12")
dialect("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n.n FROM customer JOIN n ON c_custkey = n.o_custkey")

# Aggregates

dialect("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, CAST(round(avg(CAST(l_discount AS DECIMAL(18,4))), 6) AS DOUBLE) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem")
dialect("agg_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 0) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100 AND sum(l_quantity) > 10")
dialect("agg_group_expression", "SELECT p_size / 10 AS decade, count(*) AS n, max(p_retailprice) - min(p_retailprice) AS spread FROM part GROUP BY p_size / 10", "SELECT p_size // 10 AS decade, count(*) AS n, max(p_retailprice) - min(p_retailprice) AS spread FROM part GROUP BY p_size // 10")
dialect("agg_group_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
dialect("agg_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, count(o_orderkey) AS m FROM orders GROUP BY o_orderpriority")
dialect("agg_sum_distinct", "SELECT p_brand, sum(DISTINCT p_size) AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand")
dialect("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
dialect("agg_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o FROM orders GROUP BY o_orderpriority")
dialect("agg_empty_input", "SELECT count(*) AS n, sum(o_custkey) AS s, avg(o_custkey) AS a, min(o_custkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, avg(o_custkey) AS a, min(o_custkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("agg_filter_clause", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS pos, count(*) AS n FROM customer GROUP BY c_mktsegment")
dialect("agg_null_group", "SELECT NULLIF(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)")
dialect("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")

# Distinct, set operations, order and limit

dialect("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect("distinct_null", "SELECT DISTINCT NULLIF(n_regionkey, 2) AS k FROM nation")
dialect("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
dialect("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
dialect("union_distinct", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
dialect("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey < 40")
dialect("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 30")
dialect("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
dialect("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
dialect("set_order_limit", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 7 OFFSET 2")
dialect("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
dialect("order_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey LIMIT 8", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC NULLS FIRST, n_nationkey LIMIT 8")
dialect("order_nulls_first", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY 2 NULLS FIRST, 1 LIMIT 8")
dialect("order_alias_expression", "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 9")
dialect("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
dialect("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")

# Vectors

POINT = [round(0.01 * (i - 32), 2) for i in range(64)]
_literal = "'[" + ",".join(map(str, POINT)) + "]'"
_float = f"CAST([{','.join(map(str, POINT))}] AS FLOAT[64])"


def _vectors(name: str, op: str, f: str) -> None:
    dialect(f"vector_{name}", f"SELECT vec_id, floor((embedding {op} {_literal}) * 1000 + 0.5) AS d FROM embeddings", f"SELECT vec_id, CAST(floor({f} * 1000 + 0.5) AS BIGINT) AS d FROM embeddings".replace("{}", ""))
    dialect(f"vector_knn_{name}", f"SELECT vec_id FROM embeddings ORDER BY embedding {op} {_literal}, vec_id LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {f}, vec_id LIMIT 10")


_b = f"[{','.join(map(str, POINT))}]"
_terms = lambda e: f"list_sum(list_transform(range(1, 65), lambda i: {e}))"
_x, _y = "CAST(embedding[CAST(i AS BIGINT)] AS DOUBLE)", f"CAST(CAST({_b}[CAST(i AS BIGINT)] AS FLOAT) AS DOUBLE)"
_vectors("l2", "<->", f"sqrt({_terms(f'({_x} - {_y}) * ({_x} - {_y})')})")
_vectors("cosine", "<=>", f"(1 - {_terms(f'{_x} * {_y}')} / (sqrt({_terms(f'{_x} * {_x}')}) * sqrt({_terms(f'{_y} * {_y}')})))")
_vectors("ip", "<#>", f"(-{_terms(f'{_x} * {_y}')})")


@query(f"SELECT vec_id, label FROM embeddings WHERE label <> 3 ORDER BY sqrt({_terms(f'({_x} - {_y}) * ({_x} - {_y})')}), vec_id LIMIT 15")
def vector_knn_filtered(spark, sf):
    return vector.knn(t(spark, sf, "embeddings").filter("label <> 3"), "embedding", POINT, 15, tie="vec_id").select("vec_id", "label")


@query()
def vector_ann_ivf(spark, sf):
    """Approximate neighbours through an inverted file of k-means cells (tests measure the recall)."""
    return relational.ivf_knn(t(spark, sf, "embeddings"), "vec_id", "embedding", POINT, 10)


# Tables: DDL and DML

@query("SELECT n_nationkey, n_name, 7 AS grade FROM nation WHERE n_regionkey = 1")
def insert_select(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target (n_nationkey int PRIMARY KEY, n_name text NOT NULL, grade int DEFAULT 7)")
    e.execute("INSERT INTO target (n_nationkey, n_name) SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    return e.sql("SELECT * FROM target")


@query("SELECT * FROM (VALUES (1, 'a', 0), (2, 'b', 5)) AS v(id, name, n)")
def insert_values_defaults(spark, sf):
    e = Engine(spark)
    e.execute("CREATE TABLE target (id serial PRIMARY KEY, name text, n int DEFAULT 0)")
    e.execute("INSERT INTO target (name, n) VALUES ('a', DEFAULT), ('b', 2 + 3)")
    return e.sql("SELECT * FROM target")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_expr(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT c_custkey, c_acctbal FROM customer")
    e.execute("UPDATE target SET c_acctbal = 0.0 WHERE c_acctbal < 0")
    return e.sql("SELECT * FROM target")


@query("SELECT n_nationkey, n_regionkey + 10 * (n_regionkey + 1) AS n_regionkey FROM nation")
def update_from(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT n_nationkey, n_regionkey FROM nation")
    e.execute("UPDATE target SET n_regionkey = target.n_regionkey + 10 * (r.r_regionkey + 1) FROM region r WHERE r.r_regionkey = target.n_regionkey")
    return e.sql("SELECT * FROM target")


@query("SELECT s_suppkey FROM supplier WHERE NOT coalesce(NULLIF(s_nationkey, 3) > 10, false)")
def delete_where(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT s_suppkey, NULLIF(s_nationkey, 3) AS k FROM supplier")
    e.execute("DELETE FROM target WHERE k > 10")
    return e.sql("SELECT s_suppkey FROM target")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def delete_using(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT s_suppkey, s_nationkey FROM supplier")
    e.execute("DELETE FROM target USING nation n WHERE n.n_nationkey = target.s_nationkey AND n.n_regionkey = 2")
    return e.sql("SELECT s_suppkey FROM target")


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation WHERE n_regionkey = 3")
def returning(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT * FROM nation")
    return e.sql("DELETE FROM target WHERE n_regionkey = 3 RETURNING n_nationkey, upper(n_name) AS name")


@query("SELECT r_regionkey, r_name AS title, 5 AS extra FROM region")
def alter_table(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT r_regionkey, r_name, 1 AS junk FROM region")
    for text in ("ADD COLUMN extra int DEFAULT 5", "DROP COLUMN junk", "RENAME COLUMN r_name TO title", "RENAME TO renamed"):
        e.execute(f"ALTER TABLE target {text}")
    return e.sql("SELECT * FROM renamed")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation")
def serial_rows(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target (id serial, n_nationkey int)")
    e.execute("INSERT INTO target (n_nationkey) SELECT n_nationkey FROM nation ORDER BY n_nationkey")
    return e.sql("SELECT n_nationkey, id::bigint AS id FROM target")


@query("SELECT 0 AS n")
def truncate_table(spark, sf):
    e = engine(spark, sf)
    e.execute("CREATE TABLE target AS SELECT * FROM nation")
    e.execute("TRUNCATE target")
    return e.sql("SELECT count(*)::int AS n FROM target")


def _table(name: str, oracle: str, create: str, *statements: str, result: str = "SELECT * FROM target") -> None:
    """A query that makes a table, changes it and reads it."""

    @query(oracle)
    def run(spark, sf):
        e = engine(spark, sf)
        for text in (create, *statements):
            e.execute(text)
        return e.sql(result)

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_table(
    "upsert_update", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS n FROM nation UNION ALL SELECT 100, 'new', 1",
    "CREATE TABLE target (k int PRIMARY KEY, name text, n int DEFAULT 1)", "INSERT INTO target (k, name) SELECT n_nationkey, n_name FROM nation",
    "INSERT INTO target (k, name) SELECT n_nationkey, n_name || '!' FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 100, 'new' ON CONFLICT (k) DO UPDATE SET name = excluded.name, n = target.n + 1 WHERE target.k IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
_table(
    "upsert_nothing", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 50, 'x'",
    "CREATE TABLE target (k int UNIQUE, name text)", "INSERT INTO target SELECT r_regionkey, r_name FROM region",
    "INSERT INTO target VALUES (0, 'again'), (50, 'x'), (50, 'y') ON CONFLICT DO NOTHING",
)
_table(
    "merge_into", "SELECT s_suppkey AS k, CASE WHEN s_nationkey < 5 THEN s_acctbal + 1 ELSE s_acctbal END AS bal FROM supplier WHERE s_nationkey < 5 OR s_nationkey >= 10 AND s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 0.0 FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey >= 10",
    "CREATE TABLE target AS SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier WHERE s_nationkey < 10 OR s_suppkey % 2 = 0",
    "MERGE INTO target AS t USING supplier AS s ON t.k = s.s_suppkey WHEN MATCHED AND s.s_nationkey < 5 THEN UPDATE SET bal = t.bal + 1 WHEN MATCHED AND s.s_nationkey < 10 THEN DELETE WHEN NOT MATCHED THEN INSERT (k, bal) VALUES (s.s_suppkey, 0.0)",
)
_table(
    "view_over_changes", "SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT 9) GROUP BY n_regionkey",
    "CREATE TABLE target AS SELECT n_nationkey, n_regionkey FROM nation", "CREATE VIEW regions AS SELECT n_regionkey, count(*) AS n FROM target GROUP BY n_regionkey", "INSERT INTO target VALUES (99, 9)", result="SELECT * FROM regions",
)
_table("rename_table", "SELECT r_regionkey FROM region", "CREATE TABLE first AS SELECT r_regionkey FROM region", "ALTER TABLE first RENAME TO target")
_table("drop_and_create", "SELECT 1 AS a", "CREATE TABLE target AS SELECT * FROM nation", "DROP TABLE IF EXISTS target, missing", "CREATE TABLE target (a int)", "INSERT INTO target VALUES (1)")
_table("add_serial_column", "SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS id FROM region UNION ALL SELECT 9, 6", "CREATE TABLE target AS SELECT r_regionkey FROM region ORDER BY r_regionkey", "ALTER TABLE target ADD COLUMN id serial", "INSERT INTO target (r_regionkey) VALUES (9)", result="SELECT r_regionkey, id::bigint AS id FROM target")
_table("update_default_serial", "SELECT count(DISTINCT n_nationkey) AS n FROM nation", "CREATE TABLE target (id serial, k int)", "INSERT INTO target (k) SELECT n_nationkey FROM nation", "UPDATE target SET id = DEFAULT", result="SELECT count(DISTINCT id) AS n FROM target WHERE id > 25")
_table("sequence_draws", "SELECT 100 AS a, 110 AS b, 120 AS c", "CREATE SEQUENCE q START WITH 100 INCREMENT BY 10", result="SELECT nextval('q')::int AS a, nextval('q')::int AS b, nextval('q')::int AS c")
_table("insert_many_times", "SELECT k FROM (VALUES (1), (2), (3), (4)) AS v(k)", "CREATE TABLE target (k int PRIMARY KEY)", *(f"INSERT INTO target VALUES ({i})" for i in (1, 2, 3, 4)))

dialect("distinct_on_limit", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 7")
dialect("join_natural", "SELECT c_custkey, k FROM customer NATURAL JOIN (SELECT o_custkey AS c_custkey, o_orderkey AS k FROM orders) AS o")
dialect("join_lateral", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS x")
dialect("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
dialect("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
dialect("with_recursive", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 20) SELECT n FROM s")
dialect("window_rank_lag", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two FROM orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two FROM orders")
dialect("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
dialect("vector_equality", f"SELECT vec_id FROM embeddings WHERE embedding = embedding AND embedding <> {_literal}::vector", "SELECT vec_id FROM embeddings")


# Streams (a Spark extension over events)

@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return windows.tumbling(spark, f"{sf}/events.parquet", t(spark, sf, "events").schema)
