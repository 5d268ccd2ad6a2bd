"""SQL statements over the catalog: dispatch, DDL, DML with RETURNING, queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, ParseException

from ..operators.catalog import Catalog, ColumnInfo, EngineError, Sequence, Table, check_not_null, check_unique, completed, drawn, insert, numbered, replace
from ..operators.relational import AnnIndex
from ..sources import snapshots
from ..sources.snapshots import snapshot
from .dialect import TYPES, DialectError, Translator, tokenize


@dataclass
class Result:
    tag: str
    df: DataFrame | None = None

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []


class _Statement(Translator):
    """A translator that may draw from sequences (VALUES and SELECT lists without a table)."""

    def __init__(self, engine, tokens, params):
        super().__init__(tokens, engine.schema_of, engine.relation, params)
        self.engine = engine

    def sequence(self, f, a):
        name = a[0].strip("'").lower()
        seq = self.engine.catalog.sequence(name)
        if any(scope for scope in self.scopes):
            raise DialectError(f"{f} is allowed in VALUES and in SELECT without FROM only")
        return str(seq.nextval() if f == "nextval" else seq.currval() if f == "currval" else seq.setval(int(a[1])))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.settings = spark, Catalog(spark), {}
        spark.conf.set("spark.sql.ansi.enabled", "true")

    def register(self, name: str, df: DataFrame, schema: str = "public") -> None:
        """Make a DataFrame queryable (and, through snapshots, changeable) as a table."""
        self.catalog.add(Table(schema, name, [ColumnInfo(f.name, f.dataType.simpleString()) for f in df.schema], df=df))

    def schema_of(self, query: str) -> str | None:
        try:
            return self.spark.sql(query).schema[0].dataType.simpleString()
        except (AnalysisException, ParseException):
            return None

    def function(self, name: str, f, type: str) -> None:
        """Make a Python function (of values, or a pandas UDF) callable in SQL."""
        self.spark.udf.register(name, f, *([] if hasattr(f, "returnType") else [type]))

    def relation(self, schema: str, name: str) -> str:
        table = self.catalog.get(schema, name)
        if table.query is not None:  # a view reads the present versions of its tables
            self.spark.sql(self.translate(table.query)).createOrReplaceTempView(table.view)
        return f"`{table.view}`"

    def sql(self, text: str, params=()) -> DataFrame:
        """The DataFrame of a query."""
        out = self.execute(text, params)
        if out.df is None:
            raise EngineError(f"{out.tag} returns no rows")
        return out.df

    def translate(self, text: str, params=()) -> str:
        s = _Statement(self, tokenize(text), params)
        return s.query()

    def tree(self, text: str, params=()) -> str:
        """The syntax tree of a query: the parsed plan, before names are looked up."""
        session = self.spark._jsparkSession
        return session.sessionState().sqlParser().parsePlan(self.translate(text, params)).treeString()

    @staticmethod
    def kinds(text: str) -> list[str]:
        """The kind of every statement of a text: its first word, upper-cased."""
        out, fresh = [], True
        for kind, x in tokenize(text):
            if x == ";":
                fresh = True
            elif fresh:
                out.append(x.upper())
                fresh = False
        return out

    def execute(self, text: str, params=()) -> Result:
        """Carry out the first statement of text."""
        tokens = tokenize(text)
        for n, (_, x) in enumerate(tokens):
            if x == ";":
                tokens = tokens[:n]
                break
        if not tokens:
            return Result("")
        s = _Statement(self, tokens, params)
        head = s.peek()
        if head in ("SELECT", "WITH", "VALUES", "("):
            query = s.query()
            self.ended(s)
            return Result("SELECT", self.spark.sql(query))
        if head == "SET":
            s.take(), s.accept("SESSION") or s.accept("LOCAL")
            name = s.name()
            s.accept("TO") or s.accept("=")
            self.settings[name] = " ".join(x.strip("'") for _, x in tokens[s.i :])
            return Result("SET")
        if head == "SHOW":
            s.take()
            name = s.name()
            return Result("SHOW", self.spark.createDataFrame([(self.settings.get(name, ""),)], f"`{name}` string"))
        if head in ("BEGIN", "START", "COMMIT", "ROLLBACK"):
            return Result("OK")
        if head == "EXPLAIN":
            s.take()
            df = self.spark.sql(s.query())
            return Result("EXPLAIN", self.spark.createDataFrame([(df._jdf.queryExecution().toString(),)], "plan string"))
        act = {"CREATE": self.create, "DROP": self.drop, "ALTER": self.alter, "TRUNCATE": self.truncate, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "MERGE": self.merge, "COPY": self.copy}.get(head)
        if act is None:
            raise EngineError(f"unsupported statement type {head}")
        s.take()
        out = act(s)
        self.ended(s)
        return out

    @staticmethod
    def ended(s: Translator) -> None:
        if s.i < len(s.t):
            raise DialectError(f"syntax error at or near {s.t[s.i][1]!r}")

    # DDL

    def create(self, s: _Statement) -> Result:
        if s.accept("SEQUENCE"):
            schema, name = s.table_name()
            seq = Sequence()
            while s.i < len(s.t):
                word = s.take().upper()
                s.accept("WITH") or s.accept("BY")
                if word == "START":
                    seq.start = int(s.take())
                elif word == "INCREMENT":
                    seq.increment = int(s.take())
            self.catalog.sequences[f"{schema}.{name}"] = seq
            return Result("CREATE SEQUENCE")
        again = s.accept("OR", "REPLACE")
        if s.accept("VIEW"):
            schema, name = s.table_name()
            old = self.catalog.tables.get(f"{schema}.{name}")
            if old is not None and not (again and old.query is not None):
                raise EngineError(f'relation "{name}" already exists')
            s.expect("AS")
            text = " ".join(x for _, x in s.t[s.i :])
            df = self.spark.sql(s.query())
            self.catalog.add(Table(schema, name, [ColumnInfo(f.name, f.dataType.simpleString()) for f in df.schema], df=df, query=text))
            return Result("CREATE VIEW")
        unique = s.accept("UNIQUE")
        if s.accept("INDEX"):
            return self.create_index(s, unique)
        s.expect("TABLE")
        soft = s.accept("IF", "NOT", "EXISTS")
        schema, name = s.table_name()
        if f"{schema}.{name}" in self.catalog.tables:
            if soft:
                s.i = len(s.t)
                return Result("CREATE TABLE")
            raise EngineError(f'relation "{name}" already exists')
        if s.accept("AS"):
            df = snapshot(self.spark.sql(s.query()), name)
            self.catalog.add(Table(schema, name, [ColumnInfo(f.name, f.dataType.simpleString()) for f in df.schema], df=df))
            return Result(f"SELECT {df.count()}")
        table = Table(schema, name, [])
        s.expect("(")
        while True:
            if s.accept("CONSTRAINT"):
                s.name()
            if s.accept("PRIMARY", "KEY"):
                table.primary = self.names(s)
            elif s.accept("UNIQUE"):
                key = self.names(s)
                table.unique[f"{name}_{'_'.join(key)}_key"] = key
            else:
                self.column(s, table)
            if not s.accept(","):
                break
        s.expect(")")
        if table.primary:
            table.unique[f"{name}_pkey"] = table.primary
            for c in table.primary:
                table.column(c).nullable = False
        for c in table.columns:
            if c.sequence:
                self.catalog.sequences[c.sequence] = Sequence()
        self.catalog.add(table)
        return Result("CREATE TABLE")

    @staticmethod
    def names(s: Translator) -> list[str]:
        s.expect("(")
        out = [s.name()]
        while s.accept(","):
            out.append(s.name())
        s.expect(")")
        return out

    def column(self, s: _Statement, table: Table) -> ColumnInfo:
        name = s.name()
        if any(c.name == name for c in table.columns):
            raise EngineError(f'column "{name}" specified more than once')
        word = s.peek().lower()
        c = ColumnInfo(name, TYPES.get(word, "") and s.type_name() or s.type_name())
        if word in ("serial", "bigserial"):
            c.sequence, c.nullable = f"{table.schema}.{table.name}_{name}_seq", False
        table.columns.append(c)
        while True:
            if s.accept("PRIMARY", "KEY"):
                table.primary = [name]
            elif s.accept("UNIQUE"):
                table.unique[f"{table.name}_{name}_key"] = [name]
            elif s.accept("NOT", "NULL"):
                c.nullable = False
            elif s.accept("NULL"):
                pass
            elif s.accept("DEFAULT"):
                if s.peek() == "NEXTVAL":
                    s.take(), s.expect("(")
                    seq = s.take()[1:-1].lower()
                    s.expect(")")
                    self.catalog.sequence(seq)
                    c.sequence = seq if "." in seq else f"public.{seq}"
                else:
                    c.default = s.expression(5)
            else:
                return c

    def create_index(self, s: _Statement, unique: bool) -> Result:
        """UNIQUE is a constraint; USING hnsw or ivf builds a stored index of a vector column; others need nothing here."""
        soft = s.accept("IF", "NOT", "EXISTS")
        name = s.name() if s.peek() != "ON" else ""
        s.expect("ON")
        table = self.catalog.changeable(*s.table_name())
        kind = s.name().lower() if s.accept("USING") else "btree"
        s.expect("(")
        key = [table.column(s.name()).name]
        if s.kind() == "word" and s.peek() not in (",", ")"):
            s.take()  # an operator class
        while s.accept(","):
            key.append(table.column(s.name()).name)
        s.expect(")")
        name = name or f"{table.name}_{'_'.join(key)}_idx"
        if any(name in t.indexes or name in t.unique for t in self.catalog.tables.values()):
            if soft:
                return Result("CREATE INDEX")
            raise EngineError(f'relation "{name}" already exists')
        if unique:
            probe = Table(table.schema, table.name, table.columns, unique={name: key})
            check_unique(probe, table.df, None)
            table.unique[name] = key
        table.indexes[name] = (key[0], AnnIndex.build(table.df, key[0]), table.version) if kind in ("hnsw", "ivf", "ivfflat") else None
        return Result("CREATE INDEX")

    def nearest(self, index: str, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """The rows of about the k nearest vectors by an index, with a column distance; an index of a former version is built again."""
        for table in self.catalog.tables.values():
            if table.indexes.get(index):
                column, built, version = table.indexes[index]
                if version != table.version:
                    built = AnnIndex.build(table.df, column)
                    table.indexes[index] = column, built, table.version
                return built.search(query, k, probes)
        raise EngineError(f'index "{index}" does not exist or is not one of vectors')

    def drop(self, s: _Statement) -> Result:
        """All names are looked up before anything is dropped."""
        kind = s.take().upper()
        if kind not in ("TABLE", "VIEW", "INDEX", "SEQUENCE"):
            raise EngineError(f"unsupported DROP {kind}")
        soft = s.accept("IF", "EXISTS")
        found = []
        while True:
            schema, name = s.table_name()
            full = f"{schema}.{name}"
            table = self.catalog.tables.get(full)
            if kind in ("TABLE", "VIEW"):
                here = table is not None and (table.query is None) == (kind == "TABLE")
            elif kind == "INDEX":
                table = next((t for t in self.catalog.tables.values() if name in t.indexes), None)
                here = table is not None
            else:
                here = full in self.catalog.sequences
            if here:
                found.append((table, name, full))
            elif not soft:
                raise EngineError(f'{kind.lower()} "{name}" does not exist')
            if not s.accept(","):
                break
        s.accept("CASCADE") or s.accept("RESTRICT")
        self.ended(s)
        for table, name, full in dict.fromkeys((id(t), n, f) for t, n, f in found):
            table = next((t for t, _, _ in found if id(t) == table), None)
            if kind in ("TABLE", "VIEW"):
                self.catalog.remove(table)
            elif kind == "INDEX":
                del table.indexes[name]
                table.unique.pop(name, None)
            else:
                del self.catalog.sequences[full]
        return Result(f"DROP {kind}")

    def alter(self, s: _Statement) -> Result:
        s.expect("TABLE")
        table = self.catalog.changeable(*s.table_name())
        if s.accept("ADD"):
            s.accept("COLUMN")
            before = list(table.columns), dict(table.unique), list(table.primary)
            try:
                c = self.column(s, table)
                if table.primary != before[2]:
                    if before[2]:
                        raise EngineError(f'multiple primary keys for table "{table.name}" are not allowed')
                    table.unique[f"{table.name}_pkey"], c.nullable = table.primary, False
                if c.sequence and c.sequence not in self.catalog.sequences:
                    self.catalog.sequences[c.sequence] = Sequence()
                if c.sequence:
                    filled = drawn(self.catalog, table.df, [c])
                else:
                    filled = table.df.withColumn(c.name, (F.expr(c.default) if c.default is not None else F.lit(None)).cast(c.type))
                replace(self.catalog, table, filled)
            except Exception:
                added = [c for c in table.columns if c not in before[0]]
                table.columns[:], table.unique, table.primary = before
                for c in added:
                    if c.sequence == f"{table.schema}.{table.name}_{c.name}_seq":
                        self.catalog.sequences.pop(c.sequence, None)
                raise
        elif s.accept("DROP"):
            s.accept("COLUMN")
            c = table.column(s.name())
            table.columns.remove(c)
            table.unique = {k: v for k, v in table.unique.items() if c.name not in v}
            self.catalog.swap(table, table.df.drop(c.name))
        elif s.accept("RENAME", "TO"):
            name = s.name()
            self.catalog.free(table.schema, name)
            self.spark.catalog.dropTempView(table.view)
            del self.catalog.tables[f"{table.schema}.{table.name}"]
            table.name = name
            self.catalog.add(table)
        elif s.accept("RENAME"):
            s.accept("COLUMN")
            c = table.column(s.name())
            s.expect("TO")
            new = s.name()
            if any(x.name == new for x in table.columns):
                raise EngineError(f'column "{new}" of relation "{table.name}" already exists')
            old, c.name = c.name, new
            table.primary = [new if x == old else x for x in table.primary]
            table.unique = {k: [c.name if x == old else x for x in v] for k, v in table.unique.items()}
            self.catalog.swap(table, table.df.withColumnRenamed(old, c.name))
        else:
            raise EngineError("unsupported ALTER TABLE command")
        return Result("ALTER TABLE")

    def truncate(self, s: _Statement) -> Result:
        s.accept("TABLE")
        tables = []
        while True:
            tables.append(self.catalog.changeable(*s.table_name()))
            if not s.accept(","):
                break
        self.ended(s)
        for table in tables:
            self.catalog.swap(table)
        return Result("TRUNCATE TABLE")

    def copy(self, s: _Statement) -> Result:
        """COPY table [(columns)] FROM 'path', COPY table or (query) TO 'path', WITH (FORMAT f, HEADER, DELIMITER 'c', NULL 's')."""
        table, listed = None, None
        if s.accept("("):
            df = self.spark.sql(s.query())
            s.expect(")")
        else:
            table = self.catalog.get(*s.table_name())
            listed = self.names(s) if s.peek() == "(" else [c.name for c in table.columns]
            df = table.df.select(*listed)
        into = s.accept("FROM")
        into or s.expect("TO")
        path = s.take()[1:-1]
        s.accept("WITH")
        options, form = {"header": "false"}, "csv"
        if s.accept("("):
            while True:
                word = s.take().upper()
                value = s.take().strip("'") if s.peek() not in (",", ")") else "true"
                if word == "FORMAT":
                    form = value.lower()
                else:
                    options[{"HEADER": "header", "DELIMITER": "sep", "NULL": "nullValue", "QUOTE": "quote"}[word]] = value.lower() if word == "HEADER" else value
                if not s.accept(","):
                    break
            s.expect(")")
        options = options if form == "csv" else {}
        if not into:
            n = df.count()
            snapshots.write(df, path, form, "overwrite", **options)
            return Result(f"COPY {n}")
        if table is None or table.query is not None:
            raise EngineError("COPY FROM needs a table")
        schema = ", ".join(f"`{c}` {table.column(c).type}" for c in listed)
        rows = insert(self.catalog, table, snapshots.read(self.spark, path, form, schema, **(options | {"mode": "FAILFAST"} if form in ("csv", "json") else options)))
        return Result(f"COPY {rows.count()}")

    # DML

    def returning(self, s: _Statement, table: Table, rows: DataFrame, tag: str) -> Result:
        """The RETURNING list over the affected rows, which bear the table's name."""
        n = rows.count()
        if not s.accept("RETURNING"):
            return Result(f"{tag} {n}")
        view = f"{table.view}_delta"
        rows.createOrReplaceTempView(view)
        s.scopes.append(f" FROM `{view}` AS `{table.name}`")
        df = self.spark.sql(f"SELECT {', '.join(s.items())}{s.scopes.pop()}")
        return Result(f"{tag} {n}", df)

    def insert(self, s: _Statement) -> Result:
        s.expect("INTO")
        table = self.catalog.changeable(*s.table_name())
        alias = s.name() if s.accept("AS") else table.name
        listed = self.names(s) if s.peek() == "(" and s.peek(1) not in ("SELECT", "WITH") else [c.name for c in table.columns]
        columns = [table.column(c) for c in listed]
        if s.accept("DEFAULT", "VALUES"):
            return self.placed(s, table, alias, self.spark.range(1).drop("id"))
        if not s.accept("VALUES"):
            df = self.spark.sql(s.query())
            if len(df.columns) > len(columns):
                raise EngineError("INSERT has more expressions than target columns")
            df = df.toDF(*listed[: len(df.columns)])
            return self.placed(s, table, alias, df)
        lines = []
        while True:
            s.expect("(")
            values = []
            while True:
                if len(values) >= len(columns):
                    raise EngineError("INSERT has more expressions than target columns")
                c = columns[len(values)]
                if s.accept("DEFAULT"):
                    values.append(str(self.catalog.sequence(c.sequence).nextval()) if c.sequence else c.default or "NULL")
                else:
                    values.append(s.cast(s.expression(), c.type))
                if not s.accept(","):
                    break
            s.expect(")")
            if len(values) < len(columns):
                left = columns[len(values) :]
                if any(c.sequence for c in left):
                    raise EngineError("INSERT has fewer expressions than target columns")
                values += [c.default or "NULL" for c in left]
            drawn = {c.name: self.catalog.sequence(c.sequence).nextval() for c in table.columns if c.sequence and c.name not in listed}
            values, named = values + [str(v) for v in drawn.values()], columns + [table.column(c) for c in drawn]
            lines.append("SELECT " + ", ".join(f"CAST({v} AS {c.type}) AS `{c.name}`" for v, c in zip(values, named)))
            if not s.accept(","):
                break
        return self.placed(s, table, alias, self.spark.sql(" UNION ALL ".join(lines)))

    def placed(self, s: _Statement, table: Table, alias: str, rows: DataFrame) -> Result:
        """Insert rows, as ON CONFLICT says."""
        if not s.accept("ON", "CONFLICT"):
            return self.returning(s, table, insert(self.catalog, table, rows), "INSERT 0")
        key = None
        if s.accept("ON", "CONSTRAINT"):
            key = table.unique.get(s.name())
            if key is None:
                raise EngineError("constraint does not exist")
        elif s.peek() == "(":
            key = self.names(s)
            if not any(set(key) == set(k) for k in table.unique.values()):
                raise EngineError("there is no unique or exclusion constraint matching the ON CONFLICT specification")
        s.expect("DO")
        new = completed(self.catalog, table, numbered(rows, "_n"), ("_n",))[1]
        check_not_null(table, new)
        if s.accept("NOTHING"):
            kept = new
            for k in [key] if key else list(table.unique.values()):
                whole = F.lit(True)
                for c in k:
                    whole = whole & F.col(c).isNotNull()
                one = kept.filter(whole).groupBy(*k).agg(F.min("_n").alias("_n")).select("_n")  # of rows with one key the first
                kept = kept.filter(~whole).unionByName(kept.join(one, "_n", "left_semi").select(*kept.columns))
                kept = kept.join(table.df.select(*k), k, "left_anti").select(*kept.columns)
            return self.returning(s, table, insert(self.catalog, table, kept.drop("_n")), "INSERT 0")
        s.expect("UPDATE")
        if key is None:
            raise EngineError("ON CONFLICT DO UPDATE requires inference specification or constraint name")
        check_key = Table(table.schema, table.name, table.columns, unique={"ON CONFLICT DO UPDATE": key})
        new = new.drop("_n")
        check_unique(check_key, new, None)
        view = f"{table.view}_excluded"
        new.createOrReplaceTempView(view)
        on = " AND ".join(f"`{alias}`.`{c}` = `excluded`.`{c}`" for c in key)
        s.scopes.append(f" FROM `{table.view}` AS `{alias}` CROSS JOIN `{view}` AS `excluded`")
        s.expect("SET")
        changes = self.changes(s, table)
        where = s.expression() if s.accept("WHERE") else "true"
        s.scopes.pop()
        hit = f"(`excluded`.`_here` AND coalesce({where}, false))"
        columns = ", ".join([f"CASE WHEN {hit} THEN {changes[c.name]} ELSE `{alias}`.`{c.name}` END AS `{c.name}`" if c.name in changes else f"`{alias}`.`{c.name}` AS `{c.name}`" for c in table.columns])
        old = self.spark.sql(f"SELECT {columns}, coalesce({hit}, false) AS `_hit` FROM `{table.view}` AS `{alias}` LEFT JOIN (SELECT *, true AS `_here` FROM `{view}`) AS `excluded` ON {on}")
        fresh = new.join(table.df.select(*key), key, "left_anti").select(*new.columns).withColumn("_hit", F.lit(True))
        return self.returning(s, table, replace(self.catalog, table, old.unionByName(fresh), "_hit"), "INSERT 0")

    def changes(self, s: _Statement, table: Table) -> dict[str, str | None]:
        """The SET list: column -> SQL of its new value (None: a value of its sequence for each row)."""
        out: dict[str, str | None] = {}
        while True:
            c = table.column(s.name())
            s.expect("=")
            out[c.name] = (None if c.sequence else c.default or "NULL") if s.accept("DEFAULT") else s.cast(s.expression(), c.type)
            if not s.accept(","):
                return out

    def matched(self, s: _Statement, table: Table, name: str, extra: str, where: str, values: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """The table's stored rows numbered, and (number, new values) of those that match, once each."""
        base = numbered(table.df, "_row")
        view = f"{table.view}_base"
        base.createOrReplaceTempView(view)
        picks = "".join(f", {v} AS `_new_{c}`" for c, v in values.items())
        found = self.spark.sql(f"SELECT `{name}`.`_row`{picks} FROM `{view}` AS `{name}`{extra}{where}").dropDuplicates(["_row"])
        return base, found

    def update(self, s: _Statement) -> Result:
        schema, name = s.table_name()
        table = self.catalog.changeable(schema, name)
        alias = (s.alias()[5:-1] if s.peek() != "SET" else "") or name
        s.expect("SET")
        own = f" FROM `{table.view}` AS `{alias}`"
        start, depth = s.i, 0
        extra = ""
        for j in range(s.i, len(s.t)):  # the FROM of the update, if any, is in scope of its SET list
            word = s.t[j][1].upper()
            depth += (word == "(") - (word == ")")
            if depth == 0 and word == "FROM":
                s.i = j + 1
                extra = " CROSS JOIN " + s.sources()
                break
            if depth == 0 and word in ("WHERE", "RETURNING"):
                break
        s.i = start
        s.scopes.append(own + extra)
        changes = self.changes(s, table)
        if s.accept("FROM"):
            s.sources()
        where = s.expression() if s.accept("WHERE") else "true"
        s.scopes.pop()
        serial = [table.column(c) for c, v in changes.items() if v is None]
        changes = {c: v for c, v in changes.items() if v is not None}
        if extra:
            base, found = self.matched(s, table, alias, extra, f" WHERE {where}", changes)
            rows = base.join(found.withColumn("_hit", F.lit(True)), "_row", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        else:  # one pass over the table
            picks = "".join(f", CASE WHEN `_hit` THEN {v} END AS `_new_{c}`" for c, v in changes.items())
            rows = self.spark.sql(f"SELECT *{picks} FROM (SELECT *, coalesce({where}, false) AS `_hit` FROM `{table.view}` AS `{alias}`) AS `{alias}`")
        rows = rows.select("_hit", *(F.when(F.col("_hit"), F.col(f"_new_{c.name}").cast(c.type)).otherwise(F.col(c.name)).alias(c.name) if c.name in changes else F.col(c.name) for c in table.columns))
        if serial:
            rows = snapshot(rows, "updated")
            names = [c.name for c in serial]
            rows = rows.filter("NOT _hit").unionByName(drawn(self.catalog, rows.filter("_hit").drop(*names), serial))
        return self.returning(s, table, replace(self.catalog, table, rows, "_hit"), "UPDATE")

    def delete(self, s: _Statement) -> Result:
        s.expect("FROM")
        schema, name = s.table_name()
        table = self.catalog.changeable(schema, name)
        alias = (s.alias()[5:-1] if s.peek() not in ("WHERE", "USING", "RETURNING", "") else "") or name
        extra = f" CROSS JOIN {s.sources()}" if s.accept("USING") else ""
        s.scopes.append(f" FROM `{table.view}` AS `{alias}`{extra}")
        where = s.expression() if s.accept("WHERE") else "true"
        s.scopes.pop()
        if extra:
            base, found = self.matched(s, table, alias, extra, f" WHERE {where}", {})
            marked = base.join(found.withColumn("_hit", F.lit(True)), "_row", "left").drop("_row").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        else:
            marked = self.spark.sql(f"SELECT *, coalesce({where}, false) AS `_hit` FROM `{table.view}` AS `{alias}`")
        marked = snapshot(marked, table.name)  # kept and deleted rows, written once
        self.catalog.swap(table, marked.filter("NOT _hit").drop("_hit"))
        return self.returning(s, table, marked.filter("_hit").drop("_hit"), "DELETE")

    def merge(self, s: _Statement) -> Result:
        """MERGE INTO table [AS a] USING table or (query) [AS b] ON condition WHEN [NOT] MATCHED [AND condition] THEN ..."""
        s.expect("INTO")
        table = self.catalog.changeable(*s.table_name())
        alias = (s.alias()[5:-1] if s.peek() != "USING" else "") or table.name
        s.expect("USING")
        base = numbered(table.df, "_row")
        view = f"{table.view}_base"
        base.createOrReplaceTempView(view)
        source = s.sources()
        s.expect("ON")
        s.scopes.append(f" FROM `{table.view}` AS `{alias}` CROSS JOIN {source}")
        on = s.expression()
        matched, fresh = [], []
        while s.accept("WHEN"):
            new = s.accept("NOT")
            s.expect("MATCHED")
            when = f"coalesce({s.expression()}, false)" if s.accept("AND") else "true"
            s.expect("THEN")
            if s.accept("DO", "NOTHING"):
                (fresh if new else matched).append((when, "nothing", {}))
            elif new:
                s.expect("INSERT")
                listed = self.names(s) if s.peek() == "(" else [c.name for c in table.columns]
                s.expect("VALUES", "(")
                values = {}
                for c in map(table.column, listed):
                    if s.accept("DEFAULT"):
                        if not c.sequence:
                            values[c.name] = c.default or "NULL"
                    else:
                        values[c.name] = s.cast(s.expression(), c.type)
                    s.accept(",")
                s.expect(")")
                fresh.append((when, "insert", values))
            elif s.accept("DELETE"):
                matched.append((when, "delete", {}))
            else:
                s.expect("UPDATE", "SET")
                matched.append((when, "update", self.changes(s, table)))
        s.scopes.pop()
        if any(v is None for _, _, c in matched for v in c.values()):
            raise EngineError("DEFAULT of a sequence is not supported in MERGE")
        # The first clause whose condition holds decides a row.
        act = "CASE " + " ".join(f"WHEN {w} THEN {n}" for n, (w, _, _) in enumerate(matched)) + " ELSE -1 END" if matched else "-1"
        picks = "".join(f", {v} AS `_new_{n}_{c}`" for n, (_, _, changed) in enumerate(matched) for c, v in changed.items())
        found = snapshot(self.spark.sql(f"SELECT `{alias}`.`_row`, {act} AS `_act`{picks} FROM `{view}` AS `{alias}` CROSS JOIN {source} WHERE {on}"), "matched")
        if not found.filter("_act >= 0").groupBy("_row").count().filter("count > 1").isEmpty():
            raise EngineError("MERGE command cannot affect row a second time")
        joined = base.join(found.filter("_act >= 0"), "_row", "left").withColumn("_act", F.coalesce("_act", F.lit(-1)))
        value = {c.name: F.col(c.name) for c in table.columns}
        for n, (_, _, changed) in enumerate(matched):
            for c in changed:
                value[c] = F.when(F.col("_act") == n, F.col(f"_new_{n}_{c}").cast(table.column(c).type)).otherwise(value[c])
        gone = [n for n, (_, kind, _) in enumerate(matched) if kind == "delete"]
        busy = [n for n, (_, kind, _) in enumerate(matched) if kind != "nothing"]
        rows = joined.select(*(value[c.name].alias(c.name) for c in table.columns), F.col("_act").isin(busy).alias("_hit"), F.col("_act").isin(gone).alias("_gone"))
        parts, left = [], "true"
        for when, kind, values in fresh:
            if kind == "insert":
                picks = ", ".join(f"CAST({v} AS {table.column(c).type}) AS `{c}`" for c, v in values.items())
                some = self.spark.sql(f"SELECT {picks} FROM {source} WHERE ({left}) AND ({when}) AND NOT EXISTS (SELECT 1 FROM `{table.view}` AS `{alias}` WHERE {on})")
                parts.append(completed(self.catalog, table, some)[1])
            left = f"{left} AND NOT ({when})"
        for part in parts:
            rows = rows.unionByName(part.withColumns({"_hit": F.lit(True), "_gone": F.lit(False)}))
        whole = snapshot(rows, table.name)
        now = whole.filter("NOT _gone").drop("_gone", "_hit")
        check_not_null(table, now)
        check_unique(table, now, None)
        self.catalog.swap(table, now)
        return Result(f"MERGE {whole.filter('_hit').count()}")
