"""Tables with constraints, defaults and sequences; data are immutable DataFrame snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import snapshot, stored, versions


class EngineError(ValueError):
    """A statement that can't be carried out; nothing has changed."""


@dataclass
class Sequence:
    """start, start + increment, ...; blocks are handed out for bulk inserts."""

    start: int = 1
    increment: int = 1
    value: int | None = None

    def nextval(self, n: int = 1) -> int:
        """The first of the next n values."""
        first = self.start if self.value is None else self.value + self.increment
        self.value = first + (n - 1) * self.increment
        return first

    def currval(self) -> int:
        if self.value is None:
            raise EngineError("currval of sequence is not yet defined in this session")
        return self.value

    def setval(self, value: int) -> int:
        self.value = value
        return value


@dataclass
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None  # Spark SQL text
    sequence: str | None = None


@dataclass
class Table:
    schema: str
    name: str
    columns: list[ColumnInfo]
    unique: dict[str, list[str]] = field(default_factory=dict)  # constraint name -> columns
    primary: list[str] = field(default_factory=list)
    df: DataFrame | None = None
    version: int = 0
    base: DataFrame | None = None  # what a version began with (None: with nothing), and the folders of rows appended to it
    added: list[str] = field(default_factory=list)
    owner: str = ""
    query: str | None = None  # of a view
    indexes: dict[str, object] = field(default_factory=dict)

    @property
    def view(self) -> str:
        return f"basalt_{self.owner}_{self.schema}_{self.name}"

    def column(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(f'column "{name}" of relation "{self.name}" does not exist')


#: Folders of appended rows that one version reads before they are written as one.
APPENDS = 32


class Catalog:
    """The tables of one engine; the views that stand for them in the session bear the engine's id."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.sequences, self.id = spark, {}, {}, uuid.uuid4().hex[:12]

    def get(self, schema: str, name: str) -> Table:
        found = self.tables.get(f"{schema}.{name}")
        if found is None:
            raise EngineError(f'relation "{name}" does not exist')
        return found

    def changeable(self, schema: str, name: str) -> Table:
        found = self.get(schema, name)
        if found.query is not None:
            raise EngineError(f'"{name}" is a view')
        return found

    def free(self, schema: str, name: str) -> None:
        if f"{schema}.{name}" in self.tables:
            raise EngineError(f'relation "{name}" already exists')

    def add(self, table: Table) -> None:
        table.owner = self.id
        self.tables[f"{table.schema}.{table.name}"] = table
        if table.df is None:
            self.swap(table)
        else:
            table.base = table.df if table.base is None and not table.added else table.base
            table.df.createOrReplaceTempView(table.view)

    def remove(self, table: Table) -> None:
        del self.tables[f"{table.schema}.{table.name}"]
        for c in table.columns:
            if c.sequence:
                self.sequences.pop(c.sequence, None)
        self.spark.catalog.dropTempView(table.view)

    def sequence(self, name: str) -> Sequence:
        full = name if "." in name else f"public.{name}"
        if full not in self.sequences:
            raise EngineError(f'relation "{name}" does not exist')
        return self.sequences[full]

    def empty(self, columns: list[ColumnInfo]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type}" for c in columns))

    def swap(self, table: Table, df: DataFrame | None = None, path: str | None = None) -> None:
        """Make df the table's next version, or what lies below path, or nothing; readers of the old one are not disturbed."""
        table.version += 1
        table.base, table.added = df if path is None else None, [path] if path else []
        table.df = self.empty(table.columns) if df is None else df
        table.df.createOrReplaceTempView(table.view)

    def append(self, table: Table, path: str) -> None:
        """The next version: what there is and the stored rows below path.  Nothing that is there is written again."""
        schema = ", ".join(f"`{c.name}` {c.type}" for c in table.columns)
        added = [*table.added, path]
        rows = versions(self.spark, added, schema)
        if len(added) > APPENDS:
            path, rows = stored(rows, table.name)
            added = [path]
        table.df, table.added, table.version = rows if table.base is None else table.base.unionByName(rows), added, table.version + 1
        table.df.createOrReplaceTempView(table.view)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with gapless numbers from 0 in row order.

    Ids are written with the rows, so their partitions and places are those of df; only one count for each
    partition is summed up.
    """
    tagged = snapshot(df.withColumn("_id", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_id", 33))
    counts = sorted((r["_part"], r["n"]) for r in tagged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    ahead = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))  # a row for each partition
    return tagged.join(ahead, "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def check_not_null(table: Table, rows: DataFrame) -> None:
    needed = [c.name for c in table.columns if not c.nullable]
    if needed:
        bad = rows.select(*(F.max(F.col(f"`{c}`").isNull()).alias(c) for c in needed)).first()
        for c in needed:
            if bad[c]:
                raise EngineError(f'null value in column "{c}" of relation "{table.name}" violates not-null constraint')


def check_unique(table: Table, rows: DataFrame, existing: DataFrame | None) -> None:
    """rows must not repeat a key among themselves nor hold one of existing; keys with nulls never clash."""
    for constraint, key in table.unique.items():
        quoted = [f"`{c}`" for c in key]
        known = rows.select(*quoted).dropna(how="any")
        clash = not known.groupBy(*quoted).count().filter("count > 1").isEmpty()
        if not clash and existing is not None:
            clash = not existing.select(*quoted).join(known, key, "left_semi").isEmpty()
        if clash:
            raise EngineError(f'duplicate key value violates unique constraint "{constraint}"')


def completed(catalog: Catalog, table: Table, rows: DataFrame, carried: tuple[str, ...] = ()) -> tuple[str, DataFrame]:
    """The folder and rows of an insert, stored: columns of the table, missing ones filled with defaults, and carried ones."""
    given = set(rows.columns)
    missing = [c for c in table.columns if c.name not in given]
    plain = {c.name: F.expr(c.default) if c.default is not None else F.lit(None) for c in missing if not c.sequence}
    rows = rows.withColumns(plain) if plain else rows
    rows = drawn(catalog, rows, [c for c in missing if c.sequence])
    return stored(rows.select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in table.columns), *carried), "rows")


def drawn(catalog: Catalog, rows: DataFrame, serial: list[ColumnInfo]) -> DataFrame:
    """rows with a value of its sequence in each of the serial columns."""
    if serial:
        rows = numbered(rows, "_no")
        n = rows.count()
        for c in serial:
            seq = catalog.sequence(c.sequence)
            first = seq.nextval(n) if n else 0
            rows = rows.withColumn(c.name, (F.lit(first) + F.col("_no") * seq.increment).cast(c.type))
        rows = rows.drop("_no")
    return rows


def insert(catalog: Catalog, table: Table, rows: DataFrame) -> DataFrame:
    """Append rows; gives them as stored.  All or nothing."""
    path, rows = completed(catalog, table, rows)
    check_not_null(table, rows)
    check_unique(table, rows, table.df)
    catalog.append(table, path)
    return rows


def replace(catalog: Catalog, table: Table, rows: DataFrame, hit: str | None = None) -> DataFrame:
    """Swap in the rows of an update, written once, after checking all of them; gives the rows that column hit marks."""
    path, whole = stored(rows, table.name)
    rows = whole.drop(hit) if hit else whole
    check_not_null(table, rows)
    check_unique(table, rows, None)
    catalog.swap(table, rows, path)
    return whole.filter(hit).drop(hit) if hit else rows
