"""What tables there are, which can be watched, and by which columns.

Metadata live in four small DataFrames: ``tables`` (catalog, schema, table),
``columns`` (…, column, type, nullable, ordinal, commit_ts), ``indexes`` (…, index,
kind) and ``index_columns`` (…, index, column, ordinal).  Selections are joins over
them.  A plain DataFrame's own schema serves too (``commit_column``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.model import TableRef, TableSpec
from rowtide.sources.types import key_type_allowed, type_name

NAME = ["catalog", "schema", "table"]


class TableNotFound(LookupError):
    """An included table is missing or has no suitable column, or no table is left."""


@dataclass(frozen=True)
class Selection:
    """All tables but some, or some tables; never both."""

    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    every: bool = field(default=False)

    def __post_init__(self):
        if self.every == bool(self.included) or (self.included and self.excluded):
            raise ValueError("choose either all tables, with exceptions, or a list of tables")

    @classmethod
    def all_tables(cls) -> Selection:
        return cls(every=True)

    def but(self, *names: str) -> Selection:
        return Selection(self.included, self.excluded + names, self.every)

    @classmethod
    def include(cls, first: str, *more: str) -> Selection:
        return cls(included=(first, *more))


def picked(tables: DataFrame, selection: Selection) -> DataFrame:
    """Name in the list, or any name; and not excluded."""
    name = F.col("table")
    wanted = (F.lit(selection.every) | name.isin(*selection.included)) & ~name.isin(*selection.excluded)
    return tables.where(wanted)


def commit_ts_tables(tables: DataFrame, columns: DataFrame, selection: Selection) -> DataFrame:
    """Selected tables that have a commit timestamp column."""
    return picked(tables, selection).join(columns.where("commit_ts"), NAME, "left_semi")


def change_set_tables(tables: DataFrame, columns: DataFrame, selection: Selection, id_column: str, set_table: str) -> DataFrame:
    """Selected tables that have the change set id column; the change set table itself is left out."""
    having = columns.where(F.col("column") == id_column)
    return picked(tables, selection).where(F.col("table") != set_table).join(having, NAME, "left_semi")


def required(found: DataFrame, selection: Selection) -> list[TableRef]:
    """The found tables; an error names those that were asked for and are not among them."""
    names = [(r["catalog"], r["schema"], r["table"]) for r in found.select(*NAME).distinct().orderBy(*NAME).collect()]
    missing = [t for t in selection.included if t not in {n[2] for n in names}]
    if missing:
        raise TableNotFound(f"missing or unsuitable: {', '.join(missing)}")
    if not names:
        raise TableNotFound("no table is left to watch")
    return [TableRef("", t, c or "", s or "") for c, s, t in names]


def primary_key(indexes: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Key columns of every table, by ordinal."""
    own = indexes.where(F.col("kind") == "PRIMARY_KEY").select(*NAME, "index")
    return index_columns.join(own, [*NAME, "index"], "inner").select(*NAME, "column", "ordinal").orderBy(*NAME, "ordinal")


def column_schema(columns: DataFrame, table: str) -> DataFrame:
    return columns.where(F.col("table") == table).select("column", "type", "nullable", "ordinal").orderBy("ordinal")


@dataclass(frozen=True)
class Catalog:
    """The four frames of metadata of one database."""

    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    index_columns: DataFrame
    database: str = ""

    def refs(self, found: DataFrame, selection: Selection) -> list[TableRef]:
        return [TableRef(self.database, r.table, r.catalog, r.schema) for r in required(found, selection)]

    def change_set_refs(self, selection: Selection, id_column: str, set_table: str) -> list[TableRef]:
        return self.refs(change_set_tables(self.tables, self.columns, selection, id_column, set_table), selection)

    def specs(self, selection: Selection, commit_ts_of: Callable[[TableRef], str | None] | None = None) -> list[TableSpec]:
        """The selected tables with their key and commit timestamp column.

        The column is the first one flagged as such, or what ``commit_ts_of`` names.
        """
        refs = self.refs(commit_ts_tables(self.tables, self.columns, selection), selection)
        first: dict[tuple, str] = {}
        for r in self.columns.where("commit_ts").select(*NAME, "column").orderBy("ordinal").collect():
            first.setdefault((r["catalog"] or "", r["schema"] or "", r["table"]), r["column"])
        keys: dict[tuple, list[str]] = {}
        for r in primary_key(self.indexes, self.index_columns).collect():
            keys.setdefault((r["catalog"] or "", r["schema"] or "", r["table"]), []).append(r["column"])
        made = []
        for ref in refs:
            at = (ref.catalog, ref.schema, ref.table)
            if at not in keys:
                raise TableNotFound(f"{ref.full_name} has no primary key")
            column = (commit_ts_of(ref) if commit_ts_of else None) or first[at]
            made.append(TableSpec(ref, column, tuple(keys[at])))
        return made


def commit_column(df: DataFrame, chosen: str | None = None) -> str:
    """The chosen column, or the first one flagged in the schema's metadata."""
    if chosen is not None:
        if chosen not in df.columns:
            raise TableNotFound(f"no column {chosen}")
        return chosen
    for f in df.schema.fields:
        if f.metadata.get("commit_timestamp") and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f.name
    raise TableNotFound("no commit timestamp column")


def spec_of(df: DataFrame, ref: TableRef, key: tuple[str, ...], chosen: str | None = None) -> TableSpec:
    """A checked TableSpec for a DataFrame."""
    for k in key:
        f = df.schema[k]
        if not key_type_allowed(f.dataType, f.metadata):
            raise TypeError(f"column {k} can't be part of a key: {f.dataType.simpleString()}")
    return TableSpec(ref, commit_column(df, chosen), tuple(key))


def described(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], commit_ts: Callable[[str, T.StructField], bool] | None = None, database: str = "") -> Catalog:
    """A catalog of frames by name, from their schemas: columns, types, whether they may be null, and the keys that are given.

    A column is a commit timestamp if its metadata says so, or if ``commit_ts`` does.
    """
    spark = next(iter(tables.values())).sparkSession
    flagged = commit_ts or (lambda _, f: bool(f.metadata.get("commit_timestamp")))
    columns = [("", "", t, f.name, type_name(f.dataType, f.metadata), f.nullable, i, flagged(t, f)) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    frame = lambda rows, shape: spark.createDataFrame(rows, f"catalog string, schema string, table string{shape}")
    return Catalog(
        frame([("", "", t) for t in tables], ""),
        frame(columns, ", column string, type string, nullable boolean, ordinal int, commit_ts boolean"),
        frame([("", "", t, "PRIMARY_KEY", "PRIMARY_KEY") for t in keys], ", index string, kind string"),
        frame([("", "", t, "PRIMARY_KEY", c, i) for t, key in keys.items() for i, c in enumerate(key, 1)], ", index string, column string, ordinal int"),
        database,
    )
