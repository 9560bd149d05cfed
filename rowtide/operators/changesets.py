"""Change sets: tables whose rows carry the id of the transaction that wrote them.

Reading is one join of the transactions after a position with the data table.
Writing puts the data first and the transaction's row last; that row makes the data
visible, so a failure between the two leaves nothing half seen.  Rows of a transaction
lie in a folder of their own, named by its id and replaced as a whole, so a commit can
be repeated, and a read of some transactions opens their folders alone.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.model import EARLIEST, Position, TableSpec
from rowtide.operators import poll
from rowtide.operators.shards import Shard
from rowtide.sources.shared import held

COMMIT_TS = "_commit_ts"
#: Ids of change sets, some 50 bytes each.
BROADCAST_SETS = 100_000
#: The folder of a transaction's rows, and how many of them are named in a filter.
SET_FOLDER = "_set"
NAMED_SETS = 10_000


def folder_of(set_id: Column) -> Column:
    """A name for the folder of a set, by a hash of its id; the letter keeps Spark from taking it for a number."""
    return F.concat(F.lit("x"), F.substring(F.sha2(set_id.cast("string").cast("binary"), 256), 1, 32))


def changed_rows(
    change_sets: DataFrame,
    sets: TableSpec,
    data: DataFrame,
    data_id: str,
    position: Position = EARLIEST,
    shard: Shard | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of ``data`` written by change sets after ``position``, with the set's timestamp.

    ``limit`` bounds the change sets, never the rows of one.  A row that a later change
    set rewrote shows up for the later one alone; ids of any type can be joined.
    """
    ours = poll.poll(change_sets, sets, position, shard, limit) if limit else poll.changes(change_sets, sets, position, shard)
    return with_sets(data, data_id, ours, sets, limit)


def with_sets(data: DataFrame, data_id: str, sets: DataFrame, spec: TableSpec, most: int | None) -> DataFrame:
    """Rows of ``data`` that belong to ``sets``, which are broadcast if they are known to be few.

    Of a table that a ChangeSetWriter wrote only the folders of these sets are read.
    """
    picked = sets.select(F.col(spec.primary_key[0]).alias("__set_id"), F.col(spec.commit_ts).alias(COMMIT_TS))
    if SET_FOLDER in data.columns:
        if most and most <= NAMED_SETS:
            named = [r[0] for r in picked.select(folder_of(F.col("__set_id"))).distinct().collect()]
            data = data.where(F.col(SET_FOLDER).isin(named))
        data = data.drop(SET_FOLDER)
    small = F.broadcast(picked) if most and most <= BROADCAST_SETS else picked
    return data.join(small, F.col(data_id) == F.col("__set_id"), "inner").drop("__set_id")


def uuid_id() -> str:
    return str(uuid.uuid4())


class ChangeSetWriter:
    """Writes rows to Parquet tables, in transactions that carry a change set id.

    Committing a transaction again, after a failure at any point or after success,
    replaces what it wrote; the repeated marker has a new timestamp, so pollers see the
    rows once more.
    """

    def __init__(
        self,
        spark: SparkSession,
        set_path: str,
        id_column: str = "change_set_id",
        ts_column: str = "commit_timestamp",
        new_id: Callable[[], object] = uuid_id,
        clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None),
    ):
        self.spark, self.set_path, self.id_column, self.ts_column = spark, set_path, id_column, ts_column
        self.new_id, self.clock = new_id, clock

    def read(self, path: str) -> DataFrame:
        """All rows, without the column that names their folder."""
        return self.spark.read.parquet(path).drop(SET_FOLDER)

    def plain_write(self, path: str, rows: DataFrame) -> None:
        """No change set: pollers do not see these rows."""
        rows.withColumn(SET_FOLDER, F.lit("none")).write.mode("append").partitionBy(SET_FOLDER).parquet(path)

    def write(self, path: str, rows: DataFrame, change_set_id=None):
        """One transaction of one table; returns its id."""
        with self.transaction(change_set_id) as t:
            t.buffer(path, rows)
        return t.id

    @contextmanager
    def transaction(self, change_set_id=None):
        """Buffers writes to several tables under one id; nothing is written if the body raises."""
        t = _Transaction(self.new_id() if change_set_id is None else change_set_id, self.id_column)
        yield t
        self.commit(t)

    def run(self, body: Callable[[_Transaction], None], attempts: int = 3):
        """Runs ``body`` and commits; a retry after an error in either starts afresh with the same id."""
        change_set_id = self.new_id()
        for left in range(attempts - 1, -1, -1):
            t = _Transaction(change_set_id, self.id_column)
            try:
                body(t)
                self.commit(t)
                break
            except Exception:
                if not left:
                    raise
        return change_set_id

    def commit(self, t: _Transaction) -> None:
        for path in dict(t.buffered):
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for p, r in t.buffered if p == path])
            self._replace(path, rows)
        stamp = F.lit(self.clock()).cast("timestamp_ntz")
        self._replace(self.set_path, self.spark.range(1).select(F.lit(t.id).alias(self.id_column), stamp.alias(self.ts_column)))

    def _replace(self, path: str, rows: DataFrame) -> None:
        """Rows of one set in place of those that its folder has."""
        placed = rows.withColumn(SET_FOLDER, folder_of(F.col(self.id_column)))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SET_FOLDER).parquet(path)


class _Transaction:
    def __init__(self, change_set_id, id_column: str):
        self.id, self.id_column = change_set_id, id_column
        self.buffered: list[tuple[str, DataFrame]] = []

    def buffer(self, path: str, rows: DataFrame) -> None:
        self.buffered.append((path, rows.withColumn(self.id_column, F.lit(self.id))))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], ts: str, now: dt.datetime) -> DataFrame:
    """``table`` after an insert-or-update of ``rows``, all stamped with one ``now``.

    Of several rows of a key the one with the largest values wins; a null in a key equals
    another null.
    """
    values = [F.col(f"`{c}`") for c in rows.columns if c != ts]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__row")).select("__row.*")
    stamped = one.withColumn(ts, F.lit(now).cast(table.schema[ts].dataType))
    new = stamped.select(*[F.col(f"`{k}`").alias(f"__new_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__new_{k}`")) for k in keys])
    return table.join(new, same, "left_anti").select(*table.columns).unionByName(stamped, allowMissingColumns=True)


BUCKET = "_bucket"


class KeyedTable:
    """A Parquet table in folders by a hash of the key; an upsert reads and writes only the folders of its keys.

    A folder is replaced as a whole when the job commits, one folder after the other: a
    failed upsert can leave some of them new, and is repeated (it gives the same rows).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ts: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.ts, self.buckets = spark, path, keys, ts, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        self._placed(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def upsert(self, rows: DataFrame, now: dt.datetime) -> list[int]:
        """See ``upsert``; returns the buckets that were written.  Of null columns that ``rows`` lacks the old values go too."""
        table = self.spark.read.parquet(self.path)
        keyed = rows.select(*[F.col(f"`{k}`").cast(table.schema[k].dataType).alias(k) if k in self.keys else F.col(f"`{k}`") for k in rows.columns])
        with held(keyed) as new:  # the new rows may stem from this very table
            touched = sorted(r[0] for r in self._placed(new).select(BUCKET).distinct().collect())
            if touched:
                old = table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
                merged = self._placed(upsert(old, new, self.keys, self.ts, now))
                merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched
