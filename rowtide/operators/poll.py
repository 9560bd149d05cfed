"""Polls: the rows of a table after a position, in (commit timestamp, primary key) order.

Everything is a lazy DataFrame.  Positions become literals of the column's own type,
so that ``ts >= T`` reaches the Parquet reader; sort and limit plan as a top-k with
one small result a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rowtide.model import EARLIEST, Position, TableSpec
from rowtide.operators.shards import Shard, ShardList
from rowtide.sources.shared import held, kept

DEFAULT_LIMIT = 10_000


def typed(df: DataFrame, column: str, value) -> Column:
    """``value`` as a literal of the column's type; the column itself is never cast."""
    return F.lit(value).cast(df.schema[column].dataType)


def after(df: DataFrame, spec: TableSpec, position: Position) -> Column:
    """Rows later than ``position``.  A null commit timestamp is later than nothing."""
    ts = F.col(spec.commit_ts)
    if position.ts is None:
        return ts.isNotNull()
    at = typed(df, spec.commit_ts, position.ts)
    if position.key is None:
        return ts > at
    # (pk1 > k1) or (pk1 = k1 and pk2 > k2) or ...; nulls come first, as they sort.
    def beyond_from(rest: Column, pair: tuple) -> Column:
        name, value = pair
        c = F.col(name)
        if value is None:
            return c.isNotNull() | rest
        return (c > typed(df, name, value)) | ((c == typed(df, name, value)) & rest)

    beyond = reduce(beyond_from, reversed(list(zip(spec.primary_key, position.key))), F.lit(False))
    return (ts >= at) & ((ts > at) | beyond)


def changes(df: DataFrame, spec: TableSpec, position: Position = EARLIEST, shard: Shard | None = None) -> DataFrame:
    """All rows after ``position``, unordered and with every column."""
    found = df.where(after(df, spec, position))
    return found.where(shard.predicate()) if shard else found


def poll(df: DataFrame, spec: TableSpec, position: Position = EARLIEST, shard: Shard | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first ``limit`` rows after ``position``."""
    return changes(df, spec, position, shard).orderBy(*spec.order).limit(limit)


def rest_of_commit(df: DataFrame, spec: TableSpec, ts, skip: int = 0) -> DataFrame:
    """The rows of the commit at ``ts`` after its first ``skip``; a keyset position needs no such step."""
    return df.where(F.col(spec.commit_ts) == typed(df, spec.commit_ts, ts)).orderBy(*spec.primary_key).offset(skip)


def keys_only(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.select(*spec.primary_key, spec.commit_ts)


def per_shard_poll(df: DataFrame, spec: TableSpec, shards: ShardList, position: Position = EARLIEST, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The same rows as ``poll``: the first ``limit`` of every shard, then the first of those.

    Each task keeps at most ``limit`` rows a shard before the shuffle (Spark turns the
    rank filter into a group limit), which pays when shards are clustered.
    """
    rank = F.row_number().over(Window.partitionBy(shards.column).orderBy(*spec.order))
    ranked = changes(df, spec, position, shards).withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")
    return ranked.orderBy(*spec.order).limit(limit)


def late_poll(df: DataFrame, spec: TableSpec, shards: ShardList, position: Position = EARLIEST, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """As ``per_shard_poll``, but whole rows are fetched by key after the keys are chosen.

    A union of one top-k a shard, a global top-k, and an inner join on all key
    columns.  The keys are at most ``limit`` rows, so they may be broadcast.
    """
    branches = [
        keys_only(df.where(after(df, spec, position) & (F.col(shards.column) == typed(df, shards.column, v))), spec).orderBy(*spec.order).limit(limit)
        for v in shards.values
    ]
    keys = reduce(DataFrame.unionByName, branches).orderBy(*spec.order).limit(limit).select(*spec.primary_key)
    small = F.broadcast(keys) if limit <= 100_000 else keys
    return df.join(small, list(spec.primary_key), "inner").select(*df.columns).orderBy(*spec.order)


@dataclass
class Seen:
    """What a batch turned out to hold: where it ends, and how many rows."""

    end: Position | None
    rows: int


@contextmanager
def watched(rows: DataFrame, spec: TableSpec, keep: Callable = held) -> Iterator[tuple[DataFrame, Seen]]:
    """The rows, held, and what was observed while they were written: no job beside the poll's own."""
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.struct(*spec.order)).alias("end"))
    with keep(observed) as batch:
        got = seen.get
        end = Position(got["end"][0], tuple(got["end"][1:])) if got["n"] else None
        yield batch, Seen(end, got["n"])


def last_position(batch: DataFrame, spec: TableSpec) -> tuple[Position | None, int]:
    """Where a batch ends, and its number of rows; one aggregate, no sort."""
    top, n = batch.agg(F.max(F.struct(*spec.order)), F.count("*")).first()
    return (Position(top[0], tuple(top[1:])), n) if n else (None, 0)


def drain(
    df: DataFrame | Callable[[], DataFrame],
    spec: TableSpec,
    position: Position = EARLIEST,
    shard: Shard | None = None,
    limit: int = DEFAULT_LIMIT,
    ahead: int = 1,
) -> Iterator[tuple[DataFrame, Position]]:
    """Batches until a short one, each with the position to store once it is delivered.

    With ``ahead`` one scan of the table reads so many batches in advance.  A batch can be
    read until the next one is asked for.

    A full batch is followed at once; the position names the last row, so commits with
    more rows than ``limit`` are read on from where the batch ended.  ``df`` may be a
    function that opens the table anew for each poll.
    """
    while True:
        table = df() if callable(df) else df
        with watched(poll(table, spec, position, shard, limit * ahead), spec) as (rows, seen):
            if ahead == 1:
                if seen.rows:
                    position = seen.end
                    yield rows, position
            else:
                # The rows of one poll are few, so they may be numbered in one task.
                number = F.row_number().over(Window.orderBy(*spec.order)) - 1
                numbered = rows.withColumn("__batch", F.floor(number / limit))
                for k, top in numbered.groupBy("__batch").agg(F.max(F.struct(*spec.order))).orderBy("__batch").collect():
                    position = Position(top[0], tuple(top[1:]))
                    yield numbered.where(F.col("__batch") == k).drop("__batch"), position
        if seen.rows < limit * ahead:
            return


def runs(
    df: DataFrame | Callable[[], DataFrame],
    spec: TableSpec,
    position: Position = EARLIEST,
    shard: Shard | None = None,
    limit: int = DEFAULT_LIMIT,
    ahead: int = 1,
    number: str = "batch",
) -> Iterator[tuple[DataFrame, Position]]:
    """The batches of ``drain``, many in one frame: each row with the number of its batch, and the position after the run.

    The first run has ``ahead`` batches, and if they are full the next has all that is
    there.  So the table is read a few times however many batches it has, while ``drain``
    reads it for each ``ahead`` of them.  A run can be read until the next one is asked for.
    """
    most, first = limit * ahead, 0
    while True:
        table = df() if callable(df) else df
        found = changes(table, spec, position, shard) if most is None else poll(table, spec, position, shard, most)
        with watched(_placed(found, spec), spec, kept) as (rows, seen):
            if seen.rows:
                position = seen.end
                at = _numbered(rows).withColumn(number, F.lit(first) + F.floor(F.col("__at") / limit)).drop("__at")
                yield at, position
        first += seen.rows // limit
        # Batches after one that is not full would be empty; after a full one there may be more.
        if (seen.rows < most) if most else (not seen.rows or seen.rows % limit):
            return
        most = None


#: The bits of ``monotonically_increasing_id`` that count within a partition.
WITHIN = (1 << 33) - 1


def _placed(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows in order over all partitions, with their partition and their place in it; no partition has more than a part."""
    in_order = rows.repartitionByRange(*spec.order).sortWithinPartitions(*spec.order)
    return in_order.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN)).alias("__in_part"))


def _numbered(placed: DataFrame) -> DataFrame:
    """Numbers from 0 in ``__at``: a row's place in its partition, and how many rows the partitions before have."""
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row a partition.
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    return placed.join(starts, "__part").withColumn("__at", F.col("__before") + F.col("__in_part")).drop("__part", "__in_part", "__before")


def transactions(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of one commit grouped to one row: their number and keys (an addition; events are per row)."""
    return df.groupBy(spec.commit_ts).agg(F.count("*").alias("n_rows"), F.min(spec.primary_key[0]).alias("first_key"), F.max(spec.primary_key[0]).alias("last_key"))


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(ts).alias("last_ts"))


def without_repeats(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """One row for each (key, commit timestamp), for tables polled with an overlap (an addition)."""
    return rows.dropDuplicates([*spec.primary_key, spec.commit_ts])
