"""Shard filters: which part of a table a poll reads, and under which value its position is kept."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.buckets import BUCKETS, Bucket, bucket_text, hashed


class Shard:
    """The whole table."""

    @property
    def position_value(self) -> Any:
        """Keys the position; a shard without a value shares that of the unsharded poll."""
        return getattr(self, "value", None)

    def predicate(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class NoFilter(Shard):
    """No filter, but a position of its own, as pollers of one change set table need."""

    value: Any = None


@dataclass(frozen=True)
class FixedShard(Shard):
    """Rows whose column equals a value of any scalar type."""

    column: str
    value: Any

    def predicate(self) -> Column:
        return F.col(self.column) == F.lit(self.value)

    @classmethod
    def of_numeric(cls, column: str, value) -> FixedShard:
        return cls(column, decimal.Decimal(value))

    @classmethod
    def of_date(cls, column: str, value: str) -> FixedShard:
        return cls(column, dt.date.fromisoformat(value))


@dataclass(frozen=True)
class ShardList(Shard):
    """Rows whose column is one of several values; repeated values count once in every plan."""

    column: str
    value: tuple

    def __post_init__(self):
        object.__setattr__(self, "value", tuple(self.value))

    @property
    def values(self) -> list:
        return [v for v in dict.fromkeys(self.value) if v is not None]

    def predicate(self) -> Column:
        c = F.col(self.column)
        return c.isNotNull() & c.isin(*self.values)


@dataclass(frozen=True)
class NotNullShard(Shard):
    """Rows whose column has a value; writers set it to null once a row is done with."""

    column: str

    def predicate(self) -> Column:
        return F.col(self.column).isNotNull()


@dataclass(frozen=True)
class TimeShard(Shard):
    """Rows of the time bucket of ``now`` and of the one a short lookback before it.

    ``since`` widens the filter to every bucket from that moment on, for a watcher that
    was away for longer than the lookback.  ``encoded`` says that the column holds the
    base64 SHA-512 of the bucket's name, which spreads writes.
    """

    column: str
    bucket: str
    now: dt.datetime
    encoded: bool = True
    since: dt.datetime | None = None

    def names(self) -> list[str]:
        bucket: Bucket = BUCKETS[self.bucket]
        found = [bucket.name_of(self.now), bucket.name_of(self.now - dt.timedelta(seconds=bucket.lookback))]
        at = self.since
        while at is not None and at < self.now:
            found.append(bucket.name_of(at))
            at += bucket.step
        return list(dict.fromkeys(found))

    def predicate(self) -> Column:
        return F.col(self.column).isin(*[hashed(n) if self.encoded else n for n in self.names()])


def shard_id(at: Column, bucket: str, encoded: bool = True) -> Column:
    """What a writer stores in the shard column for a commit at ``at``."""
    name = bucket_text(at, bucket)
    return F.regexp_replace(F.base64(F.unhex(F.sha2(name, 512))), "[\r\n]", "") if encoded else name


def computed_shard(done: Column, value: Column, shards: int) -> Column:
    """Null for rows that are done with, else the value modulo ``shards`` with the dividend's sign."""
    return F.when(F.coalesce(done, F.lit(False)), F.lit(None)).otherwise(value % shards)


class BucketedTable:
    """A Parquet table in folders by the time bucket of its commits: a poll by TimeShard opens those of its buckets alone."""

    def __init__(self, spark: SparkSession, path: str, commit_ts: str, bucket: str, column: str = "shard", encoded: bool = True):
        self.spark, self.path, self.commit_ts, self.bucket, self.column, self.encoded = spark, path, commit_ts, bucket, column, encoded

    def write(self, rows: DataFrame) -> None:
        """Appends rows, with what ``shard_id`` gives in the column; each folder gets few files."""
        placed = rows.withColumn(self.column, shard_id(F.col(self.commit_ts), self.bucket, self.encoded))
        placed.repartition(self.column).write.mode("append").partitionBy(self.column).parquet(self.path)

    def read(self) -> DataFrame:
        """The table; names of buckets stay text, whatever they look like."""
        found = self.spark.read.parquet(self.path).schema
        kinds = [T.StructField(f.name, T.StringType(), True) if f.name == self.column else f for f in found.fields]
        return self.spark.read.schema(T.StructType(kinds)).parquet(self.path)

    def shard(self, now: dt.datetime, since: dt.datetime | None = None) -> TimeShard:
        return TimeShard(self.column, self.bucket, now, self.encoded, since)
