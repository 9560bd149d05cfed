"""Which plan a poll should take."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from rowtide.model import Position, TableSpec
from rowtide.operators import poll
from rowtide.operators.shards import Shard, ShardList

LIMIT_MOST = 100_000
SHARDS_MOST = 100
FALLBACK_SECONDS = 60


def per_shard_possible(shard: Shard | None, limit: int) -> bool:
    return isinstance(shard, ShardList) and 0 < len(shard.values) <= SHARDS_MOST and limit <= LIMIT_MOST


def per_shard_wanted(had_changes: bool, lag: dt.timedelta, fallback_seconds: int = FALLBACK_SECONDS) -> bool:
    """True for a poll that lags behind.

    A poll that goes on inside a commit needs no exception: its position has a key, and
    both plans read on from there.
    """
    return had_changes and lag > dt.timedelta(seconds=fallback_seconds)


def lag_of(position: Position, now: dt.datetime) -> dt.timedelta:
    """How far a position is behind; a date counts from its midnight, and what is no time is not behind."""
    ts = position.ts
    if isinstance(ts, dt.date) and not isinstance(ts, dt.datetime):
        ts = dt.datetime.combine(ts, dt.time())
    if not isinstance(ts, dt.datetime):
        return dt.timedelta(0)
    return now - (ts.astimezone(dt.UTC).replace(tzinfo=None) if ts.tzinfo else ts)


def takes_shards(shard: Shard | None, position: Position, limit: int, had_changes: bool, now: dt.datetime, fallback_seconds: int = FALLBACK_SECONDS) -> bool:
    return per_shard_possible(shard, limit) and per_shard_wanted(had_changes, lag_of(position, now), fallback_seconds)


def planned_poll(
    df: DataFrame, spec: TableSpec, position: Position, shard: Shard | None, limit: int, had_changes: bool, now: dt.datetime, fallback_seconds: int = FALLBACK_SECONDS
) -> DataFrame:
    """``poll`` by the plan that suits; both give the same rows."""
    if takes_shards(shard, position, limit, had_changes, now, fallback_seconds):
        return poll.per_shard_poll(df, spec, shard, position, limit)
    return poll.poll(df, spec, position, shard, limit)
