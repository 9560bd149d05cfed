"""Gauges of running watchers and helpers to divide shards among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency(positions: DataFrame, last_seen: str, now: Column) -> DataFrame:
    """The largest age of a stored position, in whole seconds."""
    return positions.agg(F.max(F.timestamp_diff("SECOND", F.col(last_seen), now)).alias("latency_s"))


def max_poll_latency(positions: DataFrame, last_seen: str, now: Column, with_changes: int, watchers: int) -> int:
    """0 unless more than half of the watchers saw changes in their last poll."""
    if watchers and with_changes <= watchers // 2:
        return 0
    return latency(positions, last_seen, now).first()[0] or 0


def position_state(batch: DataFrame, ts: str) -> DataFrame:
    """Latest commit timestamp of a poll, and how many rows share it."""
    each = batch.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("last_ts")).agg(F.count("*").alias("ties"))
    return each.orderBy(F.desc("last_ts")).limit(1)


def latest_positions(rows: DataFrame, shard: str, ts: str) -> DataFrame:
    """For each shard value its latest commit timestamp, and how many rows there are."""
    return rows.groupBy(shard).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def cpu_use(stats: DataFrame, seconds: str, executions: str) -> DataFrame:
    """CPU seconds of a minute of queries, and their share of that minute in percent."""
    total = F.sum(F.col(seconds) * F.col(executions))
    return stats.agg(total.alias("cpu_s"), (total / 60 * 100).alias("cpu_percent"))


def latest_minute(stats: DataFrame, interval_end: str, now: Column) -> DataFrame:
    """The newest row of statistics that is at most two minutes old."""
    return stats.where(F.timestamp_diff("MINUTE", F.col(interval_end), now) <= 2).orderBy(F.col(interval_end).desc()).limit(1)


def divide_shards(shards: Sequence, watchers: int) -> list[list]:
    """Consecutive shares of the shards, as even as can be, the larger ones first."""
    each, extra = divmod(len(shards), watchers)
    edges = [i * each + min(i, extra) for i in range(watchers + 1)]
    return [list(shards[a:b]) for a, b in zip(edges, edges[1:])]
