"""The standalone publisher: ``python -m rowtide.app [properties file]``, and the archiver of what it publishes:
``python -m rowtide.app archive TOPIC... [properties file]``.

``rowtide.source.path`` holds Parquet tables named ``<table>.parquet`` and a file
``tables.json`` with the commit timestamp column and the key of each:
``{"orders": {"commit_ts": "o_orderdate", "primary_key": ["o_orderkey"]}}``.

The archiver follows the named topics below ``rowtide.topics.path``, looks for messages
every ``rowtide.archive.interval`` seconds (10), and writes below the folder that the
environment variable BUCKET_NAME names.  Each topic has a place of its own; a topic that
fails ends the archiver.
"""

from __future__ import annotations

import json
import os
import signal
import sys
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowtide.config import PREFIX, Config, read_properties
from rowtide.functions.codecs import load
from rowtide.model import TableRef
from rowtide.sources.catalog import Catalog
from rowtide.sources.positions import PositionStore, TablePositionStore
from rowtide.streaming.envelope import TopicFolder
from rowtide.streaming.publisher import Publisher
from rowtide.streaming.subscriber import Archiver
from rowtide.streaming.watcher import DatabaseWatcher


def described(spark: SparkSession, config: Config) -> Catalog:
    """What ``tables.json`` says, as frames of metadata."""
    known = json.loads("\n".join(r.value for r in spark.read.text(f"{config.source_path}/tables.json").collect()))
    keys = {n: about.get("primary_key", []) for n, about in known.items()}
    frame = lambda rows, shape: spark.createDataFrame(rows, f"catalog string, schema string, table string{shape}")
    return Catalog(
        frame([("", "", n) for n in known], ""),
        frame([("", "", n, about["commit_ts"], True, 1) for n, about in known.items() if about.get("commit_ts")], ", column string, commit_ts boolean, ordinal int"),
        frame([("", "", n, "PRIMARY_KEY", "PRIMARY_KEY") for n in known], ", index string, kind string"),
        frame([("", "", n, "PRIMARY_KEY", c, i) for n, key in keys.items() for i, c in enumerate(key)], ", index string, column string, ordinal int"),
        config.database,
    )


def opened(spark: SparkSession, config: Config, ref: TableRef) -> DataFrame:
    return spark.read.parquet(f"{config.source_path}/{ref.table}.parquet")


def publisher(spark: SparkSession, config: Config, positions: PositionStore | None = None) -> Publisher:
    """Publishes the selected tables; those without a commit timestamp column are left out of "all", and an error if named.

    Positions are kept in a table in the folder of topics unless another store is given.
    """
    positions = positions or TablePositionStore(spark, config.topics_path, "now", table="_positions")
    watcher = DatabaseWatcher.selected(described(spark, config), config.selection, partial(opened, spark, config), interval=config.poll_interval, positions=positions)
    topics = TopicFolder(config.topics_path, config.create_topics)
    return Publisher(watcher, topics, config.topic_format, lambda: load(config.converter), config.project, config.instance)


def archive(spark: SparkSession, topics: TopicFolder, names: list[str], root: str | None = None, interval: str | None = None) -> list[Any]:
    """Archives what topics have and ends, or, with an interval, starts queries that look for more that often."""
    root = root or os.environ.get("BUCKET_NAME")
    if not root:
        raise ValueError("no value for BUCKET_NAME")
    made = [Archiver(spark, topics, name, root).start(interval) for name in names]
    if interval is None:
        for query in made:
            query.awaitTermination()
    return made


def archive_until_stopped(names: list[str], properties: dict[str, str]) -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    topics = TopicFolder(properties.get(f"{PREFIX}topics.path", "topics"))
    running = archive(spark, topics, names, interval=f"{properties.get(f'{PREFIX}archive.interval', '10')} seconds")
    signal.signal(signal.SIGTERM, lambda *_: [query.stop() for query in running])
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in running:
            query.stop()


def main(args: list[str], overrides: dict[str, str] | None = None) -> None:
    if args[:1] == ["archive"]:
        named = args[1:]
        file = named.pop() if named and named[-1].endswith(".properties") else None
        return archive_until_stopped(named, read_properties(file) | (overrides or {}))
    properties = read_properties(args[0] if args else None)
    config = Config.read(properties, overrides)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    kept = properties.get(f"{PREFIX}positions.path")
    running = publisher(spark, config, TablePositionStore(spark, kept) if kept else None).start()
    signal.signal(signal.SIGTERM, lambda *_: running.watcher.stop())
    try:
        running.watcher.wait()
    finally:
        running.stop(config.max_wait_s)


if __name__ == "__main__":
    main(sys.argv[1:])
