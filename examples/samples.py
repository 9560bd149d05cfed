"""Short uses of the library, one function each.  ``python examples/samples.py FOLDER``."""

from __future__ import annotations

import datetime as dt
import sys

from pyspark.sql import SparkSession

from rowtide import Position, TableRef, TableSpec
from rowtide.operators.changesets import ChangeSetWriter
from rowtide.operators.shards import FixedShard, NotNullShard, ShardList, TimeShard
from rowtide.sources.positions import MemoryPositionStore, PositionStore, TablePositionStore
from rowtide.streaming.envelope import TopicFolder, read_as, subscribe
from rowtide.streaming.poll_source import poll_stream
from rowtide.streaming.publisher import Publisher
from rowtide.streaming.subscriber import Archiver, Subscription
from rowtide.streaming.watcher import ChangeSetWatcher, DatabaseWatcher, TableWatcher

ORDERS = TableSpec(TableRef("db", "orders"), "o_orderdate", ("o_orderkey",))
EVENTS = TableSpec(TableRef("db", "events"), "ts", ("event_id",))
SINCE = dt.datetime(1998, 7, 1)


def show(table: TableRef, row, ts) -> None:
    print(table.table, ts, row)


def one_table(spark: SparkSession, folder: str) -> None:
    TableWatcher(lambda: spark.read.parquet(f"{folder}/orders.parquet"), ORDERS, MemoryPositionStore(SINCE)).on_row(show).run_available()


def several_tables(spark: SparkSession, folder: str) -> None:
    opened = {s.ref.table: (lambda n=s.ref.table: spark.read.parquet(f"{folder}/{n}.parquet"), s) for s in (ORDERS, EVENTS)}
    DatabaseWatcher.over(opened, interval=0.5, positions=MemoryPositionStore(SINCE)).on_row(show).run_available()


def four_shards(spark: SparkSession, folder: str) -> None:
    """A fixed value, a list, whatever is not null, and the current hour."""
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    for shard in (FixedShard("o_orderpriority", "2-HIGH"), ShardList("o_orderpriority", ("1-URGENT", "2-HIGH")), NotNullShard("o_orderpriority"), TimeShard("o_orderpriority", "HOUR_OF_DAY", now)):
        TableWatcher(lambda: spark.read.parquet(f"{folder}/orders.parquet"), ORDERS, MemoryPositionStore(SINCE), shard).on_row(show).run_available()


def errors(spark: SparkSession, folder: str) -> None:
    w = TableWatcher(lambda: spark.read.parquet(f"{folder}/absent.parquet"), ORDERS)
    w.listeners.append(lambda old, new: print(old.value, "->", new.value))
    w.start()
    try:
        w.wait(60)
    except Exception as error:
        print("failed:", type(error).__name__)


class PrintingStore(MemoryPositionStore):
    """A store of one's own."""

    def _write(self, table, shard, position, version):
        print("position", table.table, position)
        return super()._write(table, shard, position, version)


def own_store(spark: SparkSession, folder: str, store: PositionStore | None = None) -> None:
    TableWatcher(lambda: spark.read.parquet(f"{folder}/orders.parquet"), ORDERS, store or PrintingStore(SINCE), limit=100).run_available()


def stored_positions(spark: SparkSession, folder: str, path: str) -> None:
    own_store(spark, folder, TablePositionStore(spark, path, SINCE))


def change_sets(spark: SparkSession, work: str) -> None:
    writer = ChangeSetWriter(spark, f"{work}/sets")
    with writer.transaction() as t:
        t.buffer(f"{work}/data", spark.range(3))
    sets = TableSpec(TableRef("db", "sets"), "commit_timestamp", ("change_set_id",))
    read = spark.read.parquet
    ChangeSetWatcher(lambda: read(f"{work}/sets"), sets, lambda: read(f"{work}/data"), TableRef("db", "data"), positions=MemoryPositionStore("earliest")).on_row(show).run_available()


def publish_and_read(spark: SparkSession, folder: str, work: str) -> None:
    topics = TopicFolder(work, create=True)
    p = Publisher(TableWatcher(lambda: spark.read.parquet(f"{folder}/orders.parquet"), ORDERS, MemoryPositionStore(Position(SINCE).ts)), topics, "%database%-%table%")
    p.run_available()
    converter = p.converters[ORDERS.ref]
    subscribe(topics.read(spark, "db-orders"), converter, converter.json).show(5)


def follow_and_archive(spark: SparkSession, topics: TopicFolder, topic: str, root: str) -> None:
    """A subscription that prints what is new since its last run, and an archive of the topic."""
    Subscription(spark, topics, topic, "printer", lambda batch, k: batch.select("message_id", "attributes").show(3)).run_available()
    Archiver(spark, topics, topic, root).run_available()


def newer_schema(spark: SparkSession, topics: TopicFolder, topic: str, reader_json: str) -> None:
    """Messages of any version of a table by the fields of one schema."""
    read_as(topics.read(spark, topic), topics.schemas(spark, topic), reader_json).show(3)


def as_a_stream(spark: SparkSession, folder: str, work: str) -> None:
    """The changes of a table as a Structured Streaming source."""
    changes = poll_stream(spark, f"{folder}/orders.parquet", "o_orderdate", SINCE.isoformat())
    changes.writeStream.format("parquet").option("checkpointLocation", f"{work}/at").trigger(availableNow=True).start(f"{work}/out").awaitTermination()


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    one_table(session, sys.argv[1])
    own_store(session, sys.argv[1])
    errors(session, sys.argv[1])
