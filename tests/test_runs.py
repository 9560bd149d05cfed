"""Watchers that are far behind, and archives of many small objects: cost must not grow faster than what is read."""

import datetime as dt
import glob
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_streaming import Table
from where import SF

import __spark_entry__ as entry
from rowtide.model import EARLIEST, TableRef, TableSpec
from rowtide.operators import poll
from rowtide.plans import flows
from rowtide.sources.positions import MemoryPositionStore
from rowtide.sources.shared import kept
from rowtide.streaming import envelope
from rowtide.streaming.watcher import ChangeSetWatcher, DatabaseWatcher, TableWatcher

LARGER, LARGEST = SF.replace("sf0.001", "sf0.01"), SF.replace("sf0.001", "sf0.1")
SINCE = "o_orderdate > timestamp_ntz'1998-07-01'"


def flow_files(spark):
    return {f for f in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/flow-*/**", recursive=True) if os.path.isfile(f) and not f.endswith(".crc")}


def reads_of(monkeypatch, spark, name, d):
    """The rows of a query, and how often it opened tables."""
    opened, read = [], flows.read
    monkeypatch.setattr(flows, "read", lambda *a: (opened.append(a[2]), read(*a))[1])
    return entry.queries()[name](spark, d).collect(), len(opened)


def many(spark, n=40):
    t = Table(spark)
    for h in range(4):
        t.commit(h, *((100 * h + i, "n") for i in range(n // 4)))
    return t


def counted(t):
    calls = []
    return calls, lambda: (calls.append(1), t())[1]


# --- archives ------------------------------------------------------------------------


def test_an_archive_of_packs_has_no_files_for_each_message(spark):
    before = flow_files(spark)
    found = entry.queries()["archive_files"](spark, LARGER).count()
    assert found > 5000 and len(flow_files(spark) - before) < 300


def test_all_orders_are_archived_and_read_back(spark, monkeypatch, tmp_path):
    """Early orders are not returned, but are in the archive, and one that it lost makes the query fail."""
    orders, pack = spark.read.parquet(f"{SF}/orders.parquet"), envelope.pack_archive
    monkeypatch.setattr(flows, "own_folder", lambda spark: str(tmp_path / "all"))
    found = entry.queries()["archive_files"](spark, SF).count()
    assert found == orders.where("o_orderdate > timestamp_ntz'1998-07-25'").count()
    assert envelope.packed(spark, str(tmp_path / "all/archive")).count() == orders.count() > found
    monkeypatch.setattr(flows, "own_folder", lambda spark: str(tmp_path / "late"))
    monkeypatch.setattr(envelope, "pack_archive", lambda objects, root: pack(objects.where("path > 'db/orders-1998'"), root))
    with pytest.raises(Exception, match="no object db/orders-199[0-7]"):
        entry.queries()["archive_files"](spark, SF).count()


def test_packed_objects_are_those_of_files(spark, tmp_path):
    rows = [("d/a", b"1", {"Table": "t"}), ("d/b", None, None), ("d/c", b"3", {})]
    objects = spark.createDataFrame(rows, "path string, value binary, attributes map<string,string>")
    loose, packs = str(tmp_path / "loose"), str(tmp_path / "packs")
    envelope.write_archive(objects, loose)
    envelope.pack_archive(objects, packs, "1")
    told = lambda f: sorted((r.path, bytes(r.content), r.attributes) for r in f.collect())
    assert told(envelope.read_packed(objects, packs)) == told(envelope.read_archive(objects, loose))
    assert {r.path: r.meta for r in envelope.packed(spark, packs).collect()}["d/a"].replace('":', '": ').replace(',"', ', "') == (Path(loose) / "d/a.meta").read_text()
    # A pack of the same name replaces it; of two packs the last one counts.
    envelope.pack_archive(objects, packs, "1")
    assert envelope.packed(spark, packs).count() == 3
    envelope.pack_archive(spark.createDataFrame([("d/a", b"2", {})], objects.schema), packs, "2")
    assert {r[0]: r[1] for r in told(envelope.read_packed(objects, packs))} == {"d/a": b"2", "d/b": b"", "d/c": b"3"}
    with pytest.raises(Exception, match="no object d/x"):
        envelope.read_packed(spark.createDataFrame([("d/x",)], "path string"), packs).collect()


# --- watchers ------------------------------------------------------------------------


def test_a_watcher_by_shards_that_is_behind_reads_its_table_a_few_times(spark, monkeypatch):
    rows, reads = reads_of(monkeypatch, spark, "watcher_behind", LARGER)
    assert len(rows) > 4000 and {r.per_shard_polls for r in rows} == {len(rows) // 1000} and reads <= 3


@pytest.mark.parametrize("limit", [1, 4, 7, 40, 100])
def test_runs_have_the_rows_and_polls_of_batches(spark, limit):
    t = many(spark)
    watch = lambda table: TableWatcher(table, t.spec, MemoryPositionStore(start="earliest"), limit=limit)
    runs, batches, (calls, table) = [], [], counted(t)
    a, b = watch(table), watch(t)
    a.on_run(lambda ref, run, end: runs.append((sorted(r.id for r in run.collect()), end))).run_available()
    b.on_batch(lambda ref, batch, end: batches.append((sorted(r.id for r in batch.collect()), end))).run_available()
    told = lambda seen: sorted(i for ids, _ in seen for i in ids)
    assert told(runs) == told(batches) == sorted(t.rows) and runs[-1][1] == batches[-1][1] == a.position
    assert {k: v for k, v in a.metrics.items() if k != "last_poll_s"} == {k: v for k, v in b.metrics.items() if k != "last_poll_s"}
    assert max(len(ids) for ids, _ in batches) <= limit and len(calls) <= 4


def test_a_run_that_fails_comes_again_and_leaves_nothing(spark):
    t, store, seen, fails = many(spark), MemoryPositionStore(start="earliest"), [], [None, OSError()]

    def take(ref, run, end):
        ids = [r.id for r in run.collect()]
        if fails and (error := fails.pop(0)):
            raise error
        seen.extend(ids)

    first = TableWatcher(t, t.spec, store, limit=3).on_run(take)
    with pytest.raises(OSError):
        first.run_available()
    assert len(seen) == 3
    TableWatcher(t, t.spec, store, limit=3).on_run(take).run_available()
    assert sorted(seen) == sorted(t.rows) and not glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/run-*")


def test_a_watcher_without_callbacks_reads_its_table_a_few_times(spark, monkeypatch):
    rows, reads = reads_of(monkeypatch, spark, "watcher_metrics", LARGER)
    assert rows[0].n_rows > 6000 and rows[0].polls == 1 + rows[0].n_rows // 1000 and reads <= 3


def test_a_run_of_change_sets_joins_its_table_once(spark, monkeypatch):
    rows, reads = reads_of(monkeypatch, spark, "change_set_watch", LARGER)
    assert len(rows) > 20_000 and reads <= 7


def test_a_run_of_more_sets_than_an_index_takes(spark, monkeypatch):
    from rowtide.operators import changesets

    monkeypatch.setattr(changesets, "BROADCAST_SETS", 3)
    sets = spark.createDataFrame([(f"s{k}", dt.datetime(2024, 1, 1, k)) for k in range(9)], "id string, ts timestamp_ntz")
    data = spark.createDataFrame([(k, f"s{k % 9}") for k in range(30)], "k long, change_set_id string")

    class Index:
        def rows(self, ids):
            assert ids.count() <= 3
            return data

    seen = []
    w = ChangeSetWatcher(lambda: sets, TableSpec(TableRef("db", "sets"), "ts", ("id",)), lambda: data, TableRef("db", "data"), index=Index(), positions=MemoryPositionStore(start="earliest"), limit=2)
    w.on_run(lambda ref, run, end: seen.extend(r.k for r in run.collect())).run_available()
    assert sorted(seen) == list(range(30)) and w.metrics["polls"] == 5


def test_an_archived_topic_has_no_files_for_each_message(spark):
    before = flow_files(spark)
    rows = entry.queries()["archive_stream"](spark, LARGER).collect()
    assert len(rows) > 5000 and {r.others for r in rows} == {0} and len(flow_files(spark) - before) < 500


@pytest.mark.parametrize("limit, ahead", [(1, 1), (4, 3), (7, 2), (40, 1), (10, 4), (100, 1)])
def test_runs_of_a_drain(spark, limit, ahead):
    """The same batches as of a drain, from a few reads of the table."""
    t = many(spark)
    calls, table = counted(t)
    runs = [(sorted((r.batch, r.id) for r in run.collect()), end) for run, end in poll.runs(table, t.spec, EARLIEST, limit=limit, ahead=ahead)]
    batches = [(sorted(r.id for r in b.collect()), end) for b, end in poll.drain(t, t.spec, limit=limit)]
    assert sorted(x for run, _ in runs for x in run) == sorted((k, i) for k, (ids, _) in enumerate(batches) for i in ids)
    assert runs[-1][1] == batches[-1][1] and len(calls) <= 3


def test_drain_batches_is_a_few_writes(spark, monkeypatch):
    made, runs = [], poll.runs
    monkeypatch.setattr(poll, "runs", lambda *a, **o: (made.append(1) or r for r in runs(*a, **o)))
    found = entry.queries()["drain_batches"](spark, LARGER).select("batch").distinct().count()
    assert found == 74 and len(made) == 2


def test_a_run_is_numbered_over_partitions(spark):
    spec = TableSpec(TableRef("db", "n"), "ts", ("id",))
    df = spark.range(5000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id div 7) AS ts").repartition(6)
    found = {r.id: r.batch for run, _ in poll.runs(df, spec, limit=13) for r in run.collect()}
    assert found == {i: i // 13 for i in range(5000)}


def test_a_run_that_one_task_wrote_is_read_by_many(spark):
    """A table in one row group is one task's to read; what follows, such as encoding messages, is not."""
    with kept(spark.range(0, 4_000_000, 1, 1).select(F.xxhash64("id").alias("h"))) as run:
        sizes = [r["count"] for r in run.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4_000_000 and max(sizes) <= 2_000_000


# --- messages ------------------------------------------------------------------------


def test_a_publisher_that_is_behind_reads_its_table_a_few_times(spark, tmp_path):
    from rowtide.functions.json_codec import JsonConverter
    from rowtide.streaming.publisher import Publisher

    t = many(spark)
    calls, table = counted(t)
    p, topics, told = None, envelope.TopicFolder(str(tmp_path), create=True), []
    p = Publisher(TableWatcher(table, t.spec, MemoryPositionStore(start="earliest"), limit=2), topics, "t", JsonConverter)
    p.on_success.append(lambda ref, ts, message_id: told.append((ts, message_id)))
    p.run_available()
    sent = [r.message_id for r in topics.read(spark, "t").collect()]
    assert len(sent) == len(set(sent)) == 40 and sorted(sent) == sorted(m for _, m in told) and [ts for ts, _ in told] == sorted(ts for ts, _ in told)
    assert len(calls) <= 6


def test_a_crash_after_a_publication_reads_its_table_a_few_times(spark, monkeypatch):
    rows, reads = reads_of(monkeypatch, spark, "publish_again", LARGER)
    assert len(rows) > 6000 and {r.messages for r in rows} == {1} and reads <= 8


def test_batches_through_one_position_read_their_table_a_few_times(spark, monkeypatch):
    rows, reads = reads_of(monkeypatch, spark, "watcher_batches", LARGER)
    assert len(rows) > 6000 and reads <= 5


@pytest.mark.parametrize("name", ["watcher_tick", "watcher_timer"])
def test_a_watcher_stops_when_it_has_caught_up(spark, name):
    """More rows than the batches that it is asked to wait for."""
    found = entry.queries()[name](spark, LARGEST)
    assert found.count() == found.distinct().count() == spark.read.parquet(f"{LARGEST}/orders.parquet").where(SINCE).count() > 50_000


@pytest.mark.parametrize("name", ["subscription_resume", "publish_listeners", "subscriber_versions", "topic_roundtrip"])
def test_messages_of_a_table_that_is_read_a_few_times(spark, monkeypatch, name):
    rows, reads = reads_of(monkeypatch, spark, name, LARGEST)
    assert len(rows) > 1000 and reads <= 8


def test_tables_that_are_behind_are_read_a_few_times(spark):
    tables, calls, seen = {n: Table(spark, n) for n in "ab"}, [], []
    for n, t in tables.items():
        t.commit(1, *((i, n) for i in range(20)))
    made = {n: (lambda t=t: (calls.append(1), t())[1], t.spec) for n, t in tables.items()}
    w = DatabaseWatcher.over(made, positions=MemoryPositionStore(start="earliest"), limit=3, parallel=2)
    w.on_run(lambda ref, run, end: seen.extend((ref.table, r.id) for r in run.collect())).run_available()
    assert sorted(seen) == [(n, i) for n in "ab" for i in range(20)] and len(calls) <= 8
