import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from rowtide.config import Config, duration, read_properties
from rowtide.functions.avro_codec import AvroConverter
from rowtide.functions.json_codec import JsonConverter
from rowtide.model import Position, TableRef, TableSpec
from rowtide.operators.shards import FixedShard, ShardList
from rowtide.sources.catalog import Catalog, Selection, TableNotFound
from rowtide.sources.positions import FilePositionStore, MemoryPositionStore
from rowtide.streaming.envelope import TopicFolder, TopicNotFound, subscribe, to_archive, topic_name, write_archive
from rowtide.streaming.publisher import Publisher
from rowtide.streaming.watcher import ChangeSetWatcher, DatabaseWatcher, State, TableWatcher, follow_log, ticking

T0 = dt.datetime(2024, 1, 1)
SHAPE = "id long, name string, shard string, ts timestamp_ntz"


class Table:
    """A table that tests change by replacing its rows."""

    def __init__(self, spark, name="numbers"):
        self.spark, self.rows, self.spec = spark, {}, TableSpec(TableRef("db", name), "ts", ("id",))

    def commit(self, hour, *changes, shard="s"):
        self.rows |= {i: (i, n, shard, T0 + dt.timedelta(hours=hour)) for i, n in changes}

    def __call__(self):
        return self.spark.createDataFrame(list(self.rows.values()), SHAPE)


def collect(watcher):
    seen = []
    watcher.on_row(lambda table, row, ts: seen.append((table.table, row.id, row.name, ts.hour)))
    return seen


def rounds(table, limit=10_000, shard=None):
    store = MemoryPositionStore(start="earliest")

    def go():
        w = TableWatcher(table, table.spec, store, shard, limit)
        seen = collect(w)
        w.run_available()
        return [x[1] for x in seen]

    return go


@pytest.mark.parametrize("limit", [1, 2, 10_000])
@pytest.mark.parametrize("shard", [None, FixedShard("shard", "s"), ShardList("shard", ("s", "z", "s"))])
def test_script(spark, limit, shard):
    """Insert 1-3, insert 4-5, update 1 and 5, delete 2 and 3 (which nobody sees)."""
    t = Table(spark)
    t.commit(1, (1, "a"), (2, "b"), (3, "c"))
    go = rounds(t, limit, shard)
    assert go() == [1, 2, 3]
    t.commit(2, (4, "d"), (5, "e"))
    assert go() == [4, 5]
    t.commit(3, (1, "x"), (5, "y"))
    assert go() == [1, 5]
    del t.rows[2], t.rows[3]
    assert go() == []


@pytest.mark.parametrize("fail_at", range(5))
def test_failure_loses_nothing(spark, tmp_path, fail_at):
    t = Table(spark)
    for h in range(2):
        t.commit(h, *((10 * h + i, "n") for i in range(4)))
    store, seen = FilePositionStore(str(tmp_path / "p.json"), start="earliest"), []

    def breaking(table, row, ts):
        if len(seen) == fail_at and not breaking.done:
            breaking.done = True
            raise OSError("down")
        seen.append(row.id)

    breaking.done = False
    w = TableWatcher(t, t.spec, store, limit=3)
    w.on_row(breaking)
    with pytest.raises(OSError):
        w.run_available()
    assert w.state is State.FAILED and w.failed_from is State.RUNNING
    again = TableWatcher(t, t.spec, store, limit=3)
    again.on_row(breaking)
    again.run_available()
    assert set(seen) == set(t.rows) and list(dict.fromkeys(seen)) == sorted(t.rows)


def test_states_and_rules(spark):
    t = Table(spark)
    t.commit(1, (1, "a"))
    store, told = MemoryPositionStore(start="earliest"), []
    w = TableWatcher(t, t.spec, store, interval=0.05)
    w.listeners.append(lambda old, new: told.append(new))
    seen = collect(w)
    w.start()
    with pytest.raises(RuntimeError):
        w.on_row(print)
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.05)
    t.commit(2, (2, "b"))
    while len(seen) < 2 and time.time() < deadline:
        time.sleep(0.05)
    w.stop()
    assert w.wait(60) is State.TERMINATED and [s[1] for s in seen] == [1, 2]
    assert told == [State.STARTING, State.RUNNING, State.STOPPING, State.TERMINATED]
    assert w.metrics["rows"] == 2 and spark.range(1).count() == 1
    with pytest.raises(RuntimeError):
        w.start()


def test_missing_table_or_column_fails_while_starting(spark):
    t = Table(spark)
    t.commit(1, (1, "a"))
    w = TableWatcher(t, TableSpec(t.spec.ref, "absent", ("id",)))
    with pytest.raises(TableNotFound):
        w.run_available()
    assert w.failed_from is State.STARTING
    gone = TableWatcher(lambda: spark.read.parquet("/no/such/table"), t.spec)
    gone.start()
    with pytest.raises(Exception):
        gone.wait(60)
    assert gone.state is State.FAILED and gone.failed_from is State.STARTING


@pytest.mark.parametrize("parallel", [1, 2])
def test_several_tables(spark, parallel):
    a, b = Table(spark, "a"), Table(spark, "b")
    a.commit(1, (1, "x"), (2, "y"))
    b.commit(2, (7, "z"), shard="other")
    store = MemoryPositionStore(start="earliest")
    w = DatabaseWatcher.over({"a": (a, a.spec), "b": (b, b.spec)}, shards={"b": FixedShard("shard", "other")}, parallel=parallel, positions=store)
    seen = collect(w)
    w.run_available()
    assert sorted(s[:2] for s in seen) == [("a", 1), ("a", 2), ("b", 7)]
    assert all("limit 10000" in x.last_statement for x in w.watchers)
    assert store.get(b.spec.ref, "other") == Position(T0 + dt.timedelta(hours=2), (7,))
    with pytest.raises(TableNotFound):
        DatabaseWatcher([])


def test_change_set_watcher(spark):
    sets = spark.createDataFrame([("c1", T0), ("c2", T0 + dt.timedelta(hours=1)), ("empty", T0)], "change_set_id string, commit_timestamp timestamp_ntz")
    data = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2"), (3, "c", "c1"), (4, "d", "unknown")], "id long, name string, change_set_id string")
    spec = TableSpec(TableRef("db", "sets"), "commit_timestamp", ("change_set_id",))
    w = ChangeSetWatcher(lambda: sets, spec, lambda: data, TableRef("db", "data"), positions=MemoryPositionStore(start="earliest"), limit=1)
    seen = collect(w)
    w.run_available()
    assert [(s[0], s[3]) for s in seen] == [("data", 0), ("data", 0), ("data", 1)] and {s[1] for s in seen} == {1, 2, 3}


@pytest.mark.parametrize("converter", [AvroConverter, JsonConverter])
def test_publish_subscribe(spark, tmp_path, converter):
    t = Table(spark, "singers")
    t.commit(1, (1, "a"), (2, None))
    topics, template = TopicFolder(str(tmp_path)), "projects/p/topics/%database%-%table%"
    closed = Publisher(TableWatcher(t, t.spec, MemoryPositionStore(start="earliest")), topics, template, converter)
    with pytest.raises(TopicNotFound):
        closed.run_available()
    topics.create = True
    p = Publisher(TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"), limit=1), topics, template, converter)
    told = []
    p.on_success.append(lambda ref, ts, message_id: told.append((ref.table, ts, message_id)))
    p.run_available()
    topic = topic_name(template, t.spec.ref)
    sent = {r.message_id for r in topics.read(spark, topic).collect()}
    assert topic == "projects/p/topics/db-singers" and [x[:2] for x in told] == [("singers", T0 + dt.timedelta(hours=1))] * 2 and {x[2] for x in told} == sent
    made = p.converters[t.spec.ref]
    got = subscribe(topics.read(spark, topic), made, made.json if converter is AvroConverter else t().schema).orderBy("id").collect()
    assert [(r.id, r.name, r.ts, r._database, r._table) for r in got] == [(1, "a", "2024-01-01T01:00:00Z", "db", "singers"), (2, None, "2024-01-01T01:00:00Z", "db", "singers")]
    with pytest.raises(RuntimeError):
        Publisher(p.watcher, topics, template)


def test_publish_failure_stops_the_watcher(spark, tmp_path):
    t = Table(spark)
    t.commit(1, (1, "a"))
    topics = TopicFolder(str(tmp_path), create=True)
    store = MemoryPositionStore(start="earliest")
    p = Publisher(TableWatcher(t, t.spec, store), topics, "%table%", JsonConverter)
    told = []
    p.on_failure.append(lambda ref, ts, error: told.append((ts, type(error))))
    topics.publish = lambda *a, **b: (_ for _ in ()).throw(TopicNotFound("gone"))
    with pytest.raises(TopicNotFound):
        p.run_available()
    assert told == [(T0 + dt.timedelta(hours=1), TopicNotFound)] and p.watcher.state is State.FAILED and store.get(t.spec.ref).ts is None


def metadata(spark, names, id_tables=()):
    frame = lambda rows, shape: spark.createDataFrame(rows, f"catalog string, schema string, table string{shape}")
    columns = [("", "", n, c, c == "ts" or c == "other", i) for n in names for i, c in enumerate(("id", "ts", "other"))] + [("", "", n, "change_set_id", False, 9) for n in id_tables]
    return Catalog(
        frame([("", "", n) for n in {*names, *id_tables}], ""),
        frame(columns, ", column string, commit_ts boolean, ordinal int"),
        frame([("", "", n, "PRIMARY_KEY", "PRIMARY_KEY") for n in names], ", index string, kind string"),
        frame([("", "", n, "PRIMARY_KEY", "id", 1) for n in names], ", index string, column string, ordinal int"),
        "db",
    )


def test_watchers_from_a_selection(spark):
    tables = {n: Table(spark, n) for n in ("a", "b", "c")}
    for h, t in enumerate(tables.values()):
        t.commit(h, (h, "x"))
    opened = lambda ref: tables[ref.table]().withColumn("other", F.col("ts") + F.expr("interval 5 hours"))
    w = DatabaseWatcher.selected(metadata(spark, [*tables]), Selection.all_tables().but("c"), opened, lambda ref: "other" if ref.table == "b" else None, positions=MemoryPositionStore(start="earliest"))
    seen = collect(w)
    assert {x.spec.ref: x.spec.order for x in w.watchers} == {TableRef("db", "a"): ["ts", "id"], TableRef("db", "b"): ["other", "id"]}
    w.run_available()
    assert sorted(seen) == [("a", 0, "x", 0), ("b", 1, "x", 6)] and {x.state for x in w.watchers} == {State.TERMINATED}
    with pytest.raises(TableNotFound):
        DatabaseWatcher.selected(metadata(spark, ["a"]), Selection.include("a", "z"), opened)


def test_change_set_watchers_from_a_selection(spark):
    sets = Table(spark, "sets")
    sets.commit(3, (7, "w"), (8, "w"))
    data = {n: spark.createDataFrame([(i, f"{n}{i}", 7 + i % 2) for i in range(4)], "id long, name string, change_set_id long") for n in ("d", "e")}
    opened = lambda ref: sets() if ref.table == "sets" else data[ref.table]
    w = DatabaseWatcher.over_change_sets(metadata(spark, ["sets"], ["sets", "d", "e"]), Selection.all_tables(), opened, sets.spec, positions=MemoryPositionStore(start="earliest"))
    seen = collect(w)
    w.run_available()
    assert sorted(seen) == [(n, i, f"{n}{i}", 3) for n in ("d", "e") for i in range(4)]
    again = DatabaseWatcher.over_change_sets(metadata(spark, ["sets"], ["sets", "d"]), Selection.all_tables(), opened, sets.spec, positions=w.watchers[0].positions)
    more = collect(again)
    again.run_available()
    assert more == []


def test_one_table_fails(spark):
    good, bad = Table(spark, "good"), Table(spark, "bad")
    good.commit(1, (1, "a")), bad.commit(1, (1, "a"))
    w = DatabaseWatcher.over({"good": (good, good.spec), "bad": (bad, bad.spec)}, positions=MemoryPositionStore(start="earliest"))
    w.on_batch(lambda ref, batch, end: (_ for _ in ()).throw(OSError("down")) if ref.table == "bad" else None)
    with pytest.raises(OSError):
        w.run_available()
    assert [x.state for x in (w, *w.watchers)] == [State.FAILED, State.TERMINATED, State.FAILED] and isinstance(w.watchers[1].error, OSError)
    with pytest.raises(RuntimeError):
        w.watchers[0].on_row(print)


def test_failing_tick(spark):
    t = Table(spark)
    t.commit(1, (1, "a"))
    w = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"))
    w.on_batch(lambda *a: (_ for _ in ()).throw(OSError("down")))
    query = ticking(spark, w)
    with pytest.raises(Exception):
        query.awaitTermination(60)
    assert w.state is State.FAILED and isinstance(w.error, OSError)


def test_archive(spark, tmp_path, monkeypatch):
    music = "projects/test-project/instances/test-instance/databases/music"
    a = {"Timestamp": "2020-04-05T21:23:59.199818000Z", "Database": music, "Catalog": "", "Schema": "", "Table": "Singers"}
    rows = [(b"some data", a), (b"x", a | {"Catalog": "c", "Schema": "s"}), (b"y", a | {"Replay": "True"}), (b"z", a | {"Replay": "true", "Table": "T"})]
    messages = spark.createDataFrame(rows, "value binary, attributes map<string,string>")
    objects = to_archive(messages, F.lit("9999"))
    want = [f"{music}/Singers-2020-04-05T21:23:59.199818000Z-9999", f"{music}/T-2020-04-05T21:23:59.199818000Z-9999", f"{music}/c-s-Singers-2020-04-05T21:23:59.199818000Z-9999"]
    assert sorted(r.path for r in objects.collect()) == want
    monkeypatch.delenv("BUCKET_NAME", raising=False)
    with pytest.raises(ValueError):
        write_archive(objects)
    monkeypatch.setenv("BUCKET_NAME", str(tmp_path))
    assert write_archive(objects) == 3 == write_archive(objects)
    assert (tmp_path / want[0]).read_bytes() == b"some data"
    meta = json.loads((tmp_path / f"{want[0]}.meta").read_text())
    assert meta == {"contentType": "protobuf/bytes", "metadata": a} and len([p for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")]) == 6


def test_ticking_stream(spark):
    t = Table(spark)
    t.commit(1, (1, "a"))
    w = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"))
    seen = collect(w)
    q = ticking(spark, w, "200 milliseconds")
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.1)
    q.stop()
    assert [s[1] for s in seen] == [1]


def test_follow_log(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    deliver = lambda df, n: seen.extend(r.id for r in df.collect())
    go = lambda: follow_log(spark, log, "id long", deliver, str(tmp_path / "cp")).awaitTermination(60)
    spark.range(3).write.parquet(log)
    go()
    spark.range(3, 5).write.mode("append").parquet(log)
    go()
    assert sorted(seen) == [0, 1, 2, 3, 4]


BASE = {"rowtide.source.path": "/d", "rowtide.source.database": "db", "rowtide.topics.nameFormat": "%table%"}


@pytest.mark.parametrize(
    "more, fine",
    [
        ({}, True),
        ({"source.allTables": "true"}, True),
        ({"source.excludedTables": "a,b"}, True),
        ({"source.includedTables": "a,b"}, True),
        ({"source.allTables": "false", "source.includedTables": "a"}, True),
        ({"source.allTables": "true", "source.includedTables": "a"}, False),
        ({"source.allTables": "false", "source.excludedTables": "a"}, False),
        ({"source.allTables": "false"}, False),
        ({"source.includedTables": "a", "source.excludedTables": "b"}, False),
        ({"source.path": ""}, False),
        ({"source.database": ""}, False),
        ({"topics.nameFormat": ""}, False),
        ({"topics.converter": "json"}, True),
        ({"topics.converter": "no.Such"}, False),
        ({"source.pollInterval": "1 second"}, False),
    ],
)
def test_config(more, fine):
    more = {f"rowtide.{k}": v for k, v in more.items()}
    if fine:
        c = Config.read(BASE, more)
        assert c.selection.every != bool(c.selection.included) and c.poll_interval == 0.1 and c.max_wait_s == 10 and not c.create_topics
    else:
        with pytest.raises(ValueError):
            Config.read(BASE, more)


def test_properties(tmp_path, monkeypatch):
    (tmp_path / "x.properties").write_text("# note\nrowtide.source.path = /d\nrowtide.a: b\n\n! note\nempty=\n")
    assert read_properties(str(tmp_path / "x.properties")) == {"rowtide.source.path": "/d", "rowtide.a": "b", "empty": ""}
    with pytest.raises(FileNotFoundError):
        read_properties(str(tmp_path / "none"))
    monkeypatch.chdir(tmp_path)
    assert read_properties() == {}
    assert [duration(x) for x in ("PT0.1S", "PT1M", "P1DT2H")] == [0.1, 60.0, 93600.0]


# --- what polls leave behind, and how they are planned -------------------------------


def checkpoints(spark):
    import glob

    return sum(map(len, (glob.glob(f"{d}/*/rdd-*") for d in [spark.conf.get("spark.checkpoint.dir")])))


def test_polls_leave_no_checkpoints(spark):
    t = Table(spark)
    t.commit(1, *((i, "n") for i in range(5)))
    before = checkpoints(spark)
    w = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"), limit=2)
    seen = collect(w)
    w.run_available()
    for _ in range(47):
        assert not w.poll_once()
    assert len(seen) == 5 and w.metrics["polls"] == 50 and checkpoints(spark) == before


def test_a_failed_callback_leaves_no_checkpoint(spark):
    t = Table(spark)
    t.commit(1, (1, "a"))
    before = checkpoints(spark)
    w = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"))
    w.on_batch(lambda *_: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        w.run_available()
    assert checkpoints(spark) == before


def test_a_poll_is_one_job(spark):
    """What the poll tells is observed while its batch is written."""
    t = Table(spark)
    t.commit(1, (1, "a"), (2, "b"))
    table = t()
    w = TableWatcher(lambda: table, t.spec, MemoryPositionStore(start="earliest"))
    w.prepare()
    spark.sparkContext.setJobGroup("one poll", "")
    try:
        w.poll_once()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one poll")
    # One to find the rows, one to write what was found.
    assert w.metrics["rows"] == 2 and len(jobs) <= 2


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_a_watcher_behind_takes_the_per_shard_plan(spark, limit):
    t = Table(spark)
    for h in range(4):
        t.commit(h, *((10 * h + i, "n") for i in range(4)), shard="sz"[h % 2])
    w = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"), ShardList("shard", ("s", "z")), limit)
    seen = collect(w)
    w.run_available()
    assert [s[1] for s in seen] == sorted(t.rows) and w.metrics["per_shard_polls"] == w.metrics["polls"] - 1 > 0
    near = TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"), ShardList("shard", ("s", "z")), limit, clock=lambda: T0)
    near.run_available()
    assert near.metrics["per_shard_polls"] == 0 and near.metrics["rows"] == len(t.rows)


def test_order_within_a_change_set(spark):
    """Rows of a set come by their key, sets by their timestamp."""
    sets = spark.createDataFrame([("b", T0), ("a", T0 + dt.timedelta(1))], "id string, ts timestamp_ntz")
    data = spark.createDataFrame([(k, "ab"[k % 2]) for k in (5, 3, 8, 1, 2)], "k long, change_set_id string")
    w = ChangeSetWatcher(lambda: sets, TableSpec(TableRef("db", "sets"), "ts", ("id",)), lambda: data, TableRef("db", "data"), key=("k",), positions=MemoryPositionStore(start="earliest"))
    seen = []
    w.on_row(lambda table, row, ts: seen.append((ts.day, row.k)))
    w.run_available()
    assert seen == [(1, 1), (1, 3), (1, 5), (2, 2), (2, 8)]


def test_change_set_watcher_reads_folders_of_its_sets(spark, tmp_path):
    from rowtide.operators.changesets import ChangeSetWriter, with_sets

    hours = iter(range(24))
    writer = ChangeSetWriter(spark, str(tmp_path / "sets"), clock=lambda: T0 + dt.timedelta(hours=next(hours)))
    for k in range(6):
        writer.write(str(tmp_path / "data"), spark.range(k * 10, k * 10 + 3), f"{k:03d}")
    writer.plain_write(str(tmp_path / "data"), spark.range(900, 902).withColumn("change_set_id", F.lit("000")))
    spec = TableSpec(TableRef("db", "sets"), "commit_timestamp", ("change_set_id",))
    some = spark.read.parquet(str(tmp_path / "sets")).where("change_set_id in ('001', '004')")
    found = with_sets(spark.read.parquet(str(tmp_path / "data")), "change_set_id", some, spec, 100)
    assert sorted(r.id for r in found.collect()) == [10, 11, 12, 40, 41, 42] and "_set" not in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_set#" in plan and "number of partitions read: 2" in plan or "_set#" in plan.split("PartitionFilters:")[1][:20]
    seen = []
    w = ChangeSetWatcher(lambda: spark.read.parquet(str(tmp_path / "sets")), spec, lambda: spark.read.parquet(str(tmp_path / "data")), TableRef("db", "data"), key=("id",), positions=MemoryPositionStore(start="earliest"), limit=4)
    w.on_row(lambda table, row, ts: seen.append(row.id))
    w.run_available()
    assert seen == [k * 10 + i for k in range(6) for i in range(3)]
    # A part of a transaction's second table, and two writes to one table.
    with writer.transaction("007") as t:
        t.buffer(str(tmp_path / "data"), spark.range(70, 72))
        t.buffer(str(tmp_path / "data"), spark.range(72, 74))
    w2 = spark.read.parquet(str(tmp_path / "data")).where("change_set_id = '007'")
    assert sorted(r.id for r in w2.collect()) == [70, 71, 72, 73]


# --- file index --------------------------------------------------------------------


def test_file_index(spark, tmp_path):
    from rowtide.sources.file_index import FileIndex

    table = str(tmp_path / "t")
    spark.range(1000).withColumn("x", F.col("id") * 2).repartitionByRange(10, "id").write.parquet(table)
    index = FileIndex(spark, table, str(tmp_path / "i"), "id")
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "k int")
    assert index.refresh() == 10 and index.refresh() == 0
    assert len(index.files(ids(5, 7, None))) == 1 and len(index.files(ids(5, 995))) == 2 and index.files(ids(5000)) == []
    assert index.rows(ids(5000)).count() == 0 and index.rows(ids(5)).where("id = 5").first().x == 10
    spark.range(1000, 1100).withColumn("x", F.col("id") * 2).coalesce(1).write.mode("append").parquet(table)
    assert index.rows(ids(1050)).where("id = 1050").first().x == 2100 and index.refresh() == 0
    import os

    gone = index.files(ids(5))[0].removeprefix("file://")
    os.remove(gone)
    assert index.files(ids(5)) == [] and len(index.files(ids(1050))) == 1


# --- keyed tables ------------------------------------------------------------------


def test_keyed_table_writes_only_what_changes(spark, tmp_path):
    from rowtide.operators.changesets import KeyedTable

    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], "ts", buckets=16)
    t.create(spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(T0).cast("timestamp_ntz").alias("ts")))
    before = set(spark.read.parquet(t.path).inputFiles())
    touched = t.upsert(spark.createDataFrame([(3, "new"), (3, "newer"), (900, "new")], "k int, v string"), T0 + dt.timedelta(1))
    after = set(spark.read.parquet(t.path).inputFiles())
    rows = {r.k: (r.v, r.ts.day) for r in t.read().collect()}
    assert len(rows) == 501 and rows[3] == ("newer", 2) and rows[900] == ("new", 2) and rows[4] == ("old", 1)
    assert len(touched) <= 2 and len(before & after) == len(before) - len(touched)
    assert t.upsert(t.read().limit(0).drop("ts"), T0) == [] and set(spark.read.parquet(t.path).inputFiles()) == after
    t.upsert(t.read().where("k < 5").drop("ts"), T0)  # rows of the table itself
    assert t.read().count() == 501 and {r.ts.day for r in t.read().where("k < 5").collect()} == {1}


# --- publishing again, and subscriptions ----------------------------------------------


def test_a_batch_appears_as_a_whole(spark, tmp_path):
    topics = TopicFolder(str(tmp_path), create=True)
    topics.ensure(spark, "t")
    ok = spark.range(3).select(F.col("id").cast("string").cast("binary").alias("value"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))
    bad = ok.withColumn("value", F.when(F.rand() >= 0, F.raise_error(F.lit("no"))).cast("binary"))
    with pytest.raises(Exception):
        topics.publish(bad, "t", "one")
    assert topics.read(spark, "t").count() == 0 and [p.name for p in tmp_path.glob("t/*")] == []
    topics.publish(ok, "t", "one")
    topics.publish(ok.limit(2), "t", "one")
    topics.publish(ok, "t")
    assert topics.read(spark, "t").count() == 5


def test_message_ids(spark):
    from rowtide.streaming.envelope import message_id

    rows = spark.createDataFrame([(1, "1"), (11, ""), (1, None), (None, "1"), (1, "1")], "a int, b string").withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    ids = [r[0] for r in rows.select(message_id(TableRef("db", "t"), F.col("ts"), [F.col("a"), F.col("b")])).collect()]
    assert len(set(ids)) == 4 and ids[0] == ids[4] and rows.select(message_id(TableRef("db", "u"), F.col("ts"), [F.col("a"), F.col("b")])).first()[0] not in ids


def test_one_ready_topic(spark, tmp_path):
    from rowtide.streaming.envelope import Topic

    t = Table(spark)
    t.commit(1, (1, "a"))
    topics = TopicFolder(str(tmp_path), create=True)
    watch = lambda: TableWatcher(t, t.spec, MemoryPositionStore(start="earliest"))
    Publisher(watch(), topic=Topic(topics, "mine")).run_available()
    assert topics.read(spark, "mine").count() == 1
    for wrong in ({}, {"topics": topics}, {"topics": topics, "template": "t", "topic": Topic(topics, "mine")}, {"template": "t", "topic": Topic(topics, "mine")}):
        with pytest.raises(ValueError):
            Publisher(watch(), **wrong)


def test_subscriptions_have_places_of_their_own(spark, tmp_path):
    from rowtide.streaming.subscriber import Subscription

    topics = TopicFolder(str(tmp_path), create=True)
    with pytest.raises(TopicNotFound):
        Subscription(spark, topics, "t", "a", print)
    topics.ensure(spark, "t")
    message = lambda k: spark.range(k, k + 2).select(F.lit(b"x").alias("value"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"), F.col("id").cast("string").alias("message_id"))
    seen = {"a": [], "b": []}
    run = lambda name: Subscription(spark, topics, "t", name, lambda batch, k: seen[name].extend(sorted(r.message_id for r in batch.collect()))).run_available()
    run("a")  # nothing is there yet
    topics.publish(message(0), "t", "one")
    run("a")
    topics.publish(message(2), "t", "two")
    run("a")
    run("a")
    run("b")
    assert seen == {"a": ["0", "1", "2", "3"], "b": ["0", "1", "2", "3"]}
    topics.publish(message(0), "t", "one")  # sent again
    run("a")
    assert seen["a"] == ["0", "1", "2", "3", "0", "1"]


def test_unknown_schema_versions_raise(spark, tmp_path):
    from rowtide.streaming.envelope import read_as

    t = Table(spark)
    t.commit(1, (1, "a"))
    topics = TopicFolder(str(tmp_path), create=True)
    p = Publisher(TableWatcher(t, t.spec, MemoryPositionStore(start="earliest")), topics, "t")
    p.run_available()
    (version, schema), *_ = topics.schemas(spark, "t").items()
    messages = topics.read(spark, "t")
    assert read_as(messages, {version: schema}, schema).first().id == 1
    with pytest.raises(Exception, match="no schema of version"):
        read_as(messages, {"0" * 16: schema}, schema).collect()
    with pytest.raises(LookupError):
        read_as(messages, {}, schema)


# --- polls as a stream source -----------------------------------------------------------


def streamed(spark, table, at, ts="ts", start="earliest"):
    from rowtide.streaming.poll_source import poll_stream

    out = f"{at}/out"
    poll_stream(spark, table, ts, start).writeStream.format("parquet").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_stream_source_restarts(spark, tmp_path, kind):
    """The table grows, is rewritten, and has rows without a commit; each row of each commit comes once."""
    table = str(tmp_path / "t")

    def append(*rows):
        spark.createDataFrame([(i, None if day is None else T0 + dt.timedelta(days=day)) for i, day in rows], "id long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast(kind)).coalesce(1).write.mode("append").parquet(table)

    append((1, 1), (2, 2), (3, None))
    got = lambda start="earliest", name="a": sorted(r.id for r in streamed(spark, table, tmp_path / name, start=start).collect())
    assert got() == [1, 2]
    assert got() == [1, 2]
    append((4, 2), (5, 3))  # the second of one commit that was there comes too late, as in any poll
    append((6, 4))
    assert got() == [1, 2, 5, 6]
    assert got(start="2024-01-03T00:00:00", name="b") == [5, 6]
    append((7, None))
    assert got() == [1, 2, 5, 6]


def test_stream_source_opens_files_of_its_commits(spark, tmp_path):
    from rowtide.streaming.poll_source import PollReader

    for day in range(5):
        spark.range(3).withColumn("ts", F.lit(T0 + dt.timedelta(days=day)).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    reader = PollReader(str(tmp_path), "ts", "earliest")
    assert reader.latestOffset() == {"ts": "2024-01-05T00:00:00"}
    parts = reader.partitions({"ts": "2024-01-02T00:00:00"}, {"ts": "2024-01-04T00:00:00"})
    assert len(parts) == 2 and sum(b.num_rows for p in parts for b in reader.read(p)) == 6
    (nothing,) = reader.partitions({"ts": "2024-01-05T00:00:00"}, {"ts": "2024-01-05T00:00:00"})
    assert list(reader.read(nothing)) == []
    assert PollReader(str(tmp_path), "ts", "2025-01-01").latestOffset() == {"ts": "2025-01-01T00:00:00"}


# --- tables in folders by time bucket ------------------------------------------------


@pytest.mark.parametrize("encoded", [True, False])
def test_a_bucketed_poll_opens_its_folders(spark, tmp_path, encoded):
    from rowtide.operators import poll, shards

    table = shards.BucketedTable(spark, str(tmp_path / "t"), "ts", "HOUR_OF_DAY", encoded=encoded)
    rows = spark.range(48).select("id", (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    table.write(rows)
    table.write(rows.where("id = 0").withColumn("id", F.lit(100).cast("long")))
    spec = TableSpec(TableRef("db", "t"), "ts", ("id",))
    found = poll.changes(table.read(), spec, shard=table.shard(T0.replace(minute=0, second=20)))
    assert sorted(r.id for r in found.collect()) == [0, 23, 24, 47, 100]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    late = poll.changes(table.read(), spec, shard=table.shard(T0.replace(hour=5), since=T0.replace(hour=2)))
    assert {r.ts.hour for r in late.collect()} == {2, 3, 4, 5}


def test_catalog_of_frames(spark):
    from rowtide.sources.catalog import Selection, TableNotFound, described
    from rowtide.sources.types import field
    from pyspark.sql import types as T

    tables = {"a": spark.createDataFrame([], T.StructType([field("id", "INT64", False), field("at", "TIMESTAMP", True, True), field("tags", "ARRAY<STRING(9)>")])), "b": spark.range(1)}
    about = described(tables, {"a": ("id",)}, database="db")
    (spec,) = about.specs(Selection.all_tables())
    assert (spec.ref.table, spec.commit_ts, spec.primary_key) == ("a", "at", ("id",))
    assert [tuple(r) for r in about.columns.where("table = 'a'").select("column", "type", "nullable").collect()] == [("id", "INT64", False), ("at", "TIMESTAMP", True), ("tags", "ARRAY<STRING>", True)]
    with pytest.raises(TableNotFound):
        about.specs(Selection.include("b"))


def test_change_sets_of_a_database_with_keys_and_indexes(spark, tmp_path):
    from rowtide.sources.catalog import described
    from rowtide.sources.file_index import FileIndex

    sets = spark.createDataFrame([(f"s{k}", T0 + dt.timedelta(hours=k)) for k in range(4)], "change_set_id string, ts timestamp_ntz")
    data = spark.range(40).select((39 - F.col("id")).alias("k"), F.concat(F.lit("s"), F.floor(F.col("id") / 10)).alias("change_set_id"))
    data.repartitionByRange(4, "change_set_id").write.parquet(str(tmp_path / "a"))
    tables = {"sets": sets, "a": spark.read.parquet(str(tmp_path / "a")), "b": data.where("k < 15")}
    about = described(tables, {"sets": ("change_set_id",)}, lambda t, f: f.name == "ts", "db")
    index = FileIndex(spark, str(tmp_path / "a"), str(tmp_path / "i"), "change_set_id")
    w = DatabaseWatcher.over_change_sets(
        about, Selection.all_tables(), lambda ref: tables[ref.table], TableSpec(TableRef("db", "sets"), "ts", ("change_set_id",)), keys={"a": ("k",), "b": ("k",)}, indexes={"a": index}, positions=MemoryPositionStore(start="earliest"), limit=2
    )
    seen = []
    w.on_row(lambda table, row, ts: seen.append((table.table, ts.hour, row.k)))
    w.run_available()
    expected = sorted((r.change_set_id, r.k) for r in data.collect())
    assert [(f"s{h}", k) for t, h, k in seen if t == "a"] == expected and [(f"s{h}", k) for t, h, k in seen if t == "b"] == [x for x in expected if x[1] < 15]
