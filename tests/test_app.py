import datetime as dt
import importlib.util
import json
from pathlib import Path

import pytest
from where import ROOT, SF

from rowtide import app
from rowtide.config import Config
from rowtide.sources.catalog import TableNotFound
from rowtide.sources.positions import MemoryPositionStore, TablePositionStore
from rowtide.streaming.envelope import TopicNotFound

SINCE = dt.datetime(1998, 7, 1)


@pytest.fixture
def source(tmp_path):
    for name in ("orders", "events", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    about = {"orders": {"commit_ts": "o_orderdate", "primary_key": ["o_orderkey"]}, "events": {"commit_ts": "ts", "primary_key": ["event_id"]}, "nation": {}}
    (tmp_path / "tables.json").write_text(json.dumps(about))
    return tmp_path


def config(source, **more):
    base = {"source.path": str(source), "source.database": "db", "topics.nameFormat": "%database%-%table%", "topics.path": str(source / "topics"), "topics.create": "true", "topics.converter": "json"}
    return Config.read({f"rowtide.{k}": v for k, v in (base | more).items()})


def test_publishes_what_is_selected(spark, source):
    p = app.publisher(spark, config(source, **{"source.excludedTables": "events"}), MemoryPositionStore(SINCE))
    p.run_available()
    orders = spark.read.parquet(f"{SF}/orders.parquet").where(f"o_orderdate > timestamp_ntz'{SINCE}'")
    assert p.topics.read(spark, "db-orders").count() == orders.count() > 0
    assert sorted(f.name for f in (source / "topics").iterdir()) == ["db-orders"]


def test_unsuitable_tables(spark, source):
    assert {w.spec.ref.table for w in app.publisher(spark, config(source)).parts} == {"orders", "events"}
    for names in ("nation", "orders,absent"):
        with pytest.raises(TableNotFound):
            app.publisher(spark, config(source, **{"source.includedTables": names}))


def test_a_new_driver_goes_on_where_the_last_ended(spark, source):
    only = {"source.includedTables": "orders"}
    store = lambda: TablePositionStore(spark, str(source / "kept"), SINCE)
    first = app.publisher(spark, config(source, **only), store())
    first.run_available()
    n = first.topics.read(spark, "db-orders").count()
    again = app.publisher(spark, config(source, **only), store())
    again.run_available()
    assert again.topics.read(spark, "db-orders").count() == n > 0


def test_archives_topics(spark, source, monkeypatch):
    """What the publisher sent is archived once, in two runs; a bucket must be named, and a topic be there."""
    p = app.publisher(spark, config(source, **{"source.includedTables": "orders"}), MemoryPositionStore(SINCE))
    p.run_available()
    monkeypatch.delenv("BUCKET_NAME", raising=False)
    with pytest.raises(ValueError):
        app.archive(spark, p.topics, ["db-orders"])
    monkeypatch.setenv("BUCKET_NAME", str(source / "bucket"))
    with pytest.raises(TopicNotFound):
        app.archive(spark, p.topics, ["db-events"])
    for _ in range(2):
        app.archive(spark, p.topics, ["db-orders"])
    objects = [f for f in (source / "bucket/db").iterdir() if f.suffix not in (".meta", ".crc")]
    assert len(objects) == p.topics.read(spark, "db-orders").count() > 0


def test_samples(spark, tmp_path, capsys):
    found = importlib.util.spec_from_file_location("samples", Path(ROOT, "examples/samples.py"))
    samples = importlib.util.module_from_spec(found)
    found.loader.exec_module(samples)
    samples.one_table(spark, SF)
    samples.change_sets(spark, str(tmp_path / "sets"))
    samples.errors(spark, SF)
    samples.publish_and_read(spark, SF, str(tmp_path / "topics"))
    topics = samples.TopicFolder(str(tmp_path / "topics"))
    samples.follow_and_archive(spark, topics, "db-orders", str(tmp_path / "archive"))
    samples.newer_schema(spark, topics, "db-orders", next(iter(topics.schemas(spark, "db-orders").values())))
    samples.as_a_stream(spark, SF, str(tmp_path / "stream"))
    assert len(list(tmp_path.glob("archive/db/*.meta"))) == spark.read.parquet(str(tmp_path / "stream/out")).count() > 0
    samples.own_store(spark, SF)
    samples.stored_positions(spark, SF, str(tmp_path / "p"))
    said = capsys.readouterr().out
    assert "orders 1998-07-" in said and "data " in said and "failed:" in said and "position orders" in said
