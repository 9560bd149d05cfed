"""Publishers: watchers whose batches become messages of topics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.functions.avro_codec import AvroConverter
from rowtide.model import TableRef
from rowtide.streaming.envelope import Topic, TopicFolder, envelope, message_id, topic_name
from rowtide.streaming.watcher import DatabaseWatcher, State, TableWatcher


class Publisher:
    """Publishes every batch of a watcher that has not been started, many at once while it is behind.

    A batch, or a run of them, becomes visible as a whole, before its position is stored.  It is named by
    where it begins, and its messages by table, key and commit timestamp; so a batch that
    is read again after a failure replaces what was sent, and subscribers find each id
    once.  (A row that has changed in between comes in its new version alone.)  An error in
    publishing fails the watcher.  Each table has a converter of its own, made by
    ``converter`` when its first batch comes.

    Messages go to the topics that ``template`` names, or all of them to one ``topic``.
    """

    def __init__(
        self,
        watcher: TableWatcher | DatabaseWatcher,
        topics: TopicFolder | None = None,
        template: str | None = None,
        converter: Callable[[], Any] = AvroConverter,
        project: str = "",
        instance: str = "",
        topic: Topic | None = None,
    ):
        if watcher.state is not State.NEW:
            raise RuntimeError("the watcher has been started")
        if (topic is None) == (topics is None or template is None) or (topic is not None and (topics or template)):
            raise ValueError("either a topic, or topics and a template")
        self.watcher, self.topics, self.template, self.converter = watcher, topic.topics if topic else topics, template, converter
        self.project, self.instance, self.ready = project, instance, topic
        self.converters: dict[TableRef, Any] = {}
        #: Get (table, frame of ts and message_id) of every batch that is published.
        self.on_published: list[Callable[[TableRef, DataFrame], None]] = []
        #: Get (table, frame of ts and message_id, error) of every batch that could not be published.
        self.on_unpublished: list[Callable[[TableRef, DataFrame, Exception], None]] = []
        #: The same for single messages, for few of them: (table, commit timestamp, message id), (table, commit timestamp, error).
        self.on_success: list[Callable[[TableRef, Any, str], None]] = []
        self.on_failure: list[Callable[[TableRef, Any, Exception], None]] = []
        self.parts = watcher.watchers if isinstance(watcher, DatabaseWatcher) else [watcher]
        watcher.on_run(self._publish)
        prepare = watcher.prepare

        def checked() -> None:
            prepare()
            for w in self.parts:
                self.topics.ensure(w.table().sparkSession, self.topic(self._ref(w)))

        watcher.prepare = checked

    @staticmethod
    def _ref(w: TableWatcher) -> TableRef:
        return getattr(w, "ref", w.spec.ref)

    def topic(self, ref: TableRef) -> str:
        return self.ready.name if self.ready else topic_name(self.template, ref, self.project, self.instance)

    def _publish(self, ref: TableRef, batch: DataFrame, position: Any) -> None:
        w = next(w for w in self.parts if self._ref(w) == ref)
        ts = "_commit_ts" if "_commit_ts" in batch.columns else w.spec.commit_ts
        columns = [c for c in batch.columns if c != "_commit_ts"]
        if ref not in self.converters:
            self.converters[ref] = made = self.converter()
            if hasattr(made, "start"):
                made.start(batch, columns, ref.table)
        # Rows that come by change sets have the key of their table, or else all their columns.
        key = w.spec.primary_key if ts == w.spec.commit_ts else getattr(w, "key", ()) or columns
        name = message_id(ref, F.col(ts), [F.col(f"`{c}`") for c in key]).alias("message_id")
        made, topic = self.converters[ref], self.topic(ref)
        schema = getattr(made, "json", None)
        sent = batch.select(F.col(ts).alias("ts"), name)
        in_order = batch.orderBy(ts, *(() if key is columns else key)).select(F.col(ts).alias("ts"), name)
        shard = w.shard_of()
        begins = hashlib.sha256(repr((ref.full_name, shard.position_value if shard else None, w.position)).encode()).hexdigest()[:32]
        try:
            version = self.topics.keep_schema(batch.sparkSession, topic, schema) if schema and self.topics.exists(batch, topic) else None
            self.topics.publish(envelope(batch, ref, ts, made, topic, columns, keep=[name], version=version), topic, begins)
        except Exception as error:
            for told in self.on_unpublished:
                told(ref, sent, error)
            for row in in_order.toLocalIterator() if self.on_failure else ():
                for told in self.on_failure:
                    told(ref, row["ts"], error)
            raise
        for told in self.on_published:
            told(ref, sent)
        for row in in_order.toLocalIterator() if self.on_success else ():
            for told in self.on_success:
                told(ref, row["ts"], row["message_id"])

    def start(self) -> Publisher:
        self.watcher.start()
        return self

    def run_available(self) -> None:
        self.watcher.run_available()

    def stop(self, seconds: float = 10) -> None:
        self.watcher.stop()
        self.watcher.wait(seconds)
