"""Subscribers: topics followed as streams, each from where it left off.

The batch folders of a topic are a file stream, and a subscription's place in it is a
Structured Streaming checkpoint beside the topics.  A batch is acknowledged when its
callback has returned; one whose callback fails is delivered again, to the same batch
id, when the subscription is started again.  A publisher that sends a batch again puts
new files in the place of the old: their messages may be delivered twice, with the ids
they had.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.streaming.envelope import MESSAGE, TopicFolder, TopicNotFound, pack_archive, to_archive, write_archive

#: Gets (messages, batch id); a batch id comes again with the same messages if the callback failed.
Received = Callable[[DataFrame, int], None]


class Subscription:
    """A named subscription of a topic; subscriptions of other names have their own place.

    ``max_files`` bounds what one batch takes.  Messages of a batch come once each.
    """

    def __init__(self, spark: SparkSession, topics: TopicFolder, topic: str, name: str, received: Received, max_files: int | None = None, keep: str = "3650d"):
        if not topics.exists(spark, topic):
            raise TopicNotFound(topic)
        self.spark, self.topics, self.topic, self.name, self.received = spark, topics, topic, name, received
        # Files that are older than ``keep``, against the newest, are forgotten, and never delivered if they come late.
        options = {"maxFileAge": keep, "ignoreMissingFiles": "true"} | ({"maxFilesPerTrigger": str(max_files)} if max_files else {})
        self.stream = spark.readStream.schema(MESSAGE).options(**options).parquet(f"{topics.folder(topic)}/b-*")

    @property
    def place(self) -> str:
        return f"{self.topics.path}/_subscriptions/{self.topic.replace('/', '~')}/{self.name}"

    def start(self, interval: str | None = None) -> Any:
        """Delivers what there is and ends, or, with an interval, looks for more that often."""
        writer = self.stream.writeStream.option("checkpointLocation", self.place).foreachBatch(lambda batch, k: self.received(batch.dropDuplicates(["message_id"]), k))
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def run_available(self) -> None:
        self.start().awaitTermination()


class Archiver(Subscription):
    """Archives a topic's messages below ``root``, an object for each message id; replayed messages are skipped.

    What is delivered twice is written to the same object, so each message is there once.
    With ``packs`` each batch's objects are rows of one pack, named by the batch id, instead
    of files of their own.
    """

    def __init__(self, spark: SparkSession, topics: TopicFolder, topic: str, root: str | None = None, name: str = "archive", packs: bool = False, **options):
        def take(batch: DataFrame, k: int) -> None:
            objects = to_archive(batch, F.col("message_id"))
            if packs:
                pack_archive(objects, root, f"{name}-{k:012d}")
            else:
                write_archive(objects, root)

        super().__init__(spark, topics, topic, name, take, **options)
