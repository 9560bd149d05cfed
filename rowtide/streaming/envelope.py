"""Changes as messages: payload, attributes and topic; and messages as archived objects."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions.avro_codec import avro_decoded, fingerprint
from rowtide.functions.text import timestamp_text
from rowtide.model import TableRef
from rowtide.sources.shared import Folder

#: The attribute with the fingerprint of the schema that wrote a message.
VERSION = "SchemaVersion"
PLACEHOLDERS = ("project", "instance", "database", "catalog", "schema", "table")


def topic_name(template: str, ref: TableRef, project: str = "", instance: str = "") -> str:
    values = dict(zip(PLACEHOLDERS, (project, instance, ref.database, ref.catalog, ref.schema, ref.table)))
    for k, v in values.items():
        template = template.replace(f"%{k}%", v)
    return template


def topic_column(template: str, **values: Column) -> Column:
    """The topic by columns, for a frame with changes of several tables."""
    out = F.lit(template)
    for k in PLACEHOLDERS:
        out = F.replace(out, F.lit(f"%{k}%"), F.coalesce(values.get(k, F.lit("")), F.lit("")))
    return out


def attributes(ref: TableRef, ts: Column, version: str | None = None) -> Column:
    """The five attributes of a message, and that which names the version of its schema, if it has one."""
    pairs = {"Database": ref.database, "Catalog": ref.catalog, "Schema": ref.schema, "Table": ref.table} | ({VERSION: version} if version else {})
    known = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*known, F.lit("Timestamp"), timestamp_text(ts))


def envelope(df: DataFrame, ref: TableRef, ts: str, converter: Any, topic: str, columns: list[str] | None = None, keep: Sequence[Column] = (), version: str | None = None) -> DataFrame:
    """topic, value, attributes and what is to be kept of every changed row."""
    columns = columns or df.columns
    return df.select(F.lit(topic).alias("topic"), converter.encode(df, columns).alias("value"), attributes(ref, F.col(ts), version).alias("attributes"), *keep)


def message_id(ref: TableRef, ts: Column, key: Sequence[Column]) -> Column:
    """A name that a change has however often it is sent: of its table, key and commit timestamp."""
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (ts, *key)]
    parts = [F.concat(F.length(t).cast("string"), t) for t in (F.lit(ref.full_name), *told)]
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 32)


class TopicNotFound(LookupError):
    pass


MESSAGE = "value binary, attributes map<string,string>, message_id string"


class TopicFolder:
    """Topics as folders below a path, with a folder of Parquet files for each batch of messages.

    A batch is written aside and becomes visible by one rename.  One of a name that is
    there already is put in its place, so what is sent again after a failure is there once.
    """

    def __init__(self, path: str, create: bool = False):
        self.path, self.create = path, create

    def folder(self, topic: str) -> str:
        return f"{self.path}/{topic.replace('/', '~')}"

    def exists(self, df_or_spark: Any, topic: str) -> bool:
        spark = getattr(df_or_spark, "sparkSession", df_or_spark)
        where = spark._jvm.org.apache.hadoop.fs.Path(self.folder(topic))
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def ensure(self, spark: Any, topic: str) -> None:
        """Raises unless the topic exists or may be created."""
        if self.exists(spark, topic):
            return
        if not self.create:
            raise TopicNotFound(topic)
        where = spark._jvm.org.apache.hadoop.fs.Path(self.folder(topic))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def publish(self, messages: DataFrame, topic: str, batch: str | None = None) -> None:
        """Adds a batch of messages, which have ids of their own or get new ones, to a topic."""
        if not self.exists(messages, topic):
            raise TopicNotFound(topic)
        folder = Folder(messages.sparkSession, self.folder(topic))
        sent = messages if "message_id" in messages.columns else messages.withColumn("message_id", F.uuid())
        aside, name = f"_aside-{uuid.uuid4().hex}", f"b-{batch or uuid.uuid4().hex}"
        try:
            sent.select("value", "attributes", "message_id").write.parquet(f"{folder.path}/{aside}")
            folder.replace(aside, name)
        finally:
            folder.delete(aside)

    def keep_schema(self, spark: Any, topic: str, schema_json: str) -> str:
        """Puts a schema where subscribers look it up; returns its fingerprint."""
        version = fingerprint(schema_json)
        folder = Folder(spark, f"{self.folder(topic)}/_schemas")
        folder.make()
        if not folder.exists(f"{version}.json"):
            folder.create(f"{version}.json", schema_json)
        return version

    def schemas(self, spark: Any, topic: str) -> dict[str, str]:
        """The schemas of a topic's messages by fingerprint."""
        folder = Folder(spark, f"{self.folder(topic)}/_schemas")
        return {n.removesuffix(".json"): folder.read(n) for n in folder.names() if n.endswith(".json") and not n.startswith(".")}

    def read(self, spark: Any, topic: str) -> DataFrame:
        folder = Folder(spark, self.folder(topic))
        batches = [f"{folder.path}/{n}" for n in folder.names() if n.startswith("b-")]
        return spark.read.schema(MESSAGE).parquet(*batches) if batches else spark.createDataFrame([], MESSAGE)


class Topic:
    """One topic of a folder, ready to be published to."""

    def __init__(self, topics: TopicFolder, name: str):
        self.topics, self.name = topics, name


def read_as(messages: DataFrame, schemas: dict[str, str], reader_json: str) -> DataFrame:
    """``subscribe`` for Avro messages of any of these versions, by the fields of one schema.

    A message whose version is not known, or null, makes the read fail.
    """
    a = F.col("attributes")
    version = a[VERSION]
    if not schemas:
        raise LookupError("no schemas are known")
    # Each version's decoder sees its own messages alone.
    row = F.coalesce(*[avro_decoded(F.when(version == name, F.col("value")), schema, reader_json) for name, schema in schemas.items()])
    unknown = F.raise_error(F.concat(F.lit("no schema of version "), F.coalesce(version, F.lit("null"))))
    known = F.when(F.coalesce(version.isin(*schemas), F.lit(False)), row).otherwise(unknown)
    return messages.select(a["Database"].alias("_database"), a["Table"].alias("_table"), a["Timestamp"].alias("_timestamp"), known.alias("row")).select("_database", "_table", "_timestamp", "row.*")


def subscribe(messages: DataFrame, converter: Any, schema: Any) -> DataFrame:
    """Attributes and decoded fields of received messages."""
    a = F.col("attributes")
    return messages.select(
        a["Database"].alias("_database"),
        a["Table"].alias("_table"),
        a["Timestamp"].alias("_timestamp"),
        converter.decode(F.col("value"), schema).alias("row"),
    ).select("_database", "_table", "_timestamp", "row.*")


# --- archive -----------------------------------------------------------------------


def object_path(a: Column, event_id: Column) -> Column:
    """database/[catalog-][schema-]table-timestamp-event; empty or missing parts are left out."""
    part = lambda k: F.when(F.coalesce(a[k], F.lit("")) != "", F.concat(a[k], F.lit("-"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(a["Database"], F.lit("")), F.lit("/"), part("Catalog"), part("Schema"), F.coalesce(a["Table"], F.lit("")), F.lit("-"), F.coalesce(a["Timestamp"], F.lit("")), F.lit("-"), event_id)


def to_archive(messages: DataFrame, event_id: Column) -> DataFrame:
    """path, value and attributes of each message to be archived; replayed ones are skipped."""
    a = F.col("attributes")
    fresh = messages.where(~F.coalesce(a["Replay"] == "True", F.lit(False)))
    return fresh.select(object_path(a, event_id).alias("path"), "value", F.map_filter(a, lambda k, v: v.isNotNull()).alias("attributes"))


# Fixed value: what readers of the archive expect.
CONTENT_TYPE = "protobuf/bytes"


def write_archive(objects: DataFrame, root: str | None = None) -> int:
    """One file for each message and a ``.meta`` file with its attributes; returns how many.

    Without ``root`` the folder is that of the environment variable BUCKET_NAME.  Tasks
    write through ``pyarrow.fs``, each object under a passing name that is then renamed.
    """
    root = root or os.environ.get("BUCKET_NAME")
    if not root:
        raise ValueError("no value for BUCKET_NAME")

    def run(batches):
        import json

        import pyarrow as pa
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{top}/{r['path']}"
                system.create_dir(name.rpartition("/")[0], recursive=True)
                meta = {"contentType": CONTENT_TYPE, "metadata": dict(r["attributes"] or ())}
                for last, data in ((name, r["value"] or b""), (f"{name}.meta", json.dumps(meta).encode())):
                    passing = f"{last}.{uuid.uuid4().hex}"
                    with system.open_output_stream(passing) as out:
                        out.write(data)
                    system.move(passing, last)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return objects.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: The folder of packs, and what a row of one has: the content of an object and the text of its ``.meta`` file.
PACKS = "_packs"
PACKED = "path string, content binary, meta string, pack string"


def pack_archive(objects: DataFrame, root: str | None = None, pack: str | None = None) -> None:
    """As ``write_archive``, with the objects as rows of Parquet files instead of two files each.

    A loose object takes two blocks of a disk, however small it is.  A pack becomes visible
    by one rename; one of a name that is there is put in its place.  Of an object that
    several packs have, that of the last name counts.
    """
    root = root or os.environ.get("BUCKET_NAME")
    if not root:
        raise ValueError("no value for BUCKET_NAME")
    name = pack or uuid.uuid4().hex
    none = F.create_map().cast("map<string,string>")
    meta = F.to_json(F.struct(F.lit(CONTENT_TYPE).alias("contentType"), F.coalesce("attributes", none).alias("metadata")))
    rows = objects.select("path", F.coalesce("value", F.lit(b"")).alias("content"), meta.alias("meta"), F.lit(name).alias("pack"))
    folder, aside = Folder(objects.sparkSession, f"{root}/{PACKS}"), f"_aside-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{folder.path}/{aside}")
        folder.replace(aside, f"p-{name}")
    finally:
        folder.delete(aside)


def packed(spark: Any, root: str) -> DataFrame:
    """path, content, meta and pack of every packed object, once for each pack that has it."""
    folder = Folder(spark, f"{root}/{PACKS}")
    packs = [f"{folder.path}/{n}" for n in folder.names() if n.startswith("p-")]
    return spark.read.schema(PACKED).parquet(*packs) if packs else spark.createDataFrame([], PACKED)


def read_packed(paths: DataFrame, root: str) -> DataFrame:
    """As ``read_archive``, for packed objects; a path that no pack has makes the read fail."""
    last = packed(paths.sparkSession, root).groupBy("path").agg(F.max_by(F.struct("content", "meta"), "pack").alias("object"))
    missing = F.raise_error(F.concat(F.lit("no object "), F.coalesce("path", F.lit("null"))))
    found = paths.select("path").join(last, "path", "left").withColumn("object", F.when(F.col("object").isNull(), missing).otherwise(F.col("object")))
    metadata = F.from_json("object.meta", "metadata map<string,string>")["metadata"]
    return found.select("path", F.col("object.content").alias("content"), metadata.alias("attributes"))


def read_archive(paths: DataFrame, root: str) -> DataFrame:
    """path, content and attributes of the archived messages that the column ``path`` names."""

    def run(batches):
        import json

        import pyarrow as pa
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{top}/{path}") as file, system.open_input_stream(f"{top}/{path}.meta") as meta:
                    found.append((path, file.read(), list(json.loads(meta.read())["metadata"].items())))
            columns = zip(*found) if found else ((), (), ())
            types = (pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "content", "attributes"])

    return paths.select("path").mapInArrow(run, "path string, content binary, attributes map<string,string>")
