"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose executors are on this machine, gets a
    temporary folder; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="rowtide-")


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` as they are now, to be read more than once within the block.

    They are written to the checkpoint folder, so that a lost executor can't make Spark
    read them again from a table that has changed meanwhile, and deleted at the block's
    end.  A cluster without such a folder gets an error, as by ``shared_folder``.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    kept = rows.checkpoint(eager=True)
    try:
        yield kept
    finally:
        file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            Folder(rows.sparkSession, file.get()).delete()


#: Bytes of a row group of what is kept: small, so that many tasks can read what one task wrote.
ROW_GROUP = 8 << 20


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """As ``held``, for many rows: Parquet files in the checkpoint folder, of which a reader takes the columns it needs."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    folder = Folder(spark, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}")
    try:
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(folder.path)
        yield spark.read.schema(rows.schema).parquet(folder.path)
    finally:
        folder.delete()


class Folder:
    """Small files below ``path``, by whatever file system it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._made = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._made(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> Any:
        return self._made(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self.at(name))

    def make(self) -> None:
        self.system.mkdirs(self.at(""))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(name)))

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one of this name."""
        passing = self.at(f"{name.rpartition('/')[0]}/.{self.spark._jvm.java.util.UUID.randomUUID()}".lstrip("/"))
        stream = self.system.create(passing, False)
        stream.write(text.encode())
        stream.close()
        # Renames to a name that is taken fail, on HDFS as one step.
        if not self.exists(name) and self.system.rename(passing, self.at(name)):
            return True
        self.system.delete(passing, False)
        return False

    def replace(self, name: str, by: str) -> None:
        """Renames a file or folder, in place of what has the new name."""
        if self.exists(by):
            self.delete(by)
        if not self.system.rename(self.at(name), self.at(by)):
            raise OSError(f"{self.path}/{name} could not be renamed to {by}")

    def delete(self, name: str = "") -> None:
        self.system.delete(self.at(name), True)
