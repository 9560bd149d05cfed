"""Which files of a table hold rows of an id: lookups that read only those.

The index is a table of the distinct (id, file) pairs, in folders by a hash of the id,
so a lookup reads some folders of it and then the files that they name; its cost grows
with what is asked for, not with the table.  It is brought up to date by reading the
files that it has not seen, and none again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.sources.shared import Folder

BUCKETS = 256


class FileIndex:
    """An index of the Parquet table at ``table``, itself kept at ``path``, by ``column``.

    Files are taken to be written once; of files that vanished nothing is read any more.
    Several drivers may refresh at once: pairs found twice count once.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, column: str, buckets: int = BUCKETS):
        self.spark, self.table, self.path, self.column, self.buckets = spark, table, path, column, buckets

    def listing(self) -> list[str]:
        return self.spark.read.parquet(self.table).inputFiles()

    def _known(self) -> set[str]:
        if not Folder(self.spark, f"{self.path}/files").exists():
            return set()
        return {r.file for r in self.spark.read.parquet(f"{self.path}/files").select("file").distinct().collect()}

    def refresh(self) -> int:
        """Takes new files in; returns how many."""
        known = self._known()
        new = [f for f in self.listing() if f not in known]
        if not new:
            return 0
        ids = self.spark.read.option("basePath", self.table).parquet(*new).select(F.col(self.column).alias("id"), F.input_file_name().alias("file"))
        pairs = ids.where("id is not null").distinct().withColumn("bucket", self._bucket("id"))
        pairs.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/pairs")
        # Named last, so that files whose pairs were only half written are read again.
        self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{self.path}/files")
        return len(new)

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def files(self, ids: DataFrame) -> list[str]:
        """The files with rows of ``ids``, a frame of one column that is known to be small: the batch of a poll."""
        if not Folder(self.spark, f"{self.path}/pairs").exists():
            return []
        kind = self.spark.read.parquet(f"{self.path}/pairs").schema["id"].dataType
        asked = ids.select(F.col(ids.columns[0]).cast(kind).alias("id")).where("id is not null").distinct().withColumn("bucket", self._bucket("id"))
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
        pairs = self.spark.read.parquet(f"{self.path}/pairs").where(F.col("bucket").isin(buckets))
        found = {r.file for r in pairs.join(F.broadcast(asked.select("id")), "id", "left_semi").select("file").distinct().collect()}
        return sorted(found & set(self.listing()))

    def rows(self, ids: DataFrame) -> DataFrame:
        """The table as it is in the files with rows of ``ids``, after a refresh; other rows of these files are there too."""
        self.refresh()
        whole = self.spark.read.parquet(self.table)
        files = self.files(ids)
        return self.spark.read.schema(whole.schema).option("basePath", self.table).parquet(*files) if files else whole.limit(0)
