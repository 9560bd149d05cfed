"""Polls as a streaming source: ``spark.readStream.format("rowtide_poll")``.

The stream's offset is a position, so its checkpoint takes the place of a position
store: each batch has the rows after the last offset up to the latest commit that the
table has when the batch is planned.  Where batches end is read from the statistics in
the files' footers; files without a commit in a batch are not opened, and of the others
each is a task, which skips row groups by the same statistics.

Options: ``path`` (a Parquet file or a folder of them, reached through ``pyarrow.fs``, so
by a path that driver and executors share), ``commit_ts``, and ``start``: ``earliest`` or
a timestamp.  As in any poll, rows without a commit timestamp are never seen, a commit
that appears later than one with a greater timestamp is passed over, and a batch that is
planned again after a failure has the rows as they are then.  There is no limit: a batch
takes all there is.  Timestamps without a zone of their own are taken as they stand, so
those that Spark wrote in the older form of Parquet are in UTC.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "rowtide_poll"


class FilePart(InputPartition):
    """A file, and the commits after ``low`` up to ``high`` that are wanted of it."""

    def __init__(self, file: str, low: str, high: str):
        super().__init__(file)
        self.file, self.low, self.high = file, low, high


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def moment(text: str, kind: pa.DataType) -> pa.Scalar:
    at = dt.datetime.fromisoformat(text)
    return pa.scalar(at.date() if pa.types.is_date(kind) else at, kind)


def micros(schema: pa.Schema) -> pa.Schema:
    """Timestamps of nanoseconds, which the older form of Parquet has, in Spark's microseconds."""
    return pa.schema([f.with_type(pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else f for f in schema])


class PollReader(DataSourceStreamReader):
    def __init__(self, path: str, commit_ts: str, start: str):
        self.path, self.commit_ts, self.start = path, commit_ts, start
        self.seen: dict[str, tuple] = {}

    def _files(self) -> list[str]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        # Names that begin so are not part of a table.
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and f.base_name[0] not in "._")

    def _range(self, system: fs.FileSystem, file: str) -> tuple[str, str] | None:
        """First and last commit of a file; None if it has none."""
        with system.open_input_file(file) as source:
            about = pq.ParquetFile(source)
            place = next(i for i in range(about.metadata.num_columns) if about.metadata.schema.column(i).path == self.commit_ts)
            old = about.metadata.schema.column(place).physical_type == "INT96"  # which has no statistics to read
            found = []
            for g in range(about.metadata.num_row_groups):
                seen = None if old else about.metadata.row_group(g).column(place).statistics
                if seen is not None and seen.has_min_max:
                    found += [seen.min, seen.max]
                elif seen is None or seen.null_count < about.metadata.row_group(g).num_rows:  # written without statistics
                    found += pc.min_max(about.read_row_group(g, columns=[self.commit_ts]).column(0)).as_py().values()
        said = [(v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())).replace(tzinfo=None).isoformat() for v in found if v is not None]
        return (min(said), max(said)) if said else None

    def _ranges(self) -> dict[str, tuple[str, str] | None]:
        """Of every file; footers are read side by side, and again only where the file has changed."""
        system, _ = opened(self.path)
        infos = {f.path: (f.size, f.mtime_ns) for f in system.get_file_info(self._files())}
        new = [f for f, at in infos.items() if self.seen.get(f, (None,))[0] != at]
        with ThreadPoolExecutor(16) as pool:
            self.seen |= {f: (infos[f], r) for f, r in zip(new, pool.map(lambda f: self._range(system, f), new))}
        self.seen = {f: self.seen[f] for f in infos}
        return {f: r for f, (_, r) in self.seen.items()}

    def initialOffset(self) -> dict:
        return {"ts": "" if self.start == "earliest" else dt.datetime.fromisoformat(self.start).isoformat()}

    def latestOffset(self) -> dict:
        return {"ts": max([*(r[1] for r in self._ranges().values() if r), self.initialOffset()["ts"]])}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        wanted = [f for f, r in self._ranges().items() if r and r[1] > start["ts"] and r[0] <= end["ts"]]
        # A batch without rows has no partition to make them.
        return [FilePart(f, start["ts"], end["ts"]) for f in wanted] or [FilePart("", "", "")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = opened(self.path)
        table = ds.dataset(partition.file, format="parquet", filesystem=system)
        kind, column = table.schema.field(self.commit_ts).type, ds.field(self.commit_ts)
        wanted = column <= moment(partition.high, kind)
        if partition.low:
            wanted = wanted & (column > moment(partition.low, kind))
        for batch in table.to_batches(filter=wanted):
            if batch.num_rows:
                yield batch.cast(micros(batch.schema), safe=False)


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        system, _ = opened(self.options["path"])
        with system.open_input_file(PollReader(self.options["path"], "", "")._files()[0]) as file:
            return from_arrow_schema(micros(pq.read_schema(file)), prefer_timestamp_ntz=True)

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options["path"], self.options["commit_ts"], self.options.get("start", "earliest"))


def poll_stream(spark: SparkSession, path: str, commit_ts: str, start: str = "earliest"):
    """The changes of a table as a stream; the query's checkpoint is the position."""
    # The classes travel whole: the process that plans a stream has none of the session's Python files.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PollSource)
    return spark.readStream.format(NAME).options(path=path, commit_ts=commit_ts, start=start).load()
