"""Stores of positions, one for each table and shard value."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import fcntl
import hashlib
import json
import os
import tempfile
import threading
from abc import ABC, abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.model import EARLIEST, Position, TableRef
from rowtide.sources.catalog import TableNotFound
from rowtide.sources.shared import Folder

#: One row a position; a shard value is told apart by its type, so 1,2 as text and as numbers differ.
SCHEMA = (
    "database string not null, catalog string not null, `schema` string not null, `table` string not null,"
    "shard_type string not null, shard_value string not null, last_seen timestamp_ntz not null, last_key string"
)


def value_text(v: Any) -> str:
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    return str(v)


def shard_key(value: Any) -> tuple[str, str]:
    """(type tag, text) of a shard value.  Lists join their elements by commas, strings and bytes in base64."""
    if value is None:
        return ("none", "")
    if isinstance(value, (list, tuple)):
        kinds = {type(v).__name__ for v in value if v is not None}
        parts = [value_text(v.encode() if isinstance(v, str) else v) for v in value if v is not None]
        return (f"array<{'/'.join(sorted(kinds))}>", ",".join(parts))
    return (type(value).__name__, value_text(value))


def split_shards(value: Any) -> list:
    """A list's scalars, each once, nulls left out; a scalar is its own list."""
    if value is None:
        return []
    return [v for v in dict.fromkeys(value) if v is not None] if isinstance(value, (list, tuple)) else [value]


class PositionStore(ABC):
    """``start``: the position of what has none yet; ``"now"``, ``"earliest"`` or a timestamp.

    A store may be used by several threads.  ``_read`` gives a position and its version,
    and ``_write`` gives False if the version is not the last any more, so that writers in
    other processes are not undone either; what they wrote is then looked at again.
    """

    def __init__(self, start: Any = "now", clock=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)):
        self.start, self.clock, self.lock = start, clock, threading.RLock()

    def get(self, table: TableRef, shard: Any = None) -> Position:
        first = EARLIEST if self.start == "earliest" else Position(self.clock() if self.start == "now" else self.start)
        with self.lock:
            while True:
                found, version = self._read(table, shard_key(shard))
                if found is not None:
                    return found
                if first.ts is None or self._write(table, shard_key(shard), first, version) is not False:
                    return first

    def set(self, table: TableRef, position: Position, shard: Any = None) -> bool:
        """Stores a position that has advanced; refuses to go back.  False if it was there, or was reset meanwhile."""
        with self.lock:
            first = True
            while True:
                old, version = self._read(table, shard_key(shard))
                if old == position or (old is None and not first):
                    return False
                first = False
                if old is not None and not old <= position:
                    raise ValueError(f"position of {table.full_name} would go back from {old} to {position}")
                if self._write(table, shard_key(shard), position, version) is not False:
                    return True

    def reset(self, table: TableRef, shards: list | None = None) -> None:
        """Forgets the positions of some shard values, or of the unsharded table."""
        with self.lock:
            for s in shards if shards is not None else [None]:
                self._delete(table, shard_key(s))

    @abstractmethod
    def _read(self, table: TableRef, shard: tuple[str, str]) -> tuple[Position | None, int]: ...

    @abstractmethod
    def _write(self, table: TableRef, shard: tuple[str, str], position: Position, version: int) -> bool: ...

    @abstractmethod
    def _delete(self, table: TableRef, shard: tuple[str, str]) -> None: ...


class MemoryPositionStore(PositionStore):
    def __init__(self, start: Any = "now", **options):
        super().__init__(start, **options)
        self.rows: dict = {}

    def _read(self, table, shard):
        return self.rows.get((table, shard)), 0

    def _write(self, table, shard, position, version):
        self.rows[table, shard] = position
        return True

    def _delete(self, table, shard):
        self.rows.pop((table, shard), None)


def _pack(v: Any) -> list:
    if isinstance(v, dt.datetime):
        return ["ts", v.isoformat()]
    if isinstance(v, dt.date):
        return ["date", v.isoformat()]
    if isinstance(v, decimal.Decimal):
        return ["decimal", str(v)]
    if isinstance(v, (bytes, bytearray)):
        return ["bytes", base64.b64encode(v).decode()]
    return ["plain", v]


def _unpack(p: list) -> Any:
    kind, v = p
    by = {"ts": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": decimal.Decimal, "bytes": base64.b64decode}
    return by[kind](v) if kind in by else v


#: Fields of a stored position, their names unless others are chosen, and their types.
FIELDS = {
    "database": "string",
    "catalog": "string",
    "schema": "string",
    "table": "string",
    "shard_type": "string",
    "shard_value": "string",
    "last_seen": "timestamp_ntz",
    "last_key": "string",
}


class TablePositionStore(PositionStore):
    """A table of positions in a folder of shared storage, as Spark reads and writes it.

    Any number of drivers may use it, one after the other or at once.  Each position is a
    folder of versions, one JSON row each; the next version is made by renaming a whole
    file to a name that must be free, so of two writers one is refused and looks again.
    ``columns`` renames fields of FIELDS.  ``create`` allows the table to be made; one
    that is there must have these columns and types.
    """

    def __init__(self, spark: SparkSession, path: str, start: Any = "now", create: bool = True, table: str = "positions", columns: dict[str, str] | None = None, **options):
        super().__init__(start, **options)
        self.spark, self.columns = spark, {f: (columns or {}).get(f, f) for f in FIELDS}
        self.folder = Folder(spark, f"{path}/{table}")
        if not self.folder.exists("_columns.json"):
            if not create:
                raise TableNotFound(f"no table of positions at {self.folder.path}")
            self.folder.make()
            self.folder.create("_columns.json", json.dumps(self._shape()))
        self.verify()

    def _shape(self) -> dict[str, str]:
        return {self.columns[f]: kind for f, kind in FIELDS.items()}

    def verify(self) -> None:
        """Raises if the table has not the columns that positions need, or holds rows that are no positions."""
        there = json.loads(self.folder.read("_columns.json"))
        for name, kind in self._shape().items():
            if there.get(name) != kind:
                raise ValueError(f"{self.folder.path}: column {name} should be {kind} and is {there.get(name, 'missing')}")
        if not any(n.startswith("at=") for n in self.folder.names()):
            return
        needed = [f"`{self.columns[f]}`" for f in FIELDS if not f.startswith("last_")]
        shape = ", ".join(f"`{n}` string" for n in self._shape()) + ", version long, reset boolean, packed_ts array<string>, _broken string"
        rows = self.spark.read.schema(shape).option("columnNameOfCorruptRecord", "_broken").json(f"{self.folder.path}/at=*")
        seen = F.col(f"`{self.columns['last_seen']}`")
        lacking = reduce(Column.__or__, [F.col(n).isNull() for n in [*needed, "version"]])
        # Times that are no timestamps, numbers of a counter say, are kept packed alone.
        untimed = F.col("reset").isNull() & (F.col("packed_ts").isNull() | (seen.isNotNull() & seen.try_cast("timestamp_ntz").isNull()))
        wrong = rows.where(F.col("_broken").isNotNull() | lacking | untimed).select(F.input_file_name()).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0][0]} holds no position")

    @staticmethod
    def _name(table: TableRef, shard: tuple[str, str]) -> str:
        whole = json.dumps([table.database, table.catalog, table.schema, table.table, *shard])
        return f"at={hashlib.sha256(whole.encode()).hexdigest()}"

    def _read(self, table, shard):
        name = self._name(table, shard)
        versions = [n for n in self.folder.names(name) if not n.startswith(".")]
        if not versions:
            return None, 0
        row = json.loads(self.folder.read(f"{name}/{versions[-1]}"))
        if row.get("reset"):
            return None, row["version"]
        key = row.get(self.columns["last_key"])
        ts = _unpack(row["packed_ts"])
        return Position(ts, None if key is None else tuple(map(_unpack, json.loads(key)))), int(versions[-1].split(".")[0])

    def _write(self, table, shard, position, version):
        name = self._name(table, shard)
        seen = position.ts.isoformat() if isinstance(position.ts, (dt.datetime, dt.date)) else None
        values = (table.database, table.catalog, table.schema, table.table, *shard, seen, None if position.key is None else json.dumps([_pack(v) for v in position.key]))
        row = dict(zip(self.columns.values(), values)) | {"packed_ts": _pack(position.ts), "version": version + 1}
        if not self.folder.create(f"{name}/{version + 1:012d}.json", json.dumps(row)):
            return False
        for old in self.folder.names(name):
            if not old.startswith(".") and int(old.split(".")[0]) < version:
                self.folder.delete(f"{name}/{old}")
        return True

    def _delete(self, table, shard):
        """Leaves a last version without a position, so that a writer who read an earlier one is refused."""
        name = self._name(table, shard)
        while True:
            found, version = self._read(table, shard)
            if found is None:
                return
            row = dict(zip(list(self.columns.values())[:6], (table.database, table.catalog, table.schema, table.table, *shard)))
            if self.folder.create(f"{name}/{version + 1:012d}.json", json.dumps(row | {"version": version + 1, "reset": True})):
                return

    def frame(self) -> DataFrame:
        """The stored positions as a DataFrame, for gauges and joins."""
        names = self.columns.values()
        shape = ", ".join(f"`{n}` string" for n in names) + ", version long, reset boolean"
        if not any(n.startswith("at=") for n in self.folder.names()):
            return self.spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in self._shape().items()))
        rows = self.spark.read.schema(shape).json(f"{self.folder.path}/at=*")
        key = [F.col(f"`{n}`") for n in list(names)[:6]]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{n}`") for n in list(names)[6:]], "reset"), "version").alias("last")).select(*key, "last.*")
        last = last.where("reset is null")
        return last.select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in self._shape().items()])


class FilePositionStore(PositionStore):
    """A JSON file on the driver, replaced as a whole; ``create`` allows a first one to be made.

    It serves one driver that keeps its disk; see TablePositionStore for others.
    """

    def __init__(self, path: str, start: Any = "now", create: bool = True, **options):
        super().__init__(start, **options)
        self.path = path
        if not os.path.exists(path):
            if not create:
                raise FileNotFoundError(path)
            self._save([])
        self.verify()

    def verify(self) -> None:
        """Raises if the file does not hold positions of this shape."""
        for row in self._load():
            if len(row) != 4 or len(row[0]) != 4 or len(row[1]) != 2 or not all(isinstance(x, str) for x in [*row[0], *row[1]]):
                raise ValueError(f"{self.path} is no position table")
            _unpack(row[2])

    def _load(self) -> list:
        with open(self.path) as f:
            return json.load(f)

    def _save(self, rows: list) -> None:
        fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(fd, "w") as f:
            json.dump(rows, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, self.path)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """Keeps other processes of this machine from writing."""
        with open(f"{self.path}.lock", "w") as file:
            fcntl.flock(file, fcntl.LOCK_EX)
            yield

    @staticmethod
    def _key(table, shard):
        return [[table.database, table.catalog, table.schema, table.table], list(shard)]

    @staticmethod
    def _version(row: list | None) -> int:
        return 0 if row is None else hash(json.dumps(row))

    def _row(self, table, shard) -> list | None:
        return next((row for row in self._load() if row[:2] == self._key(table, shard)), None)

    def _read(self, table, shard):
        row = self._row(table, shard)
        if row is None:
            return None, 0
        return Position(_unpack(row[2]), None if row[3] is None else tuple(map(_unpack, row[3]))), self._version(row)

    def _write(self, table, shard, position, version):
        with self._alone():
            if self._version(self._row(table, shard)) != version:
                return False
            rows = [r for r in self._load() if r[:2] != self._key(table, shard)]
            self._save([*rows, [*self._key(table, shard), _pack(position.ts), None if position.key is None else [_pack(v) for v in position.key]]])
        return True

    def _delete(self, table, shard):
        with self._alone():
            self._save([r for r in self._load() if r[:2] != self._key(table, shard)])

    def frame(self, spark: SparkSession) -> DataFrame:
        """The stored positions as a DataFrame, for gauges."""
        rows = [(*r[0], *r[1], _unpack(r[2]), None if r[3] is None else json.dumps(r[3])) for r in self._load()]
        return spark.createDataFrame(rows, SCHEMA)
