"""Rows as Avro binary (no container, no schema id), from the public Avro specification.

The schema is taken once from a DataFrame.  Encoding and decoding run Arrow batch by
batch and within it column by column, in numpy; what the JVM does best (timestamp, date
and decimal text) is done there first.  Arrays are decoded an element of all rows at a
time.  A message is read within its own bytes and to their end: a cut, longer or foreign
one raises.  Messages of another version of a schema are resolved by the rules of the
specification, writer's against reader's; a fingerprint tells which one wrote them.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowtide.functions.text import date_text, decimal_text, timestamp_text

# Fixed value: the namespace that consumers of these messages know.
NAMESPACE = "avroNamespace"


def primitive(kind: T.DataType) -> str:
    """Avro type of a scalar; dates, timestamps and decimals travel as text."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "long"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return "string"
    raise TypeError(f"type {kind.simpleString()} has no Avro form")


def avro_schema(schema: T.StructType, record: str, namespace: str = NAMESPACE) -> str:
    """The record schema: nullable scalars default to null, nullable arrays have no default."""
    fields = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            array = {"type": "array", "items": ["null", primitive(f.dataType.elementType)]}
            fields.append({"name": f.name, "type": ["null", array] if f.nullable else array})
        elif f.nullable:
            fields.append({"name": f.name, "type": ["null", primitive(f.dataType)], "default": None})
        else:
            fields.append({"name": f.name, "type": primitive(f.dataType)})
    return json.dumps({"type": "record", "name": record, "namespace": namespace, "fields": fields})


# --- binary form -----------------------------------------------------------------


def write_long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


# --- whole batches -----------------------------------------------------------------

#: The bytes of all rows behind each other, and how many each row has.
Pieces = tuple[np.ndarray, np.ndarray]


def varints(n: np.ndarray) -> Pieces:
    u = ((n << 1) ^ (n >> 63)).view(np.uint64)
    k = np.arange(10)
    parts = u[:, None] >> (7 * k).astype(np.uint64)
    lens = np.maximum(1, (parts > 0).sum(axis=1))
    raw = (parts & np.uint64(0x7F)).astype(np.uint8) | np.where(k < lens[:, None] - 1, 0x80, 0).astype(np.uint8)
    return raw[k < lens[:, None]], lens


def spots(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every row, ``lens`` of them."""
    return np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def woven(*pieces: Pieces) -> Pieces:
    """The pieces of each row behind each other."""
    total = sum(lens for _, lens in pieces)
    out, at = np.empty(int(total.sum()), np.uint8), np.cumsum(total) - total
    for data, lens in pieces:
        out[spots(at, lens)] = data
        at = at + lens
    return out, total


def encoded(kind: Any, column: pa.Array) -> Pieces:
    n = len(column)
    if isinstance(kind, list):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        data, lens = encoded(kind[1], column.drop_null())
        full = np.zeros(n, np.int64)
        full[there] = lens
        return woven((np.where(there, 2, 0).astype(np.uint8), np.ones(n, np.int64)), (data, full))
    if column.null_count:
        raise ValueError("null in a field that has no null")
    if kind == "long":
        return varints(column.cast(pa.int64()).to_numpy(zero_copy_only=False))
    if kind == "double":
        return np.ascontiguousarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), "<f8").view(np.uint8), np.full(n, 8)
    if kind == "boolean":
        return column.to_numpy(zero_copy_only=False).astype(np.uint8), np.ones(n, np.int64)
    if isinstance(kind, dict):
        lens = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        data, each = encoded(kind["items"], column.flatten())
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(lens)
        some = lens > 0
        counts, width = varints(lens[some])
        head = np.zeros(n, np.int64)
        head[some] = width
        return woven((counts, head), (data, upto[ends] - upto[ends - lens]), (np.zeros(n, np.uint8), np.ones(n, np.int64)))
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return woven(varints(np.diff(offsets)), (data, np.diff(offsets)))


def binary(kind: pa.DataType, data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Strings or bytes of the given lengths."""
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    made = pa.Array.from_buffers(kind, len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    made.validate(full=True)
    return made


class BadMessage(ValueError):
    """Bytes that the schema can't have written."""


def within(ok: np.ndarray) -> None:
    if not ok.all():
        raise BadMessage("a message ends inside a field, or holds none of this schema")


def read_longs(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        within(at[open_] < end[open_])
        b = data[at[open_]]
        u[open_] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        at[open_] += 1
        open_ = open_[b >= 0x80]
        if not len(open_):
            break
    within(np.full(1, not len(open_)))
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64), at


def branch_of(kind: list) -> tuple[int, Any]:
    """Where a union of null and one type has the null, and that type."""
    if len(kind) != 2 or "null" not in kind:
        raise TypeError(f"union {kind} is not of null and one type")
    return kind.index("null"), kind[1 - kind.index("null")]


def read_arrays(items: Any, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Blocks are followed in all rows at once, one element of each row at a time."""
    at, left, open_ = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
    rows, parts = [np.zeros(0, np.int64)], [pa.array([], to_arrow_type(spark_type(items)))]
    while len(open_):
        fresh = open_[left[open_] == 0]
        if len(fresh):
            n, ends = read_longs(data, at[fresh], end[fresh])
            sized = np.flatnonzero(n < 0)  # such a block says its size in bytes, too
            ends[sized] = read_longs(data, ends[sized], end[fresh[sized]])[1]
            at[fresh], left[fresh] = ends, np.abs(n)
            open_ = open_[left[open_] > 0]
            if not len(open_):
                break
        values, at[open_] = decoded(items, data, at[open_], end[open_])
        left[open_] -= 1
        rows.append(open_)
        parts.append(values)
    owner = np.concatenate(rows)
    flat = pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable")))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat), at


def decoded(kind: Any, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The field that begins at ``at`` in each row, which ends before ``end``, and where it ends."""
    if isinstance(kind, list):
        null, body_kind = branch_of(kind)
        branch, at = read_longs(data, at, end)
        within((branch == 0) | (branch == 1))
        there = np.flatnonzero(branch != null)
        body, ends = decoded(body_kind, data, at[there], end[there])
        at[there] = ends
        place = np.zeros(len(at), np.int64)
        place[there] = np.arange(len(there))
        return body.take(pa.array(place, mask=branch == null)), at
    if kind in ("long", "int"):
        n, at = read_longs(data, at, end)
        return pa.array(n), at
    if kind in ("double", "float"):
        width = 8 if kind == "double" else 4
        within(at + width <= end)
        return pa.array(data[at[:, None] + np.arange(width)].view(f"<f{width}").reshape(-1).astype(np.float64)), at + width
    if kind == "boolean":
        within(at < end)
        within(data[at] < 2)
        return pa.array(data[at] == 1), at + 1
    if isinstance(kind, dict):
        return read_arrays(kind["items"], data, at, end)
    n, at = read_longs(data, at, end)
    within((n >= 0) & (n <= end - at))
    return binary(pa.string() if kind == "string" else pa.binary(), data[spots(at, n)], n), at + n


# --- versions of a schema ----------------------------------------------------------

#: What a writer's type may be read as.
PROMOTED = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


def readable(writer: Any, reader: Any) -> bool:
    """Whether each value of ``writer`` that is not null can be read as ``reader``."""
    if isinstance(writer, list) or isinstance(reader, list):
        own = [branch_of(k)[1] if isinstance(k, list) else k for k in (writer, reader)]
        return readable(*own)
    if isinstance(writer, dict) and isinstance(reader, dict):
        return readable(writer["items"], reader["items"])
    return writer == reader or (isinstance(writer, str) and reader in PROMOTED.get(writer, ()))


def resolved(writer: Any, reader: Any, column: pa.Array) -> pa.Array:
    """A column that was decoded as ``writer`` in the form of ``reader``."""
    if not isinstance(reader, list) and column.null_count:
        raise BadMessage("null for a field that has none in the reader's schema")
    writer, reader = (branch_of(k)[1] if isinstance(k, list) else k for k in (writer, reader))
    if isinstance(reader, dict):
        items = resolved(writer["items"], reader["items"], column.flatten())
        lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets), items)
        return made if not column.null_count else made.take(pa.array(np.arange(len(column)), mask=column.is_null().to_numpy(zero_copy_only=False)))
    return column.cast(to_arrow_type(spark_type(reader)))


def plan_fields(writer: list[dict], reader: list[dict]) -> list[tuple[dict, int | None]]:
    """For each field of the reader where the writer has it, by name or alias; None is to be filled by its default."""
    at = {f["name"]: i for i, f in enumerate(writer)}
    found = []
    for f in reader:
        i = next((at[n] for n in (f["name"], *f.get("aliases", ())) if n in at), None)
        if i is None and "default" not in f:
            raise TypeError(f"field {f['name']} is not in the writer's schema and has no default")
        if i is not None and not readable(writer[i]["type"], f["type"]):
            raise TypeError(f"field {f['name']}: {writer[i]['type']} cannot be read as {f['type']}")
        found.append((f, i))
    return found


def canonical(kind: Any, namespace: str = "") -> str:
    """The parsing canonical form of the specification, for the schemas that there are here."""
    if isinstance(kind, str):
        return json.dumps(kind)
    if isinstance(kind, list):
        return f"[{','.join(canonical(k, namespace) for k in kind)}]"
    if kind["type"] == "array":
        return f'{{"type":"array","items":{canonical(kind["items"], namespace)}}}'
    if kind["type"] != "record":
        return canonical(kind["type"], namespace)
    space = kind.get("namespace", namespace)
    name = kind["name"] if "." in kind["name"] or not space else f"{space}.{kind['name']}"
    fields = ",".join(f'{{"name":{json.dumps(f["name"], ensure_ascii=False)},"type":{canonical(f["type"], space)}}}' for f in kind["fields"])
    return f'{{"name":{json.dumps(name, ensure_ascii=False)},"type":"record","fields":[{fields}]}}'


# Fixed value: the fingerprint of nothing, and the polynomial, of the specification's CRC-64.
EMPTY = 0xC15D213AA4D7A795


def fingerprint(schema_json: str) -> str:
    """CRC-64-AVRO of the canonical form, in hexadecimal."""
    fp = EMPTY
    for byte in canonical(json.loads(schema_json)).encode():
        low = (fp ^ byte) & 0xFF
        for _ in range(8):
            low = (low >> 1) ^ (EMPTY if low & 1 else 0)
        fp = (fp >> 8) ^ low
    return f"{fp:016x}"


# --- columns -----------------------------------------------------------------------


def _travelling(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _travelling(x, kind.elementType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(kind, T.DateType):
        return date_text(c)
    if isinstance(kind, T.DecimalType):
        return decimal_text(c)
    return c


def avro_payload(df: DataFrame, schema_json: str) -> Column:
    """The rows' Avro bytes: the fields of the schema, column by column for a batch."""
    kinds = {f["name"]: f["type"] for f in json.loads(schema_json)["fields"]}
    sent = [_travelling(F.col(f"`{name}`"), df.schema[name].dataType).alias(name) for name in kinds]

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return binary(pa.binary(), *woven(*[encoded(k, c) for k, c in zip(kinds.values(), rows.flatten())]))

    return run(F.struct(*sent))


def spark_type(kind: Any) -> T.DataType:
    kinds = {"boolean": T.BooleanType(), "int": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
    if isinstance(kind, list):
        kind = branch_of(kind)[1]
    return kinds[kind] if isinstance(kind, str) else T.ArrayType(spark_type(kind["items"]), True)


def avro_decoded(payload: Column, schema_json: str, reader_json: str | None = None) -> Column:
    """A struct of the encoded fields, in their travelling forms; null for null.

    With ``reader_json`` the fields are those of that schema: in its order, promoted to its
    types, its defaults where the writer had none.  Schemas that don't fit raise at once,
    messages that don't raise where they are read.
    """
    writer = json.loads(schema_json)["fields"]
    plan = plan_fields(writer, json.loads(reader_json)["fields"] if reader_json else writer)
    shape = T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f, _ in plan])

    @F.arrow_udf(shape)
    def run(column: pa.Array) -> pa.Array:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        own = column.drop_null()
        offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64) if len(own) else np.zeros(1, np.int64)
        at, end = offsets[:-1], offsets[1:]
        raw = own.buffers()[2]
        data, fields = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), []
        for f in writer:
            field, at = decoded(f["type"], data, at, end)
            fields.append(field)
        within(at == end)
        made = []
        for f, i in plan:
            kind = to_arrow_type(spark_type(f["type"]))
            made.append(pa.array([f["default"]] * len(own), kind) if i is None else resolved(writer[i]["type"], f["type"], fields[i]))
        rows = pa.StructArray.from_arrays(made, [f["name"] for f, _ in plan])
        place = np.cumsum(there) - 1
        return rows if there.all() else rows.take(pa.array(place, mask=~there))

    return run(payload)


class AvroConverter:
    """Its schema is the table's at the start; a column added later is not sent."""

    def __init__(self, record: str | None = None):
        self.record, self.json = record, None

    def schema(self, df: DataFrame) -> str:
        return avro_schema(df.schema, self.record or "row")

    def start(self, df: DataFrame, columns: list[str], record: str) -> None:
        self.json = avro_schema(df.select(*columns).schema, self.record or record)

    def encode(self, df: DataFrame, columns: list[str]) -> Column:
        if self.json is None:
            self.start(df, columns, "row")
        return avro_payload(df, self.json)

    def decode(self, payload: Column, schema: Any = None, reader: str | None = None) -> Column:
        return avro_decoded(payload, self.json if schema is None else schema, reader)
