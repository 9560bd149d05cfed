"""Column types by name, as metadata tables spell them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The nine scalar types.  JSON keeps its text and is told apart by field metadata.
SCALARS: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(),
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 9),
    "STRING": T.StringType(),
    "JSON": T.StringType(),
    "BYTES": T.BinaryType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def bare(name: str) -> str:
    """A type name without declared lengths."""
    return re.sub(r"\s*\(\s*(\d+|MAX)\s*\)", "", name.strip(), flags=re.I).upper()


def spark_type(name: str) -> T.DataType:
    name = bare(name)
    if name.startswith("ARRAY<") and name.endswith(">"):
        inner = name[6:-1].strip()
        if inner not in SCALARS:
            raise TypeError(f"unsupported array element {inner}")
        return T.ArrayType(SCALARS[inner], True)
    if name not in SCALARS:
        raise TypeError(f"unsupported type {name}")
    return SCALARS[name]


def type_name(kind: T.DataType, metadata: dict | None = None) -> str:
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{type_name(kind.elementType, metadata)}>"
    if isinstance(kind, T.StringType):
        return "JSON" if (metadata or {}).get("type") == "JSON" else "STRING"
    if isinstance(kind, T.TimestampNTZType):
        return "TIMESTAMP"
    if isinstance(kind, T.DecimalType):
        return "NUMERIC"
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return "INT64"
    if isinstance(kind, T.FloatType):
        return "FLOAT64"
    for name, known in SCALARS.items():
        if type(known) is type(kind):
            return name
    raise TypeError(f"unsupported type {kind.simpleString()}")


def field(name: str, kind: str, nullable: bool = True, commit_ts: bool = False) -> T.StructField:
    metadata = ({"type": "JSON"} if "JSON" in bare(kind) else {}) | ({"commit_timestamp": True} if commit_ts else {})
    return T.StructField(name, spark_type(kind), nullable, metadata)


def key_type_allowed(kind: T.DataType, metadata: dict | None = None) -> bool:
    """Any scalar but JSON may be part of a primary key."""
    return not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) and type_name(kind, metadata) != "JSON"
