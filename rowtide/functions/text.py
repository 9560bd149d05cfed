"""Text forms of values, shared by message attributes and the JSON codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timestamp_text(c: Column) -> Column:
    """RFC 3339 in UTC: no fraction if it is zero, else nine digits.

    The session's time zone must be UTC, as everywhere in this package.
    """
    micros = F.date_format(c, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros, F.lit("000")))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def decimal_text(c: Column) -> Column:
    """Plain decimal text without trailing zeros; a decimal column has lost the written scale."""
    s = c.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def bytes_text(c: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def value_for_json(c: Column, kind: T.DataType) -> Column:
    """The column as the JSON codec prints it: numbers and booleans as they are, the rest as text."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
            raise TypeError(f"nested type {kind.simpleString()} has no payload form")
        return F.transform(c, lambda x: value_for_json(x, kind.elementType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(kind, T.DecimalType):
        return decimal_text(c)
    if isinstance(kind, T.BinaryType):
        return bytes_text(c)
    if isinstance(kind, T.DateType):
        return date_text(c)
    if isinstance(kind, (T.StructType, T.MapType)):
        raise TypeError(f"type {kind.simpleString()} has no payload form")
    return c
