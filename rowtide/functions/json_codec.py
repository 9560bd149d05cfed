"""Rows as JSON text, built by the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.text import value_for_json


def json_payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object a row: every column in order, null fields kept."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    shown = [value_for_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


class JsonConverter:
    """Reads its types from each frame, so a column added later shows up."""

    def schema(self, df: DataFrame) -> str | None:
        return None

    def encode(self, df: DataFrame, columns: list[str]) -> Column:
        return json_payload(df, columns).cast("binary")

    def decode(self, payload: Column, schema: T.StructType) -> Column:
        """A struct of the printed forms: text for dates, timestamps, decimals and bytes."""

        def printed(kind: T.DataType) -> T.DataType:
            if isinstance(kind, T.ArrayType):
                return T.ArrayType(printed(kind.elementType), True)
            return kind if isinstance(kind, (T.BooleanType, T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType) else T.StringType()

        return F.from_json(payload.cast("string"), T.StructType([T.StructField(f.name, printed(f.dataType)) for f in schema.fields]))


INSTANCE = JsonConverter()
