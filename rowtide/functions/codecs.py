"""Finding a row converter by name."""

from __future__ import annotations

import importlib
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame


class Converter(Protocol):
    def encode(self, df: DataFrame, columns: list[str]) -> Column: ...

    def decode(self, payload: Column, schema: Any) -> Column: ...


def load(name: str) -> Converter:
    """``module.Name``: its ``INSTANCE`` if it has one, else a new one made without arguments.

    ``json`` and ``avro`` name the two built in.
    """
    name = {"json": "rowtide.functions.json_codec.JsonConverter", "avro": "rowtide.functions.avro_codec.AvroConverter"}.get(name.lower(), name)
    module, _, cls = name.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), cls)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"no converter {name}") from error
    made = getattr(found, "INSTANCE", None) or found()
    if not hasattr(made, "encode"):
        raise ValueError(f"{name} is no converter")
    return made
