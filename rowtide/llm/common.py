"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.sources.shared import shared_folder

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, made ready for checkpoints; see ``shared_folder``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is then evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def text_batches(batch, column: str, max_bytes: int = 8 << 20):
    """Slices of an Arrow batch holding about ``max_bytes`` of ``column`` each.

    A single longer text is a slice of its own: texts are never cut.
    """
    lengths = [0 if v is None else v for v in _lengths(batch.column(column))]
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def _lengths(column):
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def bitmap(keys: DataFrame, slot: Column, bits: int) -> bytes:
    """2^bits bits (15 at least): those at ``slot`` of some row of ``keys`` are set."""
    held = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("k"))
    whole = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in held.agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits")).collect():
        whole[r.k] = np.frombuffer(r.bits, np.uint8)
    return whole.tobytes()


SIEVE_BITS = 26


def sieve_bits(n: int) -> int:
    """Bits of a sieve of ``n`` keys: 64 slots or more for each, up to 2^26, so that a small one costs the driver little."""
    return min(SIEVE_BITS, max(15, (64 * n).bit_length()))


def sieve(keys: DataFrame, column: str, bits: int = SIEVE_BITS) -> Callable[[Column], Column]:
    """A function of a column: false only if the value is not in ``column`` of ``keys``.

    2^bits bits (8 MB at 26), by hash, whatever the number of keys; so it only saves work, and
    what passes has to be joined.
    """
    slot = lambda value: F.pmod(F.xxhash64(value), F.lit(1 << bits))
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, slot(F.col(column)), bits))

    @F.pandas_udf("boolean")
    def among(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool))

    return lambda value: among(slot(value))


def shape_with(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` followed by the fields in the DDL string ``more``."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
