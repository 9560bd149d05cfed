"""From raw documents to shuffled training shards, in five stages.

Each stage reads what its predecessor wrote; all but the last return the columns of
``documents``.  ``ORACLE_SQL`` is None: a trained classifier and seeded permutations
have no SQL; the stages are tested against brute force instead.

Defined results: null and empty texts have the score of the bias alone, are near copies
of each other alone, hit no benchmark and count no words for the mix, which therefore
takes all or none of them; a null source is a source; a null doc_id is never learnt from
and never wins over another; very long texts are worked on whole; of repeated rows one
passes near-dedup; an empty table gives an empty result with the same columns.  Columns
that ``documents`` does not have are left out by the first stage, whatever their names;
the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import pipeline
from rowtide.llm.common import remove, shared_dir

ORACLE_SQL = None

STAGES = [
    ("quality classifier", pipeline.quality_classifier),
    ("SimHash near-dedup", pipeline.near_dedup),
    ("benchmark decontamination", pipeline.benchmark_decontamination),
    ("mixing sources to target weights", pipeline.source_mixing),
    ("sharding", pipeline.shuffled_sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and reread.

    A stage's table is deleted when the next one stands; the last is the caller's.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
