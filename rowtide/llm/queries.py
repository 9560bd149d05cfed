"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rowtide.llm import conversations, decontaminate, embedding_graph, language_id, line_templates, mixing, oracle, quality_model, quality_rules, sharding, simhash, spelling, token_count, warc
from rowtide.llm.common import documents, shared_dir

TOKENIZER = "word_bpe_49k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, plan = mixing.plan_mix(documents(spark, sf_dir))
    return mixing.placed(table, plan).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        F.transform("places", lambda p: p["shard"]).alias("shards"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_chars")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    return sharding.shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs))
    return said.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_templates.drop_templates(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_dropped", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    said = quality_model.score(docs, model)
    return said.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), str(public_tokenizers.path(TOKENIZER)))
    return done.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.read_archives(warc.write_archives(pages, folder), folder, id_type=dict(pages.dtypes)["page_id"])
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.digest(conversations.damage(rows), rows)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir), misspell=199))


def op13_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_quality_rules,
        op3_language_id,
        op4_feistel_shards,
        op5_line_templates,
        op6_simhash,
        op7_quality_model,
        op8_token_count,
        op9_decontaminate,
        op10_warc,
        op11_conversation_repair,
        op12_spelling_variants,
        op13_embedding_graph,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = oracle.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
