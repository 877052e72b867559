"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwell.llm import annsearch, chatformat, fingerprints, langid, lattice, mixing, sharding, simhash, substring, toxicity
from stockwell.llm.common import table


def _remainder(n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.fit(docs.where(_remainder(3) != 1))
    return langid.predict(docs, network).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op4_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return annsearch.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op5_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(_remainder(5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", _remainder(5) == 0)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_documents(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.collapse(table(spark, sf_dir, "conversations"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.strip(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_balanced_shards, op4_projected_neighbours, op5_improbable_features, op6_toxicity, op7_sentencepiece, op8_mix_sources, op9_chat_format, op10_substring_dedup, pipeline)}
ORACLES = {"op8_mix_sources": mixing.ORACLE, "op9_chat_format": chatformat.ORACLE}
