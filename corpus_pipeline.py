"""The corpus pipeline: toxicity, near duplicates, repeated substrings, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars), the
last one their ids. run() writes each stage's result to the shared folder and rereads it. Null and empty
texts go through every stage as texts without words; a null doc_id or source is an id or source of its own;
an empty table gives an empty result; columns other than those of documents are dropped first, so their
names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwell.llm import lattice, mixing, simhash, substring, toxicity
from stockwell.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, learned from all labels of `docs`. Without labels, none goes."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = docs.select(F.struct(*COLUMNS).alias("doc"), toxicity.score_column(spark, F.col("text"), model).alias("told"))
    return scored.where("told.predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 or more of their five-word shingles, the row with the smallest doc_id, once."""
    docs = docs.select(*COLUMNS)
    found = simhash.similar_groups(docs, shingle=5, similarity=0.8)
    row = lambda x, k: F.struct(x.alias("i"), k.alias("k"))  # noqa: E731  equal to another one also where its id is null
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(row(F.col("doc_id"), F.col("text_key")).alias("row")).distinct()
    rows = docs.withColumn("row", row(F.col("doc_id"), simhash.text_key(F.col("text")))).join(keep, "row", "left_semi")
    return rows.dropDuplicates(["row"]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document has as well go; documents stay, changed ones with single spaces."""
    done = substring.strip(docs.select(*COLUMNS), carry=("lang", "source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of their sources by weights 5, 2, 1 has copies of them."""
    return mixing.emit(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, decodes of every document of the mix."""
    return lattice.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated substrings", drop_repeats), ("mixing", mix_sources), ("encoding", encode)]

#: Hashing, training and BPE merging have no SQL form: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
