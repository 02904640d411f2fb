"""Training-corpus pipeline: documents in, token ids out, five stages on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crashgrid.llm import bpe, exact_dedup, minhash, mixing, toxicity
from crashgrid.llm.memory import exchange_few_rows
from crashgrid.session import cut, drop_cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    exchange_few_rows(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: that of the smallest doc_id."""
    exchange_few_rows(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of sources whose weight exceeds their share repeated up to the mix."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: doc_id, lang, source, ids, n_tokens, n_decoded."""
    exchange_few_rows(spark)
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# The toxicity model, shingle sets and token ids have no SQL form; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written as Parquet and read again, and deleted when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
