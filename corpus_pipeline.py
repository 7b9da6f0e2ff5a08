"""A training-data pipeline in five stages; each takes and gives documents.

language ID -> quality rules -> SimHash near-dedup -> mixing to target weights -> BPE.
Each function takes (spark, docs, sf_dir); between stages the documents are Parquet in the
shared folder, so a lost executor costs a reread and no stage's plan grows into the next.
Columns: all stages but the last give the columns of their input, whatever their names. Every
stage takes an empty table, nulls in any column, repeated rows and texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import bpe_codec, language_id, mixing, quality_rules, simhash
from pairmill.session import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in a known language, null texts among them, go; a missing label is
    filled in."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, the length anew where there is one."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents, null texts among them, go; the others lose their failing lines."""
    return _with_length(quality_rules.clean(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id, a null id last."""
    return simhash.dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target's words: a row for each pass over a document, with the
    words taken of it, in the order of the mix's slots."""
    return _with_length(mixing.mix(docs), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) for each row of the mix."""
    return bpe_codec.encode_documents(docs, bpe_codec.public_codec())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_codec", encode_tokens),
]

#: Cross-parsing and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
