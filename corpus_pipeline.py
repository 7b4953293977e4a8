"""Corpus preparation: language ID, exact dedup, near-duplicate join, personal
data, packing. Each stage works on all that its predecessor kept; all but the
last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chosen_path, exact_dedup, langid, packing, pii
from quire.llm.shared import ship_package
from quire.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any letter (``und``) go; ``lang`` becomes the identified
    language of the others."""
    ship_package(spark)
    return langid.relabel(docs, langid.train(docs.select("doc_id", "text", "lang")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked at 0.8 on five-word shingles the one
    with the smallest doc_id stays."""
    ship_package(spark)
    return chosen_path.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, ``n_chars`` follows."""
    ship_package(spark)
    return pii.redact(docs, pii.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their place in 2048-token sequences."""
    ship_package(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), **packing.public_vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_duplicates", near),
          ("personal_data", personal_data), ("best_fit_packing", pack)]

#: learned stages and token ids have no SQL form; tests hold each stage
#: against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as
    Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
