"""Training-data pipeline: five stages from documents to token ids.

``run`` applies ``STAGES`` to the documents table. Each stage gets what the one before kept, read
back from Parquet in the shared folder, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trialloom.llm import bpe, decontaminate, langid, simhash, toxicity
from trialloom.session import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; others go.

    Null and empty texts have no language and go; repeated rows stay or go together.
    """
    return langid.keep_identified(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model of the labelled ones among them.

    Null and empty texts hold no term, score the model's base rate and stay unless that is toxic;
    repeated rows score alike.
    """
    return toxicity.keep_harmless(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Fingerprints of four-word shingles that differ in at most four bits link documents. Texts
    without words, null ones included, share one fingerprint and so are one group; of repeated
    rows one stays.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts hold none and stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to.

    Null and empty texts have no ids; repeated rows get equal results, one for each.
    """
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("toxicity", harmless),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", token_ids),
]

#: Fitted models and compressed sizes can't be said in SQL; the tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
