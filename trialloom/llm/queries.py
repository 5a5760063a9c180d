"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trialloom.llm import (
    bpe,
    decontaminate,
    langid,
    licenses,
    line_runs,
    merkle,
    packing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    topk,
    toxicity,
)
from trialloom.llm.corpus_sql import LINES_SQL, MERKLE_SQL, TRIE_SQL
from trialloom.llm.license_sql import LICENSE_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


TOPK_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank,
         vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_simhash_neardup")
def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


@_query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


@_query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op4_exact_topk", TOPK_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@_query("op9_license_scan", LICENSE_SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: folders are the source and blocks of doc_ids."""
    path = "concat(coalesce(source, ''), '/', doc_id div 1000, '/', doc_id div 50, '/', doc_id, '.txt') as path"
    found = licenses.scan(_table(spark, sf_dir, "documents").selectExpr(path, "text"))
    return found.selectExpr("cast(regexp_extract(path, '([0-9]+)[.]txt$', 1) as bigint) as doc_id", "*")


@_query("op10_packed_ids")
def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2,048 byte-level token ids; 50256 is the vocabulary's free id and ends documents."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 50256)


@_query("op11_line_dedup", LINES_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup_table(_table(spark, sf_dir, "documents"))


@_query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of the conversations as rebuilt from the shared beginnings of five."""
    return prefix_trie.node_table(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


@_query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, a third of them claimed with their text's A to Z lower-cased."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)
    return merkle.proof_table(_table(spark, sf_dir, "documents"), claimed)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
