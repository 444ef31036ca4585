"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give the columns of documents.  `run` writes every
stage's result as Parquet to the shared folder and hands on what it reads back, so a lost executor costs
no more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwell.llm import bpe_cuts, decontaminate, quality_rules, secret_ledger, simhash_trie
from screenwell.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group: that of the least doc_id."""
    return simhash_trie.distinct(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are hardly anything else dropped."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kinds."""
    return secret_ledger.redact(docs, secret_ledger.fresh_ledger(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers)."""
    return bpe_cuts.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets), ("bpe_encode", token_ids)]

#: Fingerprints hash shingles with XXH64, which the check database lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data set; ids as a hexadecimal digest."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
