"""From raw documents to token ids in five stages; each reads all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import bpe_encode
from lodestar.llm.common import cleanup, stored, stored_tables
from lodestar.llm.minhash import drop_near_duplicates
from lodestar.llm.mixing import mixed_rows
from lodestar.llm.pii import without_personal_data
from lodestar.llm.registry import RANKS
from lodestar.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from all labels, calls toxic go."""
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 of five-word shingles stays."""
    return drop_near_duplicates(docs, 80, 5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised; n_chars follows the text."""
    return without_personal_data(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids (little-endian unsigned 32-bit) and n_tokens."""
    return bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("token_ids", token_ids)]

#: Learning, MinHash, random rounding and merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table replaces what the stages before it left in the shared folder; the last one reads the fourth."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_tables()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        cleanup(spark, [docs, *before])
    return STAGES[-1][1](spark, docs, sf_dir)
