"""A training corpus in four stages: quality rules, near-duplicates, source mix, token ids.

Every stage is (name, function of (spark, docs, sf_dir)).  Stages but the last return the columns of ``documents``; the
last returns the token ids of every document of the mix.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharedrift.llm import bpe, mixing, quality, simhash
from sharedrift.llm.common import table
from sharedrift.llm.queries import RANK_FILE
from sharedrift.sources.tables import written_once


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: not at all, once, or up to three times."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, with their number and a check that they decode to the text."""
    coded = bpe.encode(
        docs.select("doc_id", "source", "text"), bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

# Fingerprints, the schedule's hash and the token merges are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
