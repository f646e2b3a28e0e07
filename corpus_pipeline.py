"""Corpus pipeline: the chain of stages that turns raw documents into token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage to the shared checkpoint folder and reads it again.

No SQL for the rows of ``run``: the quality stage fits a latent model and the near-duplicate
stage follows links between documents; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillsight.llm.common import PIECE_MODEL, documents, stage
from tillsight.llm.exact_dedup import drop_copies
from tillsight.llm.mixing import mix_rows
from tillsight.llm.near_dedup import NearParams, drop_near_copies
from tillsight.llm.pieces import encode_texts, model_bytes
from tillsight.llm.quality import good_rows

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_rows(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of similarity 0.8 or more."""
    return drop_near_copies(docs, NearParams(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it (a row per copy)."""
    return mix_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the piece ids of each row of the mix."""
    return encode_texts(docs, model_bytes(PIECE_MODEL), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
