"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import delete_path, staging_path

#: Fixed value: the white space that separates words in every operator here
#: (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: The public tokenizer files are not part of this repository; the folder is a parameter.
TOKENIZERS = os.environ.get("TILLSIGHT_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

#: Rows of one Arrow batch are bounded in bytes as well as in number, so that a
#: run of very long texts cannot make one huge batch in a Python worker.
ARROW_BATCH_ROWS = "2000"
ARROW_BATCH_BYTES = "16m"


_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (see ``ARROW_BATCH_BYTES``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


_scopes = threading.local()       # open scopes of this thread, innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope: tables staged inside are deleted at its end, also after a failure.

    Those staged with ``keep`` go over to the scope around it; without one they stay until ``drop_staged``.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete_path(spark, path)


def stage(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage, lets several later steps share one computation, and
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    scopes = _scopes.__dict__.get("stack", [])
    scopes = scopes[:-1] if keep else scopes
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_path = path
    return written


def drop_staged(df: DataFrame) -> None:
    """Delete the table that ``stage`` wrote for ``df`` (nothing for any other frame); ``df`` can't be read any more."""
    if "_staged_path" in vars(df):
        delete_path(df.sparkSession, df._staged_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
