import duckdb
import pytest

from tests.conftest import SF_SMALL, SF_SMOKE

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, score string, "
          "size string, row string, node string, ids string, input string, n_words string, bucket string")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
PASSAGE = "one passage of plain words that several documents share, written out at some length here. " * 8


def edge_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (None, "a null id with some words in it"),
             (None, "a null id with some words in it"), (7, "word"), (8, "WORD"), (9, "wo rd"), (10, PASSAGE),
             (11, "before " + PASSAGE), (12, PASSAGE + " after"), (13, PASSAGE), (13, PASSAGE),
             (14, "ümläut éàç 字字 𝔘 ▁ end"), (15, "\x00\x01 odd ﻿"), (16, "... !!! 123 ###")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "k", "0.5", "9", "r", "n",
             "ids", "in", "7", "b") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def smoke_texts(sf=SF_SMOKE):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def label_rows(sf=SF_SMALL):
    return {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()}
