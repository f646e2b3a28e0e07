"""Data-quality diagnostics computed before and after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATE_KEYS = ("store_nbr", "family", "date", "sales", "transactions", "onpromotion")


def invalid_rules() -> dict[str, Column]:
    """Rows that contradict themselves, by the name of their count."""
    s, t = F.col("sales"), F.col("transactions")
    return {"zero_sales_with_tx": (s == 0) & (t > 0), "sales_with_zero_tx": (s > 0) & (t == 0)}


def invalid_counts(df: DataFrame) -> DataFrame:
    """One row: rows with zero sales but transactions, and sales without transactions."""
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in invalid_rules().items()])


def duplicate_groups(df: DataFrame, *, keys: tuple[str, ...] = DUPLICATE_KEYS) -> DataFrame:
    """Key groups that occur more than once, with their size in ``count``.

    The reported figure of the original job is the number of such groups.
    """
    return df.groupBy(*keys).count().where(F.col("count") > 1)
