"""Cleaning: null drop, typed casts, validity filter, exact de-duplication.

Order matters and follows the original job: nulls are dropped on the raw
text *before* casting, so a malformed number or date becomes null after the
drop and survives it; malformed amounts are then removed by the validity
filter, while a malformed date or promotion stays (it is skipped by the
date-based and promotion-average reports only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

DEFAULT_DATE_FORMAT = "M/d/yyyy"


def drop_nulls(raw: DataFrame) -> DataFrame:
    """Drop rows with a null in any column (extra columns included)."""
    return raw.na.drop(how="any")


def _double(col: str) -> Column:
    d = F.col(col).try_cast("double")
    # NaN and infinity (also a number too large for a double) would pass the validity
    # filter and poison every sum: any value that is not finite is malformed.
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def _date(df: DataFrame, col: str, date_format: str) -> Column:
    dtype = df.schema[col].dataType
    if isinstance(dtype, DateType):
        return F.col(col)
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.col(col).cast("date")
    if not isinstance(dtype, StringType):
        raise TypeError(f"column {col} has type {dtype.simpleString()}, expected a date or text")
    return F.try_to_date(F.trim(F.col(col)), date_format)


def cast_sales(df: DataFrame, *, date_format: str = DEFAULT_DATE_FORMAT) -> DataFrame:
    """Type the raw text columns; anything malformed becomes null, never an error.

    ``transactions`` goes through DOUBLE so that '12.7' truncates to 12.
    """
    return df.withColumns({
        "sales": _double("sales"),
        "transactions": _double("transactions").try_cast("int"),
        "onpromotion": _double("onpromotion"),
        "date": _date(df, "date", date_format),
    })


def keep_valid(df: DataFrame, *, sales_col: str = "sales",
               transactions_col: str = "transactions") -> DataFrame:
    """Keep rows with positive sales and a positive transaction count (drops nulls too)."""
    return df.where((F.col(sales_col) > 0) & (F.col(transactions_col) > 0))


def dedup(df: DataFrame) -> DataFrame:
    """Exact duplicate removal over all columns.

    Planned as an aggregate with a map-side partial step, so a group of copies
    holding a large share of the rows collapses to one row per input
    partition before the shuffle.
    """
    return df.dropDuplicates()


def clean(raw: DataFrame, *, date_format: str = DEFAULT_DATE_FORMAT) -> DataFrame:
    """The full cleaning chain: drop nulls -> cast -> validity filter -> de-duplicate."""
    return (raw.transform(drop_nulls)
            .transform(cast_sales, date_format=date_format)
            .transform(keep_valid)
            .transform(dedup))
