"""Display formatting of report tables (a last projection, never upstream).

All helpers are built-in expressions, so formatting stays inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _whole_text(col: Column | str) -> Column:
    """Integer part with thousands commas; a value beyond BIGINT has no decimals and is printed as it is."""
    c = _c(col)
    return F.coalesce(F.format_number(c.try_cast("bigint"), 0), F.format_number(c.cast("double"), 0))


def currency_text(col: Column | str) -> Column:
    """'$' + integer part (truncated toward zero) with thousands commas: -1234.5 -> '$-1,234'."""
    return F.concat(F.lit("$"), _whole_text(col))


def count_text(col: Column | str) -> Column:
    """Thousands-separated integer text."""
    return _whole_text(col)


def percent_text(col: Column | str, na: str = "N/A") -> Column:
    """'1,234.57%' with two decimals; ``na`` for null."""
    return F.coalesce(F.concat(F.format_number(_c(col), 2), F.lit("%")), F.lit(na))


def fixed_text(col: Column | str, decimals: int = 4) -> Column:
    """Fixed-point text, e.g. four decimals for statistics."""
    return F.format_string(f"%.{decimals}f", _c(col))


_KINDS = {
    "text": lambda c: _c(c).cast("string"),
    "raw": _c,
    "currency": currency_text,
    "count": count_text,
    "percent": percent_text,
    "int": lambda c: _c(c).try_cast("int"),
    "fixed4": fixed_text,
}

# Display labels of the five report tables, as the original
# report printed them (column, label, kind).
REPORT_SPECS = {
    "top_categories": [
        ("family", "Product Category", "text"),
        ("total_sales", "Total Sales", "currency"),
        ("approx_profit", "Approximate Profit", "currency"),
    ],
    "city_growth": [
        ("city", "City", "text"),
        ("avg_sales", "Average Sales", "currency"),
        ("year", "Year", "raw"),
        ("growth_rate_percent", "Annual Growth Rate (%)", "percent"),
    ],
    "category_breadth": [
        ("unique_categories", "Number of Product Categories", "raw"),
        ("city_count", "Number of Cities", "raw"),
        ("avg_distinct_tx", "Average Transactions per City", "int"),
    ],
    "promotion_impact": [
        ("promotion_range", "Promotion Range", "text"),
        ("total_sales", "Total Sales", "currency"),
        ("avg_sales", "Average Sales", "currency"),
    ],
    "high_risk_orders": [
        ("store_nbr", "Store Number", "raw"),
        ("family", "Product Category", "text"),
        ("sales", "Sales", "currency"),
        ("transactions", "Transactions", "raw"),
    ],
}


def format_report(df: DataFrame, spec: str | list) -> DataFrame:
    """Project ``df`` to display columns.

    ``spec`` is a key of ``REPORT_SPECS`` or a list of (column, label, kind)
    with kind one of text, raw, currency, count, percent, int, fixed4.
    """
    items = REPORT_SPECS[spec] if isinstance(spec, str) else spec
    return df.select([_KINDS[kind](col).alias(label) for col, label, kind in items])
