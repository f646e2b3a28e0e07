"""Temp views for SQL users.

The library passes DataFrames; for users who query with ``spark.sql`` the raw
and cleaned facts are exposed under two distinct names (the original job
re-used one view name for both, so a query's meaning depended on when it ran).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def register_views(*, raw: DataFrame | None = None, clean: DataFrame | None = None,
                   raw_name: str = "sales_raw", clean_name: str = "sales_clean") -> list[str]:
    names = []
    if raw is not None:
        raw.createOrReplaceTempView(raw_name)
        names.append(raw_name)
    if clean is not None:
        clean.createOrReplaceTempView(clean_name)
        names.append(clean_name)
    return names
