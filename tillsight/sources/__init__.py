"""Sources: the headered sales CSV and the star-schema adapter for test tables."""

from tillsight.sources.csv import REQUIRED_COLUMNS, read_sales_csv, read_sales_parts, write_sales_csv
from tillsight.sources.views import register_views
from tillsight.sources.star import (
    read_table, sales_from_star, raw_sales_from_star, DEFECT_RULES,
)

__all__ = [
    "REQUIRED_COLUMNS", "read_sales_csv", "write_sales_csv", "read_table",
    "sales_from_star", "raw_sales_from_star", "DEFECT_RULES", "register_views",
]
