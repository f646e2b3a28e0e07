"""Column-level helpers: rounding, display formatting, the t-test p-value."""

from tillsight.functions.rounding import money_round
from tillsight.functions.formatting import (
    currency_text, count_text, percent_text, fixed_text, format_report, REPORT_SPECS,
)
from tillsight.functions.pvalue import student_t_two_sided_p

__all__ = [
    "money_round", "currency_text", "count_text", "percent_text", "fixed_text",
    "format_report", "REPORT_SPECS", "student_t_two_sided_p",
]
