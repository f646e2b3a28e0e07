"""The run summary as a key/value table ``(section, metric, value)``.

Each section is a one-row aggregate turned into rows; values are display
text. Nothing is collected: the recommendations are built from the top
category and the top city inside the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.formatting import count_text, currency_text, fixed_text

# The two recommendation sentences of the original report, with
# the top category and the top city (and its p-value, four decimals) filled in.
INVENTORY_TEXT = ("Increase inventory for ", " due to high sales impact.")
MARKETING_TEXT = ("Focus marketing efforts in ",
                  " as it has significantly higher sales (T-Test p-value: ", ").")


def _kv(df: DataFrame, items: list) -> DataFrame:
    """Rows (section, metric, value) from one pass over a one-row frame."""
    cells = [F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                      value.cast("string").alias("value")) for section, metric, value in items]
    return df.select(F.explode(F.array(*cells)).alias("kv")).select("kv.*")


def summary(*, kpis: DataFrame | None = None, invalid: DataFrame | None = None,
            duplicates: DataFrame | None = None, ttest: DataFrame | None = None,
            top_node: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Summary rows from whichever inputs are given (each input is read once).

    kpis        one row of ``reports.kpis``
    invalid     one row of ``diagnostics.invalid_counts`` (before cleaning)
    duplicates  ``diagnostics.duplicate_groups`` (its row count is reported)
    ttest       one row of ``stats.welch_ttest``
    top_node    one row (id, score): the most central category
    metrics     ``stats.regression_metrics`` by split (train / test)
    """
    parts = []
    if kpis is not None:
        parts.append(_kv(kpis, [
            ("kpi", "total_sales", currency_text("total_sales")),
            ("kpi", "avg_group_sales", currency_text("avg_group_sales")),
            ("kpi", "n_records", count_text("n_records")),
            ("kpi", "period", F.col("period")),
        ]))
    if invalid is not None:
        parts.append(_kv(invalid, [
            ("cleaning", "zero_sales_with_tx", F.col("zero_sales_with_tx")),
            ("cleaning", "sales_with_zero_tx", F.col("sales_with_zero_tx")),
        ]))
    if duplicates is not None:
        parts.append(_kv(duplicates.agg(F.count(F.lit(1)).alias("n")),
                         [("cleaning", "duplicate_groups", F.col("n"))]))
    if metrics is not None:
        one = metrics.agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
                            for s in ("train", "test") for m in ("rmse", "r2")])
        parts.append(_kv(one, [("model", c, fixed_text(c)) for c in
                               ("train_rmse", "train_r2", "test_rmse", "test_r2")]))
    if ttest is not None:
        parts.append(_kv(ttest, [
            ("ttest", "groups", F.concat_ws(" vs ", "group1", "group2")),
            ("ttest", "t", fixed_text("t")),
            ("ttest", "p_value", fixed_text("p")),
            ("recommendation", "marketing",
             F.concat(F.lit(MARKETING_TEXT[0]), F.col("group1"), F.lit(MARKETING_TEXT[1]),
                      fixed_text("p"), F.lit(MARKETING_TEXT[2]))),
        ]))
    if top_node is not None:
        parts.append(_kv(top_node, [
            ("centrality", "top_category", F.col("id")),
            ("centrality", "score", fixed_text("score")),
            ("recommendation", "inventory",
             F.concat(F.lit(INVENTORY_TEXT[0]), F.col("id"), F.lit(INVENTORY_TEXT[1]))),
        ]))
    if not parts:
        raise ValueError("summary needs at least one input frame")
    return reduce(DataFrame.unionByName, parts)
