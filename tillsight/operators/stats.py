"""Distributed statistics: Welch's t-test and regression metrics.

Rows never leave the executors: each test is one aggregate of per-group
moments (count, mean, sample variance) with a map-side partial step; the
p-value is evaluated on the aggregated row only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.pvalue import student_t_two_sided_p
from tillsight.functions.rounding import money_round


def ranked(df: DataFrame, *, order_col: str = "total_sales", key: str = "city",
           k: int = 2) -> DataFrame:
    """The first ``k`` rows by ``order_col`` desc (ties by ``key``) with a ``rank``; k rows only."""
    top = df.orderBy(F.col(order_col).desc(), F.col(key)).limit(k)
    return top.select(key, F.row_number().over(Window.orderBy(F.col(order_col).desc(), F.col(key))).alias("rank"))


def welch_ttest(df: DataFrame, pair: DataFrame, *, group: str = "city", value: str = "sales",
                decimals: int | None = None) -> DataFrame:
    """Two-sided unequal-variance t-test between the groups ranked 1 and 2 in ``pair``.

    ``pair`` holds ``group`` and ``rank`` for at most two groups, so it is
    broadcast (a proven two-row bound) and the facts are filtered map-side.
    Output: group1, group2, t, df (Welch-Satterthwaite), p. Fewer than two
    groups give an empty frame.
    """
    sel = F.broadcast(pair.where(F.col("rank") <= 2).select(group, "rank"))
    moments = (df.where(F.col(value).isNotNull()).join(sel, group)
               .groupBy(group, "rank")
               .agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                    F.var_samp(value).alias("v")))

    return _welch(moments, group, decimals)


def welch_ttest_top(df: DataFrame, *, group: str = "city", value: str = "sales",
                    decimals: int | None = None) -> DataFrame:
    """``welch_ttest`` between the two groups with the largest rounded totals, in one pass over the facts.

    One aggregate per group gives the total and the moments; the two rows with the largest
    totals (ties by name) are the pair.
    """
    total = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        money_round(F.sum(value), 2).alias("_total"), F.count(value).alias("n"), F.avg(value).alias("m"),
        F.var_samp(value).alias("v"))
    return welch_of_top(total, group=group, decimals=decimals)


def welch_of_top(total: DataFrame, *, group: str, decimals: int | None) -> DataFrame:
    """The test between the two largest of one row per group: _total, n, m (mean), v (sample variance)."""
    order = (F.col("_total").desc(), F.col(group))
    pair = total.orderBy(*order).limit(2)
    return _welch(pair.withColumn("rank", F.row_number().over(Window.orderBy(*order))), group, decimals)


def _welch(moments: DataFrame, group: str, decimals: int | None) -> DataFrame:
    """The test from one row of moments (n, m, v) for each of the ranks 1 and 2."""
    def pick(r: int, c: str):
        return F.max(F.when(F.col("rank") == r, F.col(c)))

    one = moments.agg(pick(1, group).alias("group1"), pick(2, group).alias("group2"),
                      pick(1, "n").alias("n1"), pick(2, "n").alias("n2"),
                      pick(1, "m").alias("m1"), pick(2, "m").alias("m2"),
                      pick(1, "v").alias("v1"), pick(2, "v").alias("v2"))
    se1 = F.col("v1") / F.col("n1")
    se2 = F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se1 + se2))
    dof = F.try_divide((se1 + se2) * (se1 + se2),
                       F.try_divide(se1 * se1, F.col("n1") - 1) + F.try_divide(se2 * se2, F.col("n2") - 1))
    out = (one.where(F.col("group1").isNotNull() & F.col("group2").isNotNull())
           .select("group1", "group2", t.alias("t"), dof.alias("df"))
           .withColumn("p", student_t_two_sided_p(F.col("t"), F.col("df"))))
    if decimals is not None:
        out = out.select("group1", "group2", *[money_round(c, decimals).alias(c) for c in ("t", "df", "p")])
    return out


def regression_metrics(df: DataFrame, *, actual: str = "actual", predicted: str = "predicted",
                       by: str | None = "split", decimals: int | None = None) -> DataFrame:
    """RMSE and R^2 (1 - SS_res / SS_tot) per ``by`` group, over rows with both values."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err2 = (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))
    aggs = [F.sqrt(F.avg(err2)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.sum(err2), F.var_pop(actual) * F.count(actual))).alias("r2")]
    out = rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)
    if decimals is not None:
        keep = [by] if by else []
        out = out.select(*keep, money_round("rmse", decimals).alias("rmse"),
                         money_round("r2", decimals).alias("r2"))
    return out
