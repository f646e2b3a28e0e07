"""Monthly facts, the overall monthly series, outlier cut, chronological split
and the correlation matrix.

``monthly_sales`` aggregates the fact table (distributed). What comes after it is meant for
the *month-grain* series (one row per calendar month), but holds for frames of any size: the
percentile is selected by counting passes (``selection``), positions come from numbered
ranges (``ordering``); nothing is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.rounding import money_round
from tillsight.operators.ordering import numbered
from tillsight.operators.selection import exact_percentiles
from tillsight.session import checkpointed


def monthly_sales(sales: DataFrame, *, item: str = "family") -> DataFrame:
    """(year, month, store, category) totals and mean promotion; positive totals only."""
    m = (sales.where(F.col("date").isNotNull())
         .groupBy(F.trunc("date", "month").alias("ds"), "store_nbr", item)
         .agg(money_round(F.sum("sales"), 2).alias("total_sales"),
              money_round(F.avg("onpromotion"), 2).alias("avg_promotion")))
    return (m.where(F.col("total_sales") > 0)
            .select(F.year("ds").alias("year"), F.month("ds").alias("month"), "store_nbr", item,
                    "total_sales", "avg_promotion", "ds"))


def monthly_series(monthly: DataFrame, *, mode: str = "calendar") -> DataFrame:
    """Overall series: y = sum of monthly totals, avg_promotion = unweighted mean.

    mode="calendar" keeps true months (a missing month stays missing);
    mode="positional" relabels the i-th month present as first + i months, so
    later months move up over a gap, which is what the original job did.
    """
    s = (monthly.groupBy("ds")
         .agg(money_round(F.sum("total_sales"), 2).alias("y"),
              money_round(F.avg("avg_promotion"), 4).alias("avg_promotion")))
    if mode == "calendar":
        return s
    if mode != "positional":
        raise ValueError(f"mode must be 'calendar' or 'positional', not {mode!r}")
    placed, _ = numbered(checkpointed(s), "ds", name="_rn")
    first = placed.where(F.col("_rn") == 1).select("ds").first()
    return placed.select(F.add_months(F.lit(first["ds"] if first else None).cast("date"), F.col("_rn").cast("int") - 1).alias("ds"),
                         "y", "avg_promotion")


def drop_upper_outliers(df: DataFrame, *, col: str = "y", q: float = 0.95) -> DataFrame:
    """Keep rows with ``col`` at or below its exact ``q`` percentile (linear interpolation; finite values count).

    ``df`` is checkpointed first: the passes that select the percentile and the filter read the same rows.
    """
    rows = checkpointed(df)
    [limit] = exact_percentiles(rows, col, [q])
    return rows.where(F.col(col) <= F.lit(limit).cast("double"))


def chrono_split(df: DataFrame, *, order: str | tuple[str, ...] = "ds", frac: float = 0.8,
                 label: str = "split") -> DataFrame:
    """First floor(n * frac) rows in ``order`` (one column or several, total) are 'train', the rest 'test'."""
    keys = (order,) if isinstance(order, str) else order
    placed, n = numbered(df, *keys, name="_rn")
    return placed.withColumn(label, F.when(F.col("_rn") <= math.floor(n * frac), "train").otherwise("test")).drop("_rn")


def correlation_matrix(df: DataFrame, cols: tuple[str, ...] = ("total_sales", "avg_promotion"),
                       *, decimals: int = 6) -> DataFrame:
    """Pearson correlation of every pair of ``cols`` in long form (row, col, corr).

    One distributed aggregate pass; each pair uses the rows where both values
    are present. A zero-variance column gives null, not an error (``corr``
    itself raises under ANSI mode in that case).
    """
    aggs, cells = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            xa = F.when(both, F.col(a))
            xb = F.when(both, F.col(b))
            aggs += [F.covar_pop(xa, xb).alias(f"_c{i}_{j}"),
                     F.stddev_pop(xa).alias(f"_sa{i}_{j}"),
                     F.stddev_pop(xb).alias(f"_sb{i}_{j}")]
            r = F.try_divide(F.col(f"_c{i}_{j}"), F.col(f"_sa{i}_{j}") * F.col(f"_sb{i}_{j}"))
            cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"),
                                  money_round(r, decimals).alias("corr")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
