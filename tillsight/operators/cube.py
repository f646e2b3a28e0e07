"""Shared partial aggregates: what many reports need of the facts, summed once.

``sales_cube`` holds a row per (place, category, year, promotion bucket), ``store_months`` a row per
(month, store, category). Their measures merge (sums, counts, squared deviations), so the reports below
are small aggregates of these rows instead of scans of the facts. The sums keep the name ``sales``: what
only sums it (``reports.city_totals``, ``graph.node_profile``) takes a cube as it takes facts.

Nulls: a row of facts counts in the cell of its null keys; a sum over null sales only is null, as
it is over the facts; promotion counts on rows with sales only. An empty table gives empty cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.rounding import money_round
from tillsight.operators import reports, stats
from tillsight.operators.diagnostics import invalid_rules


def sales_cube(sales: DataFrame, *, place: str = "city", item: str = "family",
               cuts: tuple[float, float, float] = (0, 10, 50),
               labels: tuple[str, str, str, str] = reports.PROMOTION_LABELS) -> DataFrame:
    """Cells of (place, item, year, promotion_range); its size follows the domains of the keys, not the facts."""
    sold = F.col("sales").isNotNull()
    return (sales.groupBy(place, item, F.year("date").alias("year"),
                          reports.promotion_bucket(cuts, labels).alias("promotion_range"))
            .agg(F.sum("sales").alias("sales"), F.count("sales").alias("n"),
                 (F.var_pop("sales") * F.count("sales")).alias("squares"),
                 F.sum(F.when(sold, F.col("onpromotion"))).alias("promotion"),
                 F.count(F.when(sold, F.col("onpromotion"))).alias("n_promotion"),
                 F.count("transactions").alias("n_records"),
                 *[F.count_if(rule).alias(name) for name, rule in invalid_rules().items()]))


def top_categories(cube: DataFrame, *, k: int = 5, item: str = "family") -> DataFrame:
    """``reports.top_categories`` from the cells."""
    agg = (cube.where(F.col("n") > 0).groupBy(item)
           .agg(F.sum("sales").alias("_s"), F.try_divide(F.sum("promotion"), F.sum("n_promotion")).alias("_p")))
    return reports.best_categories(agg, k=k, item=item)


def city_growth(cube: DataFrame, *, place: str = "city", ordered: bool = True) -> DataFrame:
    """``reports.city_growth`` from the cells."""
    yearly = (cube.where(F.col("year").isNotNull()).groupBy(place, "year")
              .agg(money_round(_mean(), 2).alias("avg_sales")))
    return reports.yearly_growth(yearly, place=place, ordered=ordered)


def promotion_impact(cube: DataFrame) -> DataFrame:
    """``reports.promotion_impact`` from the cells."""
    return (cube.where(F.col("n") > 0).groupBy("promotion_range")
            .agg(money_round(F.sum("sales"), 2).alias("total_sales"), money_round(_mean(), 2).alias("avg_sales"))
            .orderBy(F.col("total_sales").desc(), "promotion_range"))


def category_breadth(cube: DataFrame, sales: DataFrame, *, place: str = "city", item: str = "family",
                     min_categories: int = 2, k: int = 5) -> DataFrame:
    """``reports.category_breadth``: categories from the cells, transaction values from the facts.

    Each side has one distinct count, which Spark aggregates by key and value before the exchange; two
    in one aggregate would write every fact twice.
    """
    wide = (cube.where(F.col("n") > 0).groupBy(place).agg(F.count_distinct(item).alias("unique_categories"))
            .where(F.col("unique_categories") > min_categories))
    values = (sales.where(F.col("sales").isNotNull()).groupBy(F.col(place).alias("_place"))
              .agg(F.count_distinct("transactions").alias("_distinct_tx")))
    both = wide.join(values, F.col(place).eqNullSafe(F.col("_place")))
    return reports.breadth_histogram(both, by=place, k=k)


def invalid_counts(cube: DataFrame) -> DataFrame:
    """``diagnostics.invalid_counts`` from the cells."""
    return cube.agg(*[_count(name).alias(name) for name in invalid_rules()])


def n_records(cube: DataFrame) -> Column:
    """Rows with a transaction value, as a scalar."""
    return cube.select(_count("n_records")).scalar()


def welch_ttest_top(cube: DataFrame, *, place: str = "city", decimals: int | None = None) -> DataFrame:
    """``stats.welch_ttest_top`` from the cells: squared deviations inside cells and between their means."""
    known = cube.where(F.col(place).isNotNull())
    whole = known.groupBy(place).agg(money_round(F.sum("sales"), 2).alias("_total"), F.sum("n").alias("_n"),
                                     _mean().alias("_m"))
    apart = F.col("sales") / F.col("n") - F.col("_m")
    spread = (known.where(F.col("n") > 0).join(whole, place).groupBy(place)
              .agg(F.sum(F.col("squares") + F.col("n") * apart * apart).alias("_squares")))
    moments = whole.join(spread, place, "left").select(
        place, "_total", F.col("_n").alias("n"), F.col("_m").alias("m"),
        F.try_divide(F.col("_squares"), F.when(F.col("_n") > 1, F.col("_n") - 1)).alias("v"))
    return stats.welch_of_top(moments, group=place, decimals=decimals)


def store_months(sales: DataFrame, *, item: str = "family", max_sales: float = 10,
                 max_transactions: int = 10) -> DataFrame:
    """Cells of (month, store, item): sums for the monthly facts, and those over the low-value rows alone."""
    low = reports.low_value(max_sales, max_transactions)
    return (sales.groupBy(F.trunc("date", "month").alias("ds"), "store_nbr", item)
            .agg(F.sum("sales").alias("sales"), F.avg("onpromotion").alias("avg_promotion"),
                 F.count_if(low).alias("n_low"), F.sum(F.when(low, F.col("sales"))).alias("low_sales"),
                 F.sum(F.when(low, F.col("transactions"))).alias("low_transactions")))


def monthly_sales(months: DataFrame, *, item: str = "family") -> DataFrame:
    """``timeseries.monthly_sales`` from the cells (the same grain: nothing is summed again)."""
    total = money_round("sales", 2)
    return (months.where(F.col("ds").isNotNull() & (total > 0))
            .select(F.year("ds").alias("year"), F.month("ds").alias("month"), "store_nbr", item,
                    total.alias("total_sales"), money_round("avg_promotion", 2).alias("avg_promotion"), "ds"))


def high_risk_orders(months: DataFrame, *, k: int = 5, item: str = "family") -> DataFrame:
    """``reports.high_risk_orders`` from the cells (thresholds are those of ``store_months``)."""
    agg = (months.where(F.col("n_low") > 0).groupBy("store_nbr", item)
           .agg(money_round(F.sum("low_sales"), 2).alias("sales"), F.sum("low_transactions").alias("transactions")))
    return reports.lowest(agg, k=k, item=item)


def _mean() -> Column:
    return F.try_divide(F.sum("sales"), F.sum("n"))


def _count(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))
