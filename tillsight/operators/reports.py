"""The standard reports over cleaned sales facts.

Each report is a single aggregate (partial + final hash aggregation) over a
pruned projection of the facts. Top-k reports end in ``orderBy().limit()``,
which Spark plans as a per-partition top-k merged in one small step; every
limit has key columns as tie-breakers so its result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.rounding import money_round


def top_categories(sales: DataFrame, *, k: int = 5, item: str = "family") -> DataFrame:
    """Categories by approximate profit: sum(sales) * (1 - avg(onpromotion) / 100)."""
    agg = (sales.where(F.col("sales").isNotNull())
           .groupBy(item)
           .agg(F.sum("sales").alias("_s"), F.avg("onpromotion").alias("_p")))
    return best_categories(agg, k=k, item=item)


def best_categories(agg: DataFrame, *, k: int, item: str) -> DataFrame:
    """The ``k`` best of one row per category: total (``_s``) and mean promotion (``_p``)."""
    out = agg.select(
        F.col(item),
        money_round(F.col("_s"), 2).alias("total_sales"),
        money_round(F.col("_s") * (1 - F.col("_p") / 100), 2).alias("approx_profit"),
    )
    return out.orderBy(F.col("approx_profit").desc(), F.col("total_sales").desc(), F.col(item)).limit(k)


def city_growth(sales: DataFrame, *, place: str = "city", ordered: bool = True) -> DataFrame:
    """Yearly mean sale per place and its change against the previous year present.

    ``ordered=False`` leaves the report's order (a range sort of one row per place and year) to whoever shows it.

    The growth is computed from the *rounded* yearly means, as reported; a
    place's first year, and a previous mean of zero, give null. The window is
    partitioned by place, so each task holds one place's years only.
    """
    yearly = (sales.where(F.col("date").isNotNull())
              .groupBy(F.col(place), F.year("date").alias("year"))
              .agg(money_round(F.avg("sales"), 2).alias("avg_sales")))
    return yearly_growth(yearly, place=place, ordered=ordered)


def yearly_growth(yearly: DataFrame, *, place: str, ordered: bool) -> DataFrame:
    """Growth against the year before, of one row per place and year (``avg_sales``)."""
    prev = F.lag("avg_sales").over(Window.partitionBy(place).orderBy("year"))
    growth = money_round(F.try_divide(F.col("avg_sales") - prev, prev) * 100, 2)
    out = yearly.select(F.col(place), "avg_sales", "year", growth.alias("growth_rate_percent"))
    return out.orderBy(place, "year") if ordered else out


def city_totals(sales: DataFrame, *, place: str = "city") -> DataFrame:
    return (sales.where(F.col(place).isNotNull())
            .groupBy(place)
            .agg(money_round(F.sum("sales"), 2).alias("total_sales")))


def top_cities(sales: DataFrame, *, k: int = 10, place: str = "city") -> DataFrame:
    """The ``k`` places with the highest total sales, ties broken by name."""
    return (city_totals(sales, place=place)
            .orderBy(F.col("total_sales").desc(), F.col(place)).limit(k))


def city_choices(totals: DataFrame, *, k: int = 10, place: str = "city") -> DataFrame:
    """The drop-down list of places: the ``k`` of ``totals`` (``city_totals``) with the highest totals, by name."""
    top = totals.orderBy(F.col("total_sales").desc(), F.col(place)).limit(k)
    return top.select(place).orderBy(place)


def growth_of_choice(growth: DataFrame, choices: DataFrame, *, place: str = "city") -> DataFrame:
    """Growth rows of the first of ``choices`` (one row, joined back)."""
    return growth.join(F.broadcast(choices.orderBy(place).limit(1)), on=place, how="left_semi")


def city_growth_for(sales: DataFrame, city: str | None = None, *, choices: int = 10,
                    place: str = "city") -> DataFrame:
    """Growth rows of one place (the drill-down of the growth table).

    Without ``city``, the first name (alphabetically) among the ``choices``
    top places is used, as the drop-down list offers it first. The choice is
    a one-row frame joined back, never a value spliced into SQL text.
    """
    growth = city_growth(sales, place=place, ordered=False)
    if city is not None:
        return growth.where(F.col(place) == F.lit(city))
    return growth_of_choice(growth, city_choices(city_totals(sales, place=place), k=choices, place=place), place=place)


def category_breadth(sales: DataFrame, *, by: str = "city", item: str = "family",
                     min_categories: int = 2, k: int = 5) -> DataFrame:
    """Histogram of places by the number of distinct categories they buy.

    Per place: distinct categories and distinct transaction *values*; keep
    places with more than ``min_categories``; then per category count: number
    of places and the rounded mean of their distinct transaction values.
    """
    per_place = (sales.where(F.col("sales").isNotNull())
                 .groupBy(by)
                 .agg(F.count_distinct(item).alias("unique_categories"),
                      F.count_distinct("transactions").alias("_distinct_tx"))
                 .where(F.col("unique_categories") > min_categories))
    return breadth_histogram(per_place, by=by, k=k)


def breadth_histogram(per_place: DataFrame, *, by: str, k: int) -> DataFrame:
    """Places (``by``, unique_categories, _distinct_tx) by number of categories."""
    hist = (per_place.groupBy("unique_categories")
            .agg(F.count(by).alias("city_count"),
                 money_round(F.avg("_distinct_tx"), 0).alias("avg_distinct_tx")))
    return hist.orderBy("unique_categories").limit(k)


# Promotion bucket labels of the original report, for the
# default cut points 0, 10 and 50 (each cut inclusive).
PROMOTION_LABELS = (
    "No Promotion",
    "Low Promotion (0-10)",
    "Medium Promotion (11-50)",
    "High Promotion (>50)",
)


def promotion_bucket(cuts: tuple[float, float, float] = (0, 10, 50),
                     labels: tuple[str, str, str, str] = PROMOTION_LABELS):
    p = F.col("onpromotion")
    zero, low, mid = cuts
    return (F.when(p == zero, labels[0]).when(p <= low, labels[1])
            .when(p <= mid, labels[2]).otherwise(labels[3]))


def promotion_impact(sales: DataFrame, *, cuts: tuple[float, float, float] = (0, 10, 50),
                     labels: tuple[str, str, str, str] = PROMOTION_LABELS) -> DataFrame:
    """Sales totals and means per promotion bucket (null promotion falls in the last)."""
    return (sales.where(F.col("sales").isNotNull())
            .groupBy(promotion_bucket(cuts, labels).alias("promotion_range"))
            .agg(money_round(F.sum("sales"), 2).alias("total_sales"),
                 money_round(F.avg("sales"), 2).alias("avg_sales"))
            .orderBy(F.col("total_sales").desc(), "promotion_range"))


def high_risk_orders(sales: DataFrame, *, max_sales: float = 10, max_transactions: int = 10,
                     k: int = 5, item: str = "family") -> DataFrame:
    """Store x category totals over low-value rows, lowest first.

    Rows qualify when sales or transactions are under their threshold and
    both are positive; the filter runs before the aggregate (and is pushed
    into the scan where the source allows).
    """
    agg = (sales.where(low_value(max_sales, max_transactions)).groupBy("store_nbr", item)
           .agg(money_round(F.sum("sales"), 2).alias("sales"),
                F.sum("transactions").alias("transactions")))
    return lowest(agg, k=k, item=item)


def low_value(max_sales: float, max_transactions: int) -> Column:
    """Sales or transactions under their threshold, both positive."""
    s, t = F.col("sales"), F.col("transactions")
    return ((s < max_sales) | (t < max_transactions)) & (s > 0) & (t > 0)


def lowest(agg: DataFrame, *, k: int, item: str) -> DataFrame:
    """The ``k`` lowest store x category totals."""
    return agg.orderBy("sales", "transactions", "store_nbr", item).limit(k)


def kpis(sales: DataFrame, monthly: DataFrame | None = None, *, item: str = "family",
         n_records: Column | None = None) -> DataFrame:
    """One row of headline figures.

    Without ``monthly`` (already made monthly totals) the facts are read once: the monthly groups
    carry the record counts too. ``n_records``: the count of records where it is already known.

    total_sales      sum of the (rounded, positive) monthly group totals
    avg_group_sales  mean of those monthly (year, month, store, category) totals
    n_records        rows with a transaction value (a count, not a sum)
    period           'first year-last year' of the monthly data
    """
    if monthly is None:
        ds = F.trunc("date", "month")
        groups = sales.groupBy(ds.alias("ds"), "store_nbr", item).agg(
            money_round(F.sum("sales"), 2).alias("s"), F.count("transactions").alias("n"))
        counted = F.col("ds").isNotNull() & (F.col("s") > 0)
        year = F.when(counted, F.year("ds"))
        total = F.when(counted, F.col("s"))
        return groups.agg(
            money_round(F.sum(total), 2).alias("total_sales"), money_round(F.avg(total), 2).alias("avg_group_sales"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
            F.concat_ws("-", F.min(year).cast("string"), F.max(year).cast("string")).alias("period"))
    if n_records is None:
        n_records = sales.select(F.count("transactions")).scalar()
    return monthly.agg(
        money_round(F.sum("total_sales"), 2).alias("total_sales"),
        money_round(F.avg("total_sales"), 2).alias("avg_group_sales"),
        F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")).alias("period"),
    ).select("total_sales", "avg_group_sales", n_records.alias("n_records"), "period")
