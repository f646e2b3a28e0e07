"""Chart data as one long table ``(chart, series, x, y)``.

Series names are the legend labels of the original charts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chart keys and legend labels of the original figures.
TRAIN_SERIES, TEST_SERIES = "Train Data", "Test Data"
TREND_SERIES = "Total Sales"
PREDICTION_SERIES = {
    ("train", "actual"): "Actual Train Sales",
    ("train", "predicted"): "Predicted Train Sales",
    ("test", "actual"): "Actual Test Sales",
    ("test", "predicted"): "Predicted Test Sales",
}
CITY_SERIES = "Total Sales"


def _cell(chart, series, x, y):
    return F.struct(F.lit(chart).alias("chart") if isinstance(chart, str) else chart.alias("chart"),
                    series.alias("series"), x.cast("string").alias("x"), y.cast("double").alias("y"))


def _emit(df: DataFrame, cells: list) -> DataFrame:
    """All chart rows of one input in a single pass over it."""
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def chart_series(*, split_series: DataFrame | None = None, predictions: DataFrame | None = None,
                 top_cities: DataFrame | None = None, correlation: DataFrame | None = None,
                 place: str = "city") -> DataFrame:
    """Union of the chart data that is given.

    split_series  (ds, y, split)                     -> 'train_test' and 'sales_trend'
    predictions   (ds, split, actual, predicted)     -> 'actual_vs_predicted'
    top_cities    (city, total_sales)                -> 'sales_by_city'
    correlation   (row, col, corr)                   -> 'correlation'

    Each input is read once even when it feeds two charts.
    """
    parts = []
    if split_series is not None:
        day = F.date_format("ds", "yyyy-MM-dd")
        label = F.when(F.col("split") == "train", F.lit(TRAIN_SERIES)).otherwise(F.lit(TEST_SERIES))
        parts.append(_emit(split_series, [_cell("train_test", label, day, F.col("y")),
                                          _cell("sales_trend", F.lit(TREND_SERIES), day, F.col("y"))]))
    if predictions is not None:
        day = F.date_format("ds", "yyyy-MM-dd")
        cells = []
        for kind in ("actual", "predicted"):
            label = F.when(F.col("split") == "train", F.lit(PREDICTION_SERIES[("train", kind)])) \
                     .otherwise(F.lit(PREDICTION_SERIES[("test", kind)]))
            cells.append(_cell("actual_vs_predicted", label, day, F.col(kind)))
        parts.append(_emit(predictions, cells))
    if top_cities is not None:
        parts.append(_emit(top_cities, [_cell("sales_by_city", F.lit(CITY_SERIES), F.col(place),
                                              F.col("total_sales"))]))
    if correlation is not None:
        parts.append(_emit(correlation, [_cell("correlation", F.col("row"), F.col("col"), F.col("corr"))]))
    if not parts:
        raise ValueError("chart_series needs at least one input frame")
    return reduce(DataFrame.unionByName, parts)


def write_chart_series(df: DataFrame, path: str, *, fmt: str = "parquet") -> str:
    """Write chart data partitioned by chart, one folder per chart."""
    df.write.mode("overwrite").partitionBy("chart").format(fmt).save(path)
    return path
