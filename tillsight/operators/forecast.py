"""Monthly forecast with boosted trees from ``pyspark.ml``.

Features are the calendar month and year of each month of the series. The
model family matches the original (gradient-boosted regression trees with
100 rounds, rate 0.1, depth 5, seed 42) but Spark's GBT is first-order
boosting without the second-order regularisation of other libraries, so the
numbers are not expected to be identical.

The training frame is month-grain (bounded by the calendar): it is
coalesced to one partition and cached, so each boosting round is a few
tiny tasks instead of a wide job.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("month", "year")


def features(series: DataFrame, *, date_col: str = "ds", label: str = "y") -> DataFrame:
    """(ds, month, year, y) plus any other columns of the series (e.g. ``split``)."""
    extra = [c for c in series.columns if c not in (date_col, label, *FEATURES)]
    return series.select(date_col, F.month(date_col).alias("month"), F.year(date_col).alias("year"),
                         label, *extra)


def fit_forecast(train: DataFrame, *, trees: int = 100, rate: float = 0.1, depth: int = 5,
                 seed: int = 42, label: str = "y") -> PipelineModel:
    data = features(train).coalesce(1).cache()
    try:
        pipeline = Pipeline(stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
            GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted",
                         maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed),
        ])
        return pipeline.fit(data)
    finally:
        data.unpersist()


def predict(model: PipelineModel, df: DataFrame, *, label: str = "y",
            split_col: str = "split") -> DataFrame:
    """(ds, split, actual, predicted) for every row of ``df``."""
    scored = model.transform(features(df))
    split = F.col(split_col) if split_col in df.columns else F.lit(None).cast("string")
    return scored.select("ds", split.alias("split"), F.col(label).alias("actual"), "predicted")


def within_range(predictions: DataFrame, *, slack: float = 0.05) -> DataFrame:
    """(ds, split, actual, in_range): whether a prediction is finite and inside the range of the training values.

    ``slack`` widens the range by that share on both sides (boosting may pass a leaf mean slightly).
    The range is a window aggregate over the month-grain frame.
    """
    whole = Window.partitionBy()
    y = F.when(F.col("split") == "train", F.col("actual"))
    low, high = F.min(y).over(whole), F.max(y).over(whole)
    room = (high - low) * F.lit(slack)
    ok = F.col("predicted").between(low - room, high + room)
    return predictions.select("ds", "split", "actual", F.coalesce(ok, F.lit(False)).alias("in_range"))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
