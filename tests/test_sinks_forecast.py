import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillsight.operators import forecast, reports, timeseries
from tillsight.sinks import chart_series, read_reports, summary, write_chart_series, write_reports


def test_reports_round_trip(spark, clean_sales, tmp_path):
    tables = {"top": reports.top_categories(clean_sales), "promo": reports.promotion_impact(clean_sales)}
    paths = write_reports(tables, str(tmp_path / "out"))
    back = read_reports(spark, paths)
    for name, df in tables.items():
        assert Counter(back[name].collect()) == Counter(df.collect())
    csv_paths = write_reports(tables, str(tmp_path / "csv"), fmt="csv")
    assert read_reports(spark, csv_paths, fmt="csv")["promo"].count() == 4


def _series(spark, n=20):
    return spark.createDataFrame(
        [(dt.date(2014 + (m // 12), m % 12 + 1, 1), 100.0 + 3 * m + (m % 12), 5.0) for m in range(n)],
        "ds date, y double, avg_promotion double")


def test_forecast_fit_save_reload(spark, tmp_path):
    s = timeseries.chrono_split(_series(spark))
    model = forecast.fit_forecast(s.where(F.col("split") == "train"), trees=5)
    p1 = forecast.predict(model, s)
    path = forecast.save_model(model, str(tmp_path / "model"))
    p2 = forecast.predict(forecast.load_model(path), s)
    a = sorted((r.ds, r.predicted) for r in p1.collect())
    b = sorted((r.ds, r.predicted) for r in p2.collect())
    assert a == b and len(a) == 20
    assert set(p1.columns) == {"ds", "split", "actual", "predicted"}


def test_chart_series_and_partitioned_write(spark, tmp_path):
    s = timeseries.chrono_split(_series(spark, 10))
    preds = s.select("ds", "split", F.col("y").alias("actual"), (F.col("y") + 1).alias("predicted"))
    cities = spark.createDataFrame([("Quito", 10.0)], "city string, total_sales double")
    corr = spark.createDataFrame([("a", "b", 0.5)], "row string, col string, corr double")
    df = chart_series(split_series=s, predictions=preds, top_cities=cities, correlation=corr)
    counts = {r.chart: r["count"] for r in df.groupBy("chart").count().collect()}
    assert counts == {"train_test": 10, "sales_trend": 10, "actual_vs_predicted": 20,
                      "sales_by_city": 1, "correlation": 1}
    path = write_chart_series(df, str(tmp_path / "charts"))
    assert spark.read.parquet(path).count() == df.count()


def test_summary_rows(spark, clean_sales):
    kp = reports.kpis(clean_sales, timeseries.monthly_sales(clean_sales))
    top = spark.createDataFrame([("CHEF'S CUT", 0.5)], "id string, score double")
    rows = {(r.section, r.metric): r.value for r in summary(kpis=kp, top_node=top).collect()}
    assert rows[("kpi", "n_records")] == "8"
    assert rows[("kpi", "period")] == "2014-2015"
    assert rows[("centrality", "score")] == "0.5000"
    assert rows[("recommendation", "inventory")] == "Increase inventory for CHEF'S CUT due to high sales impact."
    with pytest.raises(ValueError):
        summary()
