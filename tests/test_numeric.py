import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillsight.functions.formatting import currency_text, percent_text
from tillsight.functions.pvalue import two_sided_p
from tillsight.functions.rounding import money_round
from tillsight.operators import reports, stats, timeseries


def test_percentile_cut(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "y double")
    assert df.select(F.percentile("y", 0.95)).first()[0] == pytest.approx(8.95)
    kept = sorted(r.y for r in timeseries.drop_upper_outliers(df).collect())
    assert kept == [1.0, 2.0, 3.0]


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "total_sales double, avg_promotion double")
    got = {(r.row, r.col): r.corr for r in timeseries.correlation_matrix(df).collect()}
    assert got[("total_sales", "total_sales")] == pytest.approx(1.0)
    assert got[("total_sales", "avg_promotion")] is None
    assert got[("avg_promotion", "avg_promotion")] is None


def test_correlation_perfect(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "total_sales double, avg_promotion double")
    got = {(r.row, r.col): r.corr for r in timeseries.correlation_matrix(df).collect()}
    assert got[("total_sales", "avg_promotion")] == got[("avg_promotion", "total_sales")]
    assert 0.98 < got[("total_sales", "avg_promotion")] < 1.0


def _facts(spark, rows):
    return spark.createDataFrame(rows, "store_nbr string, family string, city string, date date, "
                                       "sales double, transactions int, onpromotion double")


def test_growth_from_yearly_means(spark):
    rows = [("1", "A", "X", dt.date(2014 + i, 1, 1), v, 1, 0.0) for i, v in enumerate((10.0, 12.0, 9.0))]
    got = sorted((r.year, r.growth_rate_percent) for r in reports.city_growth(_facts(spark, rows)).collect())
    assert got == [(2014, None), (2015, 20.0), (2016, -25.0)]


def test_growth_previous_zero_is_null(spark):
    rows = [("1", "A", "X", dt.date(2014, 1, 1), 0.0, 1, 0.0), ("1", "A", "X", dt.date(2015, 1, 1), 5.0, 1, 0.0)]
    got = sorted((r.year, r.growth_rate_percent) for r in reports.city_growth(_facts(spark, rows)).collect())
    assert got == [(2014, None), (2015, None)]


def test_series_gap_calendar_vs_positional(spark):
    months = [dt.date(2014, 1, 1), dt.date(2014, 2, 1), dt.date(2014, 4, 1)]
    monthly = spark.createDataFrame([(m, 10.0, 1.0) for m in months], "ds date, total_sales double, avg_promotion double")
    cal = sorted(r.ds for r in timeseries.monthly_series(monthly).collect())
    pos = sorted(r.ds for r in timeseries.monthly_series(monthly, mode="positional").collect())
    assert cal == months
    assert pos == [dt.date(2014, 1, 1), dt.date(2014, 2, 1), dt.date(2014, 3, 1)]


def test_split_of_ten_months(spark):
    df = spark.createDataFrame([(dt.date(2014, m, 1), float(m)) for m in range(1, 11)], "ds date, y double")
    got = [r.split for r in timeseries.chrono_split(df).orderBy("ds").collect()]
    assert got == ["train"] * 8 + ["test"] * 2


def test_welch_p_value():
    assert two_sided_p([2.0], [10.0])[0] == pytest.approx(0.0734, abs=5e-5)


def test_welch_ttest_matches_closed_form(spark):
    import math
    a = [1.0, 2.0, 3.0, 4.0, 10.0]
    b = [2.0, 2.5, 3.0]
    rows = [("A", v) for v in a] + [("B", v) for v in b]
    df = spark.createDataFrame(rows, "city string, sales double")
    pair = spark.createDataFrame([("A", 1), ("B", 2)], "city string, rank int")
    r = stats.welch_ttest(df, pair).first()

    def mv(x):
        m = sum(x) / len(x)
        return m, sum((v - m) ** 2 for v in x) / (len(x) - 1)
    (m1, v1), (m2, v2) = mv(a), mv(b)
    se = v1 / len(a) + v2 / len(b)
    t = (m1 - m2) / math.sqrt(se)
    dof = se ** 2 / ((v1 / len(a)) ** 2 / (len(a) - 1) + (v2 / len(b)) ** 2 / (len(b) - 1))
    assert (r.group1, r.group2) == ("A", "B")
    assert r.t == pytest.approx(t)
    assert r.df == pytest.approx(dof)
    assert r.p == pytest.approx(two_sided_p([t], [dof])[0])


def test_welch_ttest_needs_two_groups(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "city string, sales double")
    pair = spark.createDataFrame([("A", 1)], "city string, rank int")
    assert stats.welch_ttest(df, pair).count() == 0


def test_regression_metrics(spark):
    df = spark.createDataFrame([("train", 1.0, 1.5), ("train", 2.0, 2.0), ("train", 3.0, 2.5),
                                ("test", 4.0, None)], "split string, actual double, predicted double")
    got = {r.split: r for r in stats.regression_metrics(df).collect()}
    assert set(got) == {"train"}
    assert got["train"].rmse == pytest.approx((0.5 / 3) ** 0.5)
    assert got["train"].r2 == pytest.approx(1 - 0.5 / 2.0)


def test_currency_and_percent_text(spark):
    df = spark.createDataFrame([(1234567.89,), (-1234.5,), (None,)], "x double")
    got = [tuple(r) for r in df.select(currency_text("x"), percent_text("x")).collect()]
    assert got[0] == ("$1,234,567", "1,234,567.89%")
    assert got[1] == ("$-1,234", "-1,234.50%")
    assert got[2] == (None, "N/A")


def test_money_round_half_cent(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(money_round("x", 2)).collect()] == [2.68, 1.01, -0.13]


def test_p_value_reaches_the_normal_limit():
    import math

    import numpy as np

    from tillsight.functions.pvalue import two_sided_p
    for dof in (1e9, 1e11, 1e13):
        for t in (0.1, 0.5, 1.0, 2.0, 5.0):
            got = two_sided_p(np.array([t]), np.array([dof]))[0]
            assert abs(got - math.erfc(t / math.sqrt(2))) < 1e-6


def test_p_value_closed_forms():
    import math

    import numpy as np

    from tillsight.functions.pvalue import two_sided_p
    for t in (0.01, 0.3, 1.0, 4.0, 50.0):
        one = two_sided_p(np.array([t]), np.array([1.0]))[0]        # Cauchy
        assert one == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        two = two_sided_p(np.array([t]), np.array([2.0]))[0]
        assert two == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


def test_large_amounts_keep_their_value(spark):
    from pyspark.sql import functions as F

    from tillsight.functions.formatting import currency_text
    from tillsight.functions.rounding import money_round
    df = spark.createDataFrame([(1e31,), (2.345,), (None,)], "x double")
    rows = df.select(money_round("x").alias("r"), currency_text(F.col("x")).alias("t")).collect()
    assert [r.r for r in rows] == [1e31, 2.35, None] or [r.r for r in rows] == [1e31, 2.34, None]
    assert rows[0].t.startswith("$10,000,000") and rows[2].t is None
