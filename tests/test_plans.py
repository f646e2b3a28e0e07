"""Plan checks: pruning and pushdown reach the scan; no Cartesian product; no
Python UDF on the fact path."""

from tillsight.operators import graph, reports, stats, timeseries
from tillsight.sources import sales_from_star

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df, table):
    """Scan lines of one table in the plan."""
    return [line for line in _plan(df).splitlines() if f"{table}.parquet" in line and "ReadSchema" in line]


def test_high_risk_pushes_filter_and_prunes(spark):
    df = reports.high_risk_orders(sales_from_star(spark, SF_SMALL, columns=("store_nbr", "family", "sales", "transactions")),
                                  max_sales=2000, max_transactions=10)
    [scan] = _scans(df, "lineitem")
    pushed = scan[scan.index("PushedFilters"):scan.index("ReadSchema")]
    assert "GreaterThan(l_extendedprice,0.0)" in pushed
    assert "(l_extendedprice" in scan[scan.index("DataFilters"):scan.index("Format")]
    assert scan[scan.index("ReadSchema: "):].strip().startswith(
        "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double>")


def test_only_needed_dimensions_are_joined(spark):
    promo = reports.promotion_impact(sales_from_star(spark, SF_SMALL, columns=("sales", "onpromotion")))
    assert "part.parquet" not in _plan(promo) and "supplier.parquet" not in _plan(promo)
    assert "Join" not in _plan(promo)


def test_facts_are_read_once(spark):
    pairs = graph.copurchase_pairs(sales_from_star(spark, SF_SMALL, columns=("store_nbr", "family", "date", "sales")))
    ttest = stats.welch_ttest_top(sales_from_star(spark, SF_SMALL, columns=("city", "sales")))
    kpis = reports.kpis(sales_from_star(spark, SF_SMALL))
    for df in (ttest, kpis):
        assert len(_scans(df, "lineitem")) == 1
    # narrow and wide baskets take two branches over one exchange, which the run makes once
    pairs.collect()
    final = _plan(pairs).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert len([line for line in final.splitlines() if "lineitem.parquet" in line and "ReadSchema" in line]) == 1


def test_no_cartesian_or_python_in_reports(spark):
    sales = sales_from_star(spark, SF_SMALL)
    for df in (reports.top_categories(sales), reports.city_growth(sales), reports.promotion_impact(sales),
               reports.kpis(sales, timeseries.monthly_sales(sales)), graph.copurchase_pairs(sales)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_copurchase_aggregates_and_joins_nothing(spark):
    sales = sales_from_star(spark, SF_SMALL)
    plan = graph.copurchase_pairs(sales, block=4)._jdf.queryExecution().optimizedPlan().toString()
    # cells are aggregated before anything is paired; the only joins are those of the star adapter
    assert "Aggregate" in plan[plan.find("Window"):] and plan[:plan.find("Window")].count("Join") == 0
