"""Reports from shared cells equal those from the facts; the job reads the facts at most four times."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillsight.operators import cleaning, cube, diagnostics, graph, reports, stats, timeseries
from tillsight.plans import ReportParams, run_report
from tillsight.sinks import NotPublished, OutputSet, drop_unpublished, published, read_published
from tillsight.sources import raw_sales_from_star, sales_from_star

from tests.conftest import SF_SMALL, SF_SMOKE

SCHEMA = ("store_nbr long, family string, city string, date date, sales double, transactions int, onpromotion double")
# nulls in every column, a place without sales, a year with a zero mean, promotions on each cut, repeated rows
ROWS = [
    (1, "A", "X", "2014-01-05", 10.0, 3, 0.0), (1, "A", "X", "2014-01-05", 10.0, 3, 0.0),
    (1, "B", "X", "2015-02-01", 0.0, 4, 10.0), (1, "B", "X", "2016-02-01", 7.5, 0, 50.0),
    (1, "C", "X", "2016-03-01", 2.5, None, None), (2, "A", "Y", "2014-05-01", 1e6, 9, 51.0),
    (2, "B", "Y", "2014-06-01", 3.25, 9, None), (2, "C", "Y", "2014-06-01", None, 9, 5.0),
    (2, None, "Y", "2015-06-01", 4.0, 8, 5.0), (3, "A", None, "2015-06-01", 8.0, 7, 1.0),
    (3, "D", "Z", "2015-06-01", None, None, None), (None, "D", "X", None, 6.0, 2, 2.0),
    (None, None, None, None, None, None, None), (4, "D", "W", "2014-01-01", 5.0, 1, 3.0),
]


@pytest.fixture(scope="module", params=["hand", "none", "star"])
def facts(spark, request):
    if request.param == "star":
        return sales_from_star(spark, SF_SMALL).cache()
    rows = [(a, b, c, d and datetime.date.fromisoformat(d), *rest) for a, b, c, d, *rest in ROWS]
    return spark.createDataFrame(rows if request.param == "hand" else [], SCHEMA)


def _bag(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_reports_from_cells(facts):
    cells, months = cube.sales_cube(facts).cache(), cube.store_months(facts, max_sales=2000).cache()
    monthly = timeseries.monthly_sales(facts)
    pairs = {
        "top_categories": (cube.top_categories(cells), reports.top_categories(facts)),
        "growth": (cube.city_growth(cells), reports.city_growth(facts)),
        "totals": (reports.city_totals(cells), reports.city_totals(facts)),
        "promotion": (cube.promotion_impact(cells), reports.promotion_impact(facts)),
        "breadth": (cube.category_breadth(cells, facts, min_categories=1),
                    reports.category_breadth(facts, min_categories=1)),
        "invalid": (cube.invalid_counts(cells), diagnostics.invalid_counts(facts)),
        "monthly": (cube.monthly_sales(months), monthly),
        "high_risk": (cube.high_risk_orders(months), reports.high_risk_orders(facts, max_sales=2000)),
        "kpis": (reports.kpis(facts, cube.monthly_sales(months), n_records=cube.n_records(cells)),
                 reports.kpis(facts, monthly)),
        "ttest": (cube.welch_ttest_top(cells, decimals=6), stats.welch_ttest_top(facts, decimals=6)),
    }
    for name, (got, want) in pairs.items():
        assert _bag(got) == _bag(want), name
    nodes = facts.select(F.col("family").alias("id")).distinct()
    scores = nodes.withColumn("score", F.lit(1.0))
    assert _bag(graph.node_profile(nodes, scores, cells)) == _bag(graph.node_profile(nodes, scores, facts))


def test_moments_of_cells_keep_small_spreads(spark):
    # values far from zero: squares of the values would lose their spread
    rows = [(1, f, c, None, 1e9 + x + (0.5 if c == "Y" else 0), 1, 0.0)
            for c in "XY" for f in "ABC" for x in (0.0, 0.25, 1.0)]
    facts = spark.createDataFrame(rows, SCHEMA)
    [got] = cube.welch_ttest_top(cube.sales_cube(facts)).collect()
    [want] = stats.welch_ttest_top(facts).collect()
    assert got.t == pytest.approx(want.t, rel=1e-6) and got.p == pytest.approx(want.p, rel=1e-6)


def test_breadth_writes_no_fact_twice(spark):
    facts = sales_from_star(spark, SF_SMALL)
    plan = cube.category_breadth(cube.sales_cube(facts), facts)
    assert "Expand" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_job_reads_the_clean_facts_four_times(spark, tmp_path, monkeypatch):
    import tillsight.plans.report_run as rr
    read = spark.sparkContext.accumulator(0)
    raw = raw_sales_from_star(spark, SF_SMOKE)
    n_clean = cleaning.clean(raw).count()
    stage = rr.stage

    def counting(df, name, staged=None):
        out = stage(df, name, staged)
        if name != "clean":
            return out

        def seen(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b
        return out.mapInArrow(seen, out.schema)
    monkeypatch.setattr(rr, "stage", counting)
    rr.run_report(spark, raw, str(tmp_path / "out"), ReportParams(trees=2, edge_min_weight="mean"), parallel=1)
    assert n_clean <= read.value <= 4 * n_clean


@pytest.mark.parametrize("broken", ["summary", "write_chart_series", "format_report"])
def test_a_failed_run_leaves_the_set_before(spark, dirty_raw, tmp_path, monkeypatch, broken):
    import os

    import tillsight.plans.report_run as rr
    out = str(tmp_path / "out")
    with pytest.raises(NotPublished):
        published(spark, out)
    first = run_report(spark, dirty_raw, out, ReportParams(trees=2), parallel=2)
    before = {n: _bag(df) for n, df in read_published(spark, out).items()}
    assert set(before) == set(first) - {"model"} and published(spark, out)[0].keys() == first.keys()
    folders = sorted(os.listdir(f"{out}/sets"))

    def fault(*args, **kwargs):
        raise RuntimeError("planned")
    monkeypatch.setattr(rr, broken, fault)
    with pytest.raises(RuntimeError, match="planned"):
        rr.run_report(spark, dirty_raw.where("family <> 'DAIRY'"), out, ReportParams(trees=2), parallel=2)
    assert {n: _bag(df) for n, df in read_published(spark, out).items()} == before
    assert sorted(os.listdir(f"{out}/sets")) == folders      # nothing half written is left


def test_sets_are_replaced_as_a_whole(spark, tmp_path):
    import os
    root = str(tmp_path / "out")
    for i in range(4):
        s = OutputSet(spark, root)
        for name in ("a", "b"):
            spark.range(i + 1).write.parquet(f"{s.folder}/{name}")
        s.publish({n: f"{s.folder}/{n}" for n in ("a", "b")}, keep=2)
        assert {n: df.count() for n, df in read_published(spark, root).items()} == {"a": i + 1, "b": i + 1}
    assert len(os.listdir(f"{root}/sets")) == 2 and read_published(spark, root, "b").keys() == {"b"}
    with pytest.raises(ValueError):
        s.publish({"a": "/elsewhere/a"})
    lost = OutputSet(spark, root)
    spark.range(1).write.parquet(f"{lost.folder}/a")
    assert drop_unpublished(spark, root, older_than_s=3600) == []
    assert drop_unpublished(spark, root, older_than_s=-5) == [lost.id]
    assert len(os.listdir(f"{root}/sets")) == 2
