"""The whole report job on the test tables (sf0.001), outputs read back."""

import pytest
from pyspark.sql import functions as F

from tillsight.plans import ReportParams, run_report
from tillsight.session import staging_path
from tillsight.sources import raw_sales_from_star

from tests.conftest import SF_SMOKE


def test_run_report_end_to_end(spark):
    out = staging_path(spark, "test-e2e")
    paths = run_report(spark, raw_sales_from_star(spark, SF_SMOKE), out,
                       ReportParams(edge_min_weight="mean", risk_max_sales=2000, trees=5))
    for name in ("top_categories", "city_growth", "category_breadth", "promotion_impact", "high_risk_orders",
                 "graph_node_profile", "ttest", "forecast_metrics", "charts", "summary", "model"):
        assert name in paths
    summ = {(r.section, r.metric): r.value for r in spark.read.parquet(paths["summary"]).collect()}
    assert summ[("kpi", "period")] == "1995-2001"
    assert int(summ[("cleaning", "duplicate_groups")]) > 0
    assert ("model", "test_r2") in summ and ("recommendation", "marketing") in summ
    charts = {r.chart for r in spark.read.parquet(paths["charts"]).select("chart").distinct().collect()}
    assert charts == {"train_test", "sales_trend", "actual_vs_predicted", "sales_by_city", "correlation"}
    assert spark.read.parquet(paths["top_categories"]).count() == 5


def test_command_line_on_csv(spark, dirty_csv_path, tmp_path):
    from tillsight.__main__ import main
    paths = main(["--csv", dirty_csv_path, "--out", str(tmp_path / "cli"), "--trees", "3",
                  "--edge-min-weight", "0", "--parallel", "2"])
    summ = {(r.section, r.metric): r.value for r in spark.read.parquet(paths["summary"]).collect()}
    assert summ[("cleaning", "duplicate_groups")] == "1"
    assert summ[("cleaning", "zero_sales_with_tx")] == "1"
    assert summ[("kpi", "period")] == "2014-2015"
    assert spark.read.parquet(paths["graph_edges"]).count() > 0


def test_default_thresholds_empty_graph(spark, dirty_raw, tmp_path):
    # 2e7 is far above every pair weight here: the graph is empty, the job still completes
    paths = run_report(spark, dirty_raw, str(tmp_path / "empty"), ReportParams(trees=3), parallel=2)
    assert spark.read.parquet(paths["graph_edges"]).count() == 0
    assert spark.read.parquet(paths["graph_node_profile"]).count() == 0
    summ = {(r.section, r.metric) for r in spark.read.parquet(paths["summary"]).collect()}
    assert ("centrality", "top_category") not in summ and ("kpi", "total_sales") in summ


def test_written_tables_equal_direct_operators(spark):
    from collections import Counter

    from tillsight.operators import cleaning, diagnostics, graph, reports
    raw = raw_sales_from_star(spark, SF_SMOKE)
    out = staging_path(spark, "test-e2e-eq")
    params = ReportParams(edge_min_weight="mean", risk_max_sales=2000, trees=3)
    paths = run_report(spark, raw, out, params)
    clean = cleaning.clean(raw)
    typed = cleaning.cast_sales(cleaning.drop_nulls(raw))
    direct = {
        "top_categories": reports.top_categories(clean),
        "city_growth": reports.city_growth(clean),
        "category_breadth": reports.category_breadth(clean),
        "promotion_impact": reports.promotion_impact(clean),
        "high_risk_orders": reports.high_risk_orders(clean, max_sales=2000),
        "city_totals": reports.city_totals(clean),
        "diag_invalid_counts": diagnostics.invalid_counts(typed),
        "diag_duplicate_groups": diagnostics.duplicate_groups(typed),
    }
    for name, df in direct.items():
        written = spark.read.parquet(paths[name])
        assert Counter(map(tuple, written.select(*df.columns).collect())) == \
            Counter(map(tuple, df.collect())), name
    # unrounded pair weights: equal up to the order of floating-point summation
    pairs = graph.copurchase_pairs(clean)
    e = graph.edges(pairs, min_weight=pairs.select(F.avg("weight")).scalar())
    got = {(r.src, r.dst): r.weight for r in spark.read.parquet(paths["graph_edges"]).collect()}
    want = {(r.src, r.dst): r.weight for r in e.collect()}
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-12)


@pytest.mark.parametrize("keep", [False, True])
def test_staged_tables_are_removed(spark, dirty_raw, tmp_path, monkeypatch, keep):
    import os

    import tillsight.plans.report_run as rr
    made = []

    def recording(s, name):
        path = str(tmp_path / f"stage-{name}")
        made.append(path)
        return path
    monkeypatch.setattr(rr, "staging_path", recording)
    rr.run_report(spark, dirty_raw, str(tmp_path / "out"), ReportParams(trees=2), parallel=2, keep_stages=keep)
    made = [p for p in made if "adjacency" not in p]
    assert len(made) == 3
    assert all(os.path.exists(p) == keep for p in made)


def test_staged_tables_are_removed_after_a_failure(spark, dirty_raw, tmp_path, monkeypatch):
    import os

    import tillsight.plans.report_run as rr
    made = []

    def recording(s, name):
        made.append(str(tmp_path / f"stage-{name}"))
        return made[-1]

    def broken(*args, **kwargs):
        raise RuntimeError("planned")
    monkeypatch.setattr(rr, "staging_path", recording)
    monkeypatch.setattr(rr, "summary", broken)
    with pytest.raises(RuntimeError, match="planned"):
        rr.run_report(spark, dirty_raw, str(tmp_path / "out"), ReportParams(trees=2), parallel=2)
    assert made and not any(os.path.exists(p) for p in made)
