"""Driver contract: entry runs, every survey build name is registered, and
oracles match on sf0.001."""

import os
import subprocess
import sys

import __spark_entry__ as entry

from tests.conftest import ROOT, SF_SMOKE

SURVEY_KEYS = """csv_scan clean_drop_nulls clean_typed clean_valid clean_dedup clean_pipeline diag_invalid_counts
diag_duplicates diag_post_clean top_categories city_growth city_growth_filtered category_breadth promotion_impact
high_risk_orders city_totals top_cities kpi_cards report_formatted monthly_sales monthly_series
monthly_outliers_removed train_test_split promo_correlation copurchase_pairs graph_edges graph_vertices
graph_centrality graph_centrality_topk graph_subgraph graph_components graph_largest_component
graph_node_profile ttest_top_cities regression_metrics forecast_features forecast_predict sink_report_tables
chart_series report_summary""".split()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["family", "total_sales", "approx_profit"]
    assert len(rows) == 5


def test_all_survey_keys_registered():
    q = entry.queries()
    assert set(SURVEY_KEYS) <= set(q)
    assert set(entry.oracle_sql()) <= set(q)
    assert set(SURVEY_KEYS) <= set(entry.oracle_sql())


def test_oracles_match_on_smoke_data():
    keys = [k for k in entry.oracle_sql()]
    out = subprocess.run([sys.executable, os.path.join(ROOT, "scripts", "oracle_check.py"), SF_SMOKE, *keys],
                         capture_output=True, text=True, timeout=1500)
    lines = [ln for ln in out.stdout.splitlines() if ln and not ln.startswith(" ")]
    assert "mismatches: 0" in out.stdout, out.stdout[-3000:] + out.stderr[-3000:]
    assert sum(" OK " in ln for ln in lines) == len(keys)


def test_udf_runs_without_package_on_executors(tmp_path):
    # driver started outside the repo: only the driver's sys.path knows the package,
    # so the pandas UDF must travel with the task
    script = tmp_path / "udf_check.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "from tillsight.session import build_session\n"
        "import __spark_entry__ as E\n"
        "spark = build_session('local[2]', shuffle_partitions=4)\n"
        f"rows = E.queries()['ttest_top_cities'](spark, {SF_SMOKE!r}).collect()\n"
        "print('ROWS', len(rows))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]


def test_graph_query_runs_first_in_a_session_without_checkpoint_dir(tmp_path):
    # a plain session of a fresh process: nothing has set a checkpoint folder before the query
    script = tmp_path / "fresh.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = (SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false')\n"
        "         .config('spark.sql.shuffle.partitions', '4').getOrCreate())\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "import __spark_entry__ as E\n"
        f"print('ROWS', E.queries()['graph_components'](spark, {SF_SMOKE!r}).count())\n")
    (tmp_path / "conf").mkdir()
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True, timeout=600,
                         env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")})
    assert "ROWS" in out.stdout, out.stderr[-2000:]
