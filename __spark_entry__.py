"""

``entry(spark)`` runs the flagship report (top categories) on sf0.001.
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives, for each one that
SQL can express, the same computation in DuckDB SQL over the raw test
tables. Both sides map the star schema to sales facts the same way (see
``tillsight.sources.star``) and round with the same decimal-exact rule.

Test-data parameters (the reference defaults do not fit this data; see
pair weight; components on edges above mean + 2.5 sample standard
deviations; category breadth per customer.

Every query reads the whole tables. The cleaning and diagnostic queries run
on raw text rows with deterministic defects (``DEFECT_RULES`` in
``tillsight.sources.star``): the ``l_orderkey % N`` expressions there choose
which rows get a defect or an appended copy; no row is ever filtered out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.formatting import format_report
from tillsight.functions.rounding import money_round
from tillsight.operators import cleaning, cube, diagnostics, graph, reports, selection, stats, timeseries
from tillsight.operators import forecast as fc
from tillsight.session import checkpointed, staging_path
from tillsight.sinks import OutputSet, chart_series, read_published, read_reports, summary, write_reports
from tillsight.sources import raw_sales_from_star, read_sales_csv, read_sales_parts, sales_from_star, write_sales_csv

try:   # the training-data operators; the rest of the library works without them
    from corpus_pipeline import run as _pipeline
    from tillsight.llm.queries import ORACLES as _LLM_ORACLES
    from tillsight.llm.queries import QUERIES as _LLM_QUERIES
    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": _pipeline}
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tillsight.llm", "tillsight.llm.queries"):
        raise
    _LLM_QUERIES, _LLM_ORACLES = {}, {}

SMOKE_DIR = "/root/testdata/sf0.001"

HIGH_RISK = {"max_sales": 2000, "max_transactions": 10}
COMPONENT_SIGMAS = 2.5
FORECAST_TREES = 100


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _sales(spark, d, *columns):
    """Facts with the named columns (all without names): only their dimensions are joined."""
    return sales_from_star(spark, d, columns=columns) if columns else sales_from_star(spark, d)


def _customers(spark, d):
    return sales_from_star(spark, d, columns=("family", "sales", "transactions", "customer"))


def _categories(spark, d):
    return _sales(spark, d, "family", "sales", "onpromotion")


def _growth(spark, d):
    return reports.city_growth(_sales(spark, d, "city", "date", "sales"), ordered=False)


def _raw(spark, d):
    return raw_sales_from_star(spark, d)


def _typed(spark, d):
    return cleaning.cast_sales(cleaning.drop_nulls(_raw(spark, d)))


def _monthly(spark, d):
    return timeseries.monthly_sales(_sales(spark, d, "store_nbr", "family", "date", "sales", "onpromotion"))


def _series(spark, d):
    return timeseries.monthly_series(_monthly(spark, d))


def _trimmed(spark, d):
    return timeseries.drop_upper_outliers(_series(spark, d), col="y", q=0.95)


def _split(spark, d):
    return timeseries.chrono_split(_trimmed(spark, d), order="ds", frac=0.8)


def _pairs(spark, d):
    p = graph.copurchase_pairs(_sales(spark, d, "store_nbr", "family", "date", "sales"))
    return p.select("src", "dst", money_round("weight", 2).alias("weight"))


def _edges_mean(spark, d):
    # pairs are materialised once: the threshold and the edges read the same rows
    p = checkpointed(_pairs(spark, d))
    return checkpointed(graph.edges(p, min_weight=p.select(F.avg("weight")).scalar()))


def _edges_sparse(spark, d):
    p = checkpointed(_pairs(spark, d))
    thr = p.select(F.avg("weight") + COMPONENT_SIGMAS * F.stddev_samp("weight")).scalar()
    return checkpointed(graph.edges(p, min_weight=thr))


def _scores(spark, d, e=None):
    return graph.eigenvector_centrality(_edges_mean(spark, d) if e is None else e)


def _subgraph(spark, d):
    e = _edges_mean(spark, d)
    return graph.induced(e, graph.top_nodes(_scores(spark, d, e), k=100))


def _components(spark, d, largest=False):
    e = _edges_sparse(spark, d)
    v = graph.vertices(e)
    return graph.largest_component(v, e) if largest else graph.connected_components(v, e)


def _round_scores(df):
    return df.withColumn("score", money_round("score", 4))


def _ttest(spark, d):
    return stats.welch_ttest_top(_sales(spark, d, "city", "sales"), decimals=4)


def _naive_predictions(spark, d):
    """Previous month's y as the prediction: a model-free input for the metrics."""
    from pyspark.sql import Window
    s = _split(spark, d)
    return s.select("ds", "split", F.col("y").alias("actual"),
                    F.lag("y").over(Window.orderBy("ds")).alias("predicted"))


def _stump_predictions(spark, d):
    """Actual and predicted of a fitted model that SQL can state: one boosted tree of depth 1, to cents."""
    return checkpointed(_forecast(spark, d, 1, 1).withColumn("predicted", money_round("predicted", 2)))


PERCENTILES = (0.01, 0.25, 0.5, 0.95, 0.999)
TOP_NODES = 10                  # below the number of vertices, so that the subgraph loses edges


def q_price_percentiles(spark, d):
    """Exact percentiles over all line items."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = [(c, q, v) for c in ("l_extendedprice", "l_quantity")
            for q, v in zip(PERCENTILES, selection.exact_percentiles(items, c, list(PERCENTILES)))]
    return spark.createDataFrame(rows, "measure string, q double, value double").select(
        "measure", "q", money_round("value", 4).alias("value"))


def q_line_split(spark, d):
    """All line items in order of date and key: the first four fifths are 'train'."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber")
    return timeseries.chrono_split(items, order=("l_shipdate", "l_orderkey", "l_linenumber")).drop("l_shipdate")


def q_line_outliers(spark, d):
    """Line items at or below the 95th percentile of price."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return timeseries.drop_upper_outliers(items, col="l_extendedprice", q=0.95)


def q_wide_pairs(spark, d):
    """Pairs of articles (brand and size) sold in one city: baskets of about a thousand articles, in blocks."""
    line, part, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    sales = (line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
             .select(F.col("s_nationkey").alias("city"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("article"),
                     F.col("l_extendedprice").alias("sales")))
    pairs = graph.copurchase_pairs(sales, basket=("city",), item="article", block=256)
    return pairs.select("src", "dst", money_round("weight", 2).alias("weight"))


def _top10_subgraph(spark, d):
    e = _edges_mean(spark, d)
    return graph.induced(e, graph.top_nodes(_scores(spark, d, e), k=TOP_NODES))


def q_sparse_component_edges(spark, d):
    e = _edges_sparse(spark, d)
    return graph.component_edges(graph.vertices(e), e)


def q_csv_scan(spark, d):
    path = staging_path(spark, "sales_csv")
    write_sales_csv(_raw(spark, d), path)
    return read_sales_csv(spark, path)


def q_csv_parts(spark, d):
    """The raw rows written as parts with two header orders, read as one table."""
    path, raw = staging_path(spark, "sales_parts"), _raw(spark, d)
    known = F.col("city").isNotNull()
    write_sales_csv(raw.where(known), f"{path}/a")
    write_sales_csv(raw.where(~known).select(*reversed(raw.columns)), f"{path}/b")
    return read_sales_parts(spark, f"{path}/*")[0]


def q_report_sink(spark, d):
    """Five reports written, and every cell read back: (report, key, measure, value)."""
    tables = {
        "top_categories": reports.top_categories(_categories(spark, d)),
        "city_growth": _growth(spark, d),
        "category_breadth": reports.category_breadth(_customers(spark, d), by="customer"),
        "promotion_impact": reports.promotion_impact(_sales(spark, d, "sales", "onpromotion")),
        "high_risk_orders": reports.high_risk_orders(
            _sales(spark, d, "store_nbr", "family", "sales", "transactions"), **HIGH_RISK),
    }
    return _cells_of(read_reports(spark, write_reports(tables, staging_path(spark, "reports"))))


_REPORT_KEYS = {"top_categories": ["family"], "city_growth": ["city", "year"], "category_breadth": ["unique_categories"],
                "promotion_impact": ["promotion_range"], "high_risk_orders": ["store_nbr", "family"],
                "city_totals": ["city"]}


def _cells_of(tables):
    """Every cell of the reports as (report, key, measure, value)."""
    cells = [df.select(F.lit(name).alias("report"), F.concat_ws("/", *_REPORT_KEYS[name]).alias("key"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
        for c in df.columns if c not in _REPORT_KEYS[name]])).alias("cell")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, cells).select("report", "key", "cell.*")


def _cube(spark, d):
    return checkpointed(cube.sales_cube(_sales(spark, d)))


def q_published_reports(spark, d):
    """Six reports derived from shared cells, published as one set and read back through its manifest."""
    sales = _sales(spark, d)
    cells, months = _cube(spark, d), cube.store_months(sales, **HIGH_RISK)
    tables = {
        "top_categories": cube.top_categories(cells),
        "city_growth": cube.city_growth(cells, ordered=False),
        "category_breadth": cube.category_breadth(cells, sales),
        "promotion_impact": cube.promotion_impact(cells),
        "high_risk_orders": cube.high_risk_orders(months),
        "city_totals": reports.city_totals(cells),
    }
    root = staging_path(spark, "published")
    outputs = OutputSet(spark, root)
    outputs.publish(write_reports(tables, outputs.folder))
    return _cells_of(read_published(spark, root))


def _forecast(spark, d, trees, depth=5):
    s = checkpointed(_split(spark, d))   # month grain; fit and prediction both read it
    model = fc.fit_forecast(s.where(F.col("split") == "train"), trees=trees, depth=depth)
    path = fc.save_model(model, staging_path(spark, "forecast_model"))
    return fc.predict(fc.load_model(path), s)


def q_forecast(spark, d):
    """The 100-tree model: one row per month, and whether its prediction is finite and within the training range."""
    return fc.within_range(_forecast(spark, d, FORECAST_TREES))


def q_forecast_stump(spark, d):
    """One tree of depth 1: its best split and leaf means can be stated in SQL."""
    p = _forecast(spark, d, 1, 1)
    return p.select("ds", "split", "actual", money_round("predicted", 2).alias("predicted"))


def q_forecast_two_stumps(spark, d):
    """Two trees of depth 1: the second fits what the first leaves, at the learning rate of 0.1."""
    p = _forecast(spark, d, 2, 1)
    return p.select("ds", "split", "actual", money_round("predicted", 2).alias("predicted"))


def _top_subgraph(spark, d):
    e = _edges_mean(spark, d)
    scores = checkpointed(graph.eigenvector_centrality(e))
    return checkpointed(graph.induced(e, graph.top_nodes(scores, k=100))), scores


def q_component_edges(spark, d):
    sub, _ = _top_subgraph(spark, d)
    return graph.component_edges(graph.vertices(sub), sub)


def q_node_profile(spark, d):
    sub, scores = _top_subgraph(spark, d)
    nodes = graph.largest_component(graph.vertices(sub), sub)
    return _round_scores(graph.node_profile(nodes, scores, _sales(spark, d, "family", "sales")))


def _kpis(spark, d):
    return reports.kpis(_sales(spark, d, "store_nbr", "family", "date", "sales", "transactions"))


def q_summary(spark, d):
    typed = checkpointed(_typed(spark, d))   # two diagnostics read it
    top = graph.top_nodes(_scores(spark, d), k=1).select("id", "score")
    return summary(
        kpis=_kpis(spark, d),
        invalid=diagnostics.invalid_counts(typed),
        duplicates=diagnostics.duplicate_groups(typed),
        ttest=_ttest(spark, d),
        top_node=_round_scores(top),
        metrics=stats.regression_metrics(_stump_predictions(spark, d), decimals=4),
    )


def q_chart_series(spark, d):
    return chart_series(
        split_series=_split(spark, d),
        predictions=_stump_predictions(spark, d),
        top_cities=reports.top_cities(_sales(spark, d, "city", "sales"), k=10),
        correlation=timeseries.correlation_matrix(_monthly(spark, d)),
    )


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources and cleaning
    "csv_scan": q_csv_scan,
    "csv_parts": q_csv_parts,
    "clean_drop_nulls": lambda s, d: cleaning.drop_nulls(_raw(s, d)),
    "clean_typed": _typed,
    "clean_valid": lambda s, d: cleaning.keep_valid(_typed(s, d)),
    "clean_dedup": lambda s, d: cleaning.dedup(_typed(s, d)),
    "clean_pipeline": lambda s, d: cleaning.clean(_raw(s, d)),
    "diag_invalid_counts": lambda s, d: diagnostics.invalid_counts(_typed(s, d)),
    "diag_duplicates": lambda s, d: diagnostics.duplicate_groups(_typed(s, d)),
    "diag_post_clean": lambda s, d: diagnostics.invalid_counts(cleaning.clean(_raw(s, d))),
    # reports
    "top_categories": lambda s, d: reports.top_categories(_categories(s, d), k=5),
    "city_growth": _growth,
    "city_choices": lambda s, d: reports.city_choices(reports.city_totals(_sales(s, d, "city", "sales")), k=10),
    "category_breadth_city": lambda s, d: reports.category_breadth(_sales(s, d, "city", "family", "sales", "transactions")),
    "city_growth_filtered": lambda s, d: reports.city_growth_for(_sales(s, d, "city", "date", "sales"), choices=10),
    "category_breadth": lambda s, d: reports.category_breadth(
        _customers(s, d), by="customer", min_categories=2, k=5),
    "promotion_impact": lambda s, d: reports.promotion_impact(_sales(s, d, "sales", "onpromotion")),
    "high_risk_orders": lambda s, d: reports.high_risk_orders(
        _sales(s, d, "store_nbr", "family", "sales", "transactions"), k=5, **HIGH_RISK),
    "city_totals": lambda s, d: reports.city_totals(_sales(s, d, "city", "sales")),
    "top_cities": lambda s, d: reports.top_cities(_sales(s, d, "city", "sales"), k=10),
    "kpi_cards": _kpis,
    "report_formatted": lambda s, d: format_report(_growth(s, d), "city_growth"),
    "report_formatted_top_categories": lambda s, d: format_report(
        reports.top_categories(_categories(s, d)), "top_categories"),
    "report_formatted_category_breadth": lambda s, d: format_report(
        reports.category_breadth(_customers(s, d), by="customer"), "category_breadth"),
    "report_formatted_promotion_impact": lambda s, d: format_report(
        reports.promotion_impact(_sales(s, d, "sales", "onpromotion")), "promotion_impact"),
    "report_formatted_high_risk_orders": lambda s, d: format_report(
        reports.high_risk_orders(_sales(s, d, "store_nbr", "family", "sales", "transactions"), **HIGH_RISK),
        "high_risk_orders"),
    # time series
    "monthly_sales": _monthly,
    "monthly_series": _series,
    "monthly_series_positional": lambda s, d: timeseries.monthly_series(_monthly(s, d), mode="positional"),
    "monthly_outliers_removed": _trimmed,
    "train_test_split": _split,
    "price_percentiles": q_price_percentiles,
    "line_split": q_line_split,
    "line_outliers_removed": q_line_outliers,
    "monthly_sales_from_cells": lambda s, d: cube.monthly_sales(cube.store_months(_sales(s, d))),
    "promo_correlation": lambda s, d: timeseries.correlation_matrix(_monthly(s, d)),
    # graph
    "copurchase_pairs": _pairs,
    "copurchase_pairs_wide": q_wide_pairs,
    "graph_edges": _edges_mean,
    "graph_vertices": lambda s, d: graph.vertices(_edges_mean(s, d)),
    "graph_centrality": lambda s, d: _round_scores(_scores(s, d)),
    "graph_centrality_topk": lambda s, d: _round_scores(graph.top_nodes(_scores(s, d), k=100)),
    "graph_subgraph": _subgraph,
    "graph_centrality_top10": lambda s, d: _round_scores(graph.top_nodes(_scores(s, d), k=TOP_NODES)),
    "graph_subgraph_top10": _top10_subgraph,
    "graph_component_edges_sparse": q_sparse_component_edges,
    "graph_components": lambda s, d: _components(s, d),
    "graph_largest_component": lambda s, d: _components(s, d, largest=True),
    "graph_component_edges": q_component_edges,
    "graph_node_profile": q_node_profile,
    # statistics and model
    "ttest_top_cities": _ttest,
    "ttest_from_cube": lambda s, d: cube.welch_ttest_top(_cube(s, d), decimals=4),
    "regression_metrics": lambda s, d: stats.regression_metrics(_naive_predictions(s, d), decimals=4),
    "forecast_features": lambda s, d: fc.features(_trimmed(s, d)),
    "forecast_predict": q_forecast,
    "forecast_stump": q_forecast_stump,
    "forecast_two_stumps": q_forecast_two_stumps,
    "forecast_values": lambda s, d: _forecast(s, d, FORECAST_TREES),
    # sinks
    "sink_report_tables": q_report_sink,
    "sink_published_reports": q_published_reports,
    "chart_series": q_chart_series,
    "report_summary": q_summary,
}


def entry(spark: SparkSession) -> DataFrame:
    return reports.top_categories(_categories(spark, SMOKE_DIR), k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_LLM_QUERIES}


# --------------------------------------------------------------------------
# DuckDB oracle side
# --------------------------------------------------------------------------

def _mr(expr: str, n: int = 2) -> str:
    """Same decimal-exact rounding as ``money_round``."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,8)), {n}) AS DOUBLE)"


def _cur(expr: str) -> str:
    return f"('$' || format('{{:,}}', CAST(trunc({expr}) AS BIGINT)))"


def _f4(expr: str) -> str:
    return f"printf('%.4f', {expr})"


_JOINED = """
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey"""

SALES = f"""sales AS (
  SELECT l.l_suppkey AS store_nbr, p.p_brand AS family, n.n_name AS city,
         CAST(l.l_shipdate AS DATE) AS date, l.l_extendedprice AS sales,
         CAST(l.l_quantity AS INTEGER) AS transactions,
         ROUND(l.l_discount * 1000) AS onpromotion{_JOINED})"""

SALES_CUST = f"""sales_c AS (
  SELECT p.p_brand AS family, l.l_extendedprice AS sales,
         CAST(l.l_quantity AS INTEGER) AS transactions, o.o_custkey AS customer{_JOINED}
  JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

RAW = f"""raw1 AS (
  SELECT CAST(l.l_suppkey AS VARCHAR) AS store_nbr, p.p_brand AS family,
         CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE n.n_name END AS city,
         CASE WHEN l.l_orderkey % 71 = 0 THEN '13/45/2014'
              ELSE strftime(l.l_shipdate, '%m/%d/%Y') END AS date,
         CASE WHEN l.l_orderkey % 61 = 0 THEN '1e400'
              WHEN l.l_orderkey % 67 = 0 THEN 'Infinity'
              WHEN l.l_orderkey % 73 = 0 THEN 'n/a'
              WHEN l.l_orderkey % 79 = 0 THEN printf('%.2f', -l.l_extendedprice)
              WHEN l.l_orderkey % 89 = 0 THEN '0'
              ELSE printf('%.2f', l.l_extendedprice) END AS sales,
         CASE WHEN l.l_orderkey % 83 = 0 THEN '0'
              ELSE CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) END AS transactions,
         CAST(CAST(ROUND(l.l_discount * 1000) AS INTEGER) AS VARCHAR) AS onpromotion,
         l.l_orderkey AS k{_JOINED}),
raw AS (
  SELECT store_nbr, family, city, date, sales, transactions, onpromotion FROM raw1
  UNION ALL
  SELECT store_nbr, family, city, date, sales, transactions, onpromotion FROM raw1 WHERE k % 50 = 0)"""

TYPED = RAW + """,
nonnull AS (
  SELECT * FROM raw
  WHERE store_nbr IS NOT NULL AND family IS NOT NULL AND city IS NOT NULL AND date IS NOT NULL
    AND sales IS NOT NULL AND transactions IS NOT NULL AND onpromotion IS NOT NULL),
typed AS (
  SELECT store_nbr, family, city,
         CAST(try_strptime(trim(date), '%m/%d/%Y') AS DATE) AS date,
         CASE WHEN isfinite(TRY_CAST(sales AS DOUBLE)) THEN TRY_CAST(sales AS DOUBLE) END AS sales,
         TRY_CAST(trunc(CASE WHEN isnan(TRY_CAST(transactions AS DOUBLE)) THEN NULL
                             ELSE TRY_CAST(transactions AS DOUBLE) END) AS INTEGER) AS transactions,
         CASE WHEN isnan(TRY_CAST(onpromotion AS DOUBLE)) THEN NULL
              ELSE TRY_CAST(onpromotion AS DOUBLE) END AS onpromotion
  FROM nonnull)"""

CLEAN = TYPED + """,
clean AS (
  SELECT DISTINCT * FROM typed WHERE sales > 0 AND transactions > 0)"""

_INVALID = """SELECT COUNT(*) FILTER (WHERE sales = 0 AND transactions > 0) AS zero_sales_with_tx,
       COUNT(*) FILTER (WHERE sales > 0 AND transactions = 0) AS sales_with_zero_tx
FROM {src}"""

_DUPS = """SELECT store_nbr, family, date, sales, transactions, onpromotion, COUNT(*) AS count
FROM typed GROUP BY store_nbr, family, date, sales, transactions, onpromotion HAVING COUNT(*) > 1"""

TOP_CATEGORIES = f"""top_categories AS (
  SELECT family, {_mr('SUM(sales)')} AS total_sales,
         {_mr('SUM(sales) * (1 - AVG(onpromotion) / 100)')} AS approx_profit
  FROM sales WHERE sales IS NOT NULL GROUP BY family
  ORDER BY approx_profit DESC, total_sales DESC, family LIMIT 5)"""

CITY_GROWTH = f"""yearly AS (
  SELECT city, CAST(year(date) AS INTEGER) AS year, {_mr('AVG(sales)')} AS avg_sales
  FROM sales WHERE date IS NOT NULL GROUP BY city, year(date)),
city_growth AS (
  SELECT city, avg_sales, year,
         {_mr('(avg_sales - LAG(avg_sales) OVER w) / NULLIF(LAG(avg_sales) OVER w, 0) * 100')}
           AS growth_rate_percent
  FROM yearly WINDOW w AS (PARTITION BY city ORDER BY year))"""

CITY_TOTALS = f"""city_totals AS (
  SELECT city, {_mr('SUM(sales)')} AS total_sales FROM sales WHERE city IS NOT NULL GROUP BY city)"""

TOP_CITIES = CITY_TOTALS + """,
top_cities AS (SELECT * FROM city_totals ORDER BY total_sales DESC, city LIMIT 10)"""

BREADTH = f"""per_place AS (
  SELECT customer, COUNT(DISTINCT family) AS unique_categories,
         COUNT(DISTINCT transactions) AS distinct_tx
  FROM sales_c WHERE sales IS NOT NULL GROUP BY customer HAVING COUNT(DISTINCT family) > 2),
category_breadth AS (
  SELECT unique_categories, COUNT(customer) AS city_count, {_mr('AVG(distinct_tx)', 0)} AS avg_distinct_tx
  FROM per_place GROUP BY unique_categories ORDER BY unique_categories LIMIT 5)"""

PROMO = f"""promotion_impact AS (
  SELECT CASE WHEN onpromotion = 0 THEN 'No Promotion'
              WHEN onpromotion <= 10 THEN 'Low Promotion (0-10)'
              WHEN onpromotion <= 50 THEN 'Medium Promotion (11-50)'
              ELSE 'High Promotion (>50)' END AS promotion_range,
         {_mr('SUM(sales)')} AS total_sales, {_mr('AVG(sales)')} AS avg_sales
  FROM sales WHERE sales IS NOT NULL GROUP BY 1)"""

HIGH_RISK_SQL = f"""high_risk AS (
  SELECT store_nbr, family, {_mr('SUM(sales)')} AS sales, CAST(SUM(transactions) AS BIGINT) AS transactions
  FROM sales
  WHERE (sales < {HIGH_RISK['max_sales']} OR transactions < {HIGH_RISK['max_transactions']})
    AND sales > 0 AND transactions > 0
  GROUP BY store_nbr, family
  ORDER BY sales, transactions, store_nbr, family LIMIT 5)"""

MONTHLY = f"""monthly0 AS (
  SELECT CAST(date_trunc('month', date) AS DATE) AS ds, store_nbr, family,
         {_mr('SUM(sales)')} AS total_sales, {_mr('AVG(onpromotion)')} AS avg_promotion
  FROM sales WHERE date IS NOT NULL GROUP BY 1, 2, 3),
monthly AS (
  SELECT CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, store_nbr, family,
         total_sales, avg_promotion, ds
  FROM monthly0 WHERE total_sales > 0)"""

SERIES = MONTHLY + f""",
series AS (
  SELECT ds, {_mr('SUM(total_sales)')} AS y, {_mr('AVG(avg_promotion)', 4)} AS avg_promotion
  FROM monthly GROUP BY ds),
trimmed AS (
  SELECT * FROM series WHERE y <= (SELECT quantile_cont(y, 0.95) FROM series)),
split AS (
  SELECT ds, y, avg_promotion,
         CASE WHEN ROW_NUMBER() OVER (ORDER BY ds) <= FLOOR(COUNT(*) OVER () * 0.8)
              THEN 'train' ELSE 'test' END AS split
  FROM trimmed)"""

_CORR_COLS = ("total_sales", "avg_promotion")


def _corr_body(src: str) -> str:
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa = f"CASE WHEN {both} THEN {a} END"
            xb = f"CASE WHEN {both} THEN {b} END"
            r = f"covar_pop({xa}, {xb}) / NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0)"
            parts.append(f"SELECT '{a}' AS \"row\", '{b}' AS col, {_mr(r, 6)} AS corr FROM {src}")
    return "\nUNION ALL\n".join(parts)


PAIRS = f"""pairs AS (
  SELECT t1.family AS src, t2.family AS dst, {_mr('SUM(t1.sales)')} AS weight
  FROM sales t1 JOIN sales t2
    ON t1.store_nbr = t2.store_nbr AND t1.date = t2.date AND t1.family < t2.family
  GROUP BY t1.family, t2.family)"""

EDGES_MEAN = PAIRS + """,
edges AS (
  SELECT src, dst, COALESCE(weight, 1.0) AS weight FROM pairs
  WHERE COALESCE(weight, 1.0) > (SELECT AVG(weight) FROM pairs))"""

EDGES_SPARSE = PAIRS + f""",
edges_s AS (
  SELECT src, dst, COALESCE(weight, 1.0) AS weight FROM pairs
  WHERE COALESCE(weight, 1.0) > (SELECT AVG(weight) + {COMPONENT_SIGMAS} * STDDEV_SAMP(weight) FROM pairs))"""

_POWER_STEPS = 100
_POWER_TOL = 1e-6


def _centrality_ctes(edges: str = "edges") -> str:
    """Power iteration on (A + I) unrolled as materialized steps."""
    out = [f"""adj AS MATERIALIZED (
  SELECT src, dst, weight AS w FROM {edges}
  UNION ALL SELECT dst, src, weight FROM {edges} WHERE src <> dst)""",
           "nodes AS MATERIALIZED (SELECT DISTINCT src AS id FROM adj)",
           "x0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT COUNT(*) FROM nodes) AS x FROM nodes)"]
    for i in range(1, _POWER_STEPS + 1):
        out.append(f"""y{i} AS MATERIALIZED (
  SELECT p.id, p.x + COALESCE(c.c, 0) AS y FROM x{i-1} p
  LEFT JOIN (SELECT a.dst AS id, SUM(a.w * q.x) AS c FROM adj a JOIN x{i-1} q ON a.src = q.id
             GROUP BY a.dst) c ON p.id = c.id)""")
        out.append(f"x{i} AS MATERIALIZED (SELECT id, y / (SELECT SQRT(SUM(y * y)) FROM y{i}) AS x FROM y{i})")
    # stop where the reference stops: the first step whose L1 change is under n * tol
    steps = "\n  UNION ALL ".join(
        f"SELECT {i} AS step, (SELECT SUM(ABS(a.x - b.x)) FROM x{i} a JOIN x{i-1} b ON a.id = b.id) AS d"
        for i in range(1, _POWER_STEPS + 1))
    iterates = "\n  UNION ALL ".join(f"SELECT {i} AS step, id, x FROM x{i}" for i in range(1, _POWER_STEPS + 1))
    out.append(f"deltas AS MATERIALIZED (\n  {steps})")
    out.append(f"iterates AS MATERIALIZED (\n  {iterates})")
    out.append(f"""scores AS (
  SELECT id, x AS score FROM iterates
  WHERE step = (SELECT MIN(step) FROM deltas WHERE d < (SELECT COUNT(*) FROM nodes) * {_POWER_TOL}))""")
    return ",\n".join(out)


CENTRALITY = EDGES_MEAN + ",\n" + _centrality_ctes("edges")

TOPK = CENTRALITY + """,
topk AS (
  SELECT id, score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM scores ORDER BY score DESC, id LIMIT 100),
subgraph AS (
  SELECT src, dst, weight FROM edges
  WHERE src IN (SELECT id FROM topk) AND dst IN (SELECT id FROM topk))"""


def _components_ctes(edges: str, name: str) -> str:
    return f"""{name}_adj AS (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
{name}_v AS (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges}),
{name}_reach AS (
  SELECT id, id AS r FROM {name}_v
  UNION
  SELECT x.id, a.dst FROM {name}_reach x JOIN {name}_adj a ON x.r = a.src),
{name} AS (SELECT id, MIN(r) AS component FROM {name}_reach GROUP BY id),
{name}_largest AS (
  SELECT id FROM {name} WHERE component = (
    SELECT component FROM {name} GROUP BY component ORDER BY COUNT(*) DESC, component LIMIT 1))"""


TTEST = TOP_CITIES + f""",
pair AS (
  SELECT city, ROW_NUMBER() OVER (ORDER BY total_sales DESC, city) AS rk
  FROM (SELECT * FROM city_totals ORDER BY total_sales DESC, city LIMIT 2)),
moments AS (
  SELECT s.city, pr.rk, COUNT(s.sales) AS n, AVG(s.sales) AS m, VAR_SAMP(s.sales) AS v
  FROM sales s JOIN pair pr ON s.city = pr.city WHERE s.sales IS NOT NULL GROUP BY s.city, pr.rk),
one AS (
  SELECT MAX(CASE WHEN rk = 1 THEN city END) AS group1, MAX(CASE WHEN rk = 2 THEN city END) AS group2,
         MAX(CASE WHEN rk = 1 THEN n END) AS n1, MAX(CASE WHEN rk = 2 THEN n END) AS n2,
         MAX(CASE WHEN rk = 1 THEN m END) AS m1, MAX(CASE WHEN rk = 2 THEN m END) AS m2,
         MAX(CASE WHEN rk = 1 THEN v END) AS v1, MAX(CASE WHEN rk = 2 THEN v END) AS v2
  FROM moments),
tt AS (
  SELECT group1, group2, (m1 - m2) / SQRT(v1 / n1 + v2 / n2) AS t,
         POW(v1 / n1 + v2 / n2, 2) / (POW(v1 / n1, 2) / (n1 - 1) + POW(v2 / n2, 2) / (n2 - 1)) AS dof
  FROM one WHERE group1 IS NOT NULL AND group2 IS NOT NULL),
grid AS (SELECT i FROM range(0, 20001) r(i)),
simpson AS (
  SELECT tt.group1, tt.group2, tt.t, tt.dof,
         SUM(CASE WHEN g.i = 0 OR g.i = 20000 THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END
             * EXP(lgamma((tt.dof + 1) / 2) - lgamma(tt.dof / 2) - 0.5 * LN(tt.dof * PI())
                   - (tt.dof + 1) / 2 * LN(1 + POW(g.i * ABS(tt.t) / 20000, 2) / tt.dof)))
         * (ABS(tt.t) / 20000) / 3 AS half_mass
  FROM tt CROSS JOIN grid g GROUP BY tt.group1, tt.group2, tt.t, tt.dof),
ttest AS (
  SELECT group1, group2, {_mr('t', 4)} AS t, {_mr('dof', 4)} AS df,
         {_mr('GREATEST(0.0, LEAST(1.0, 1 - 2 * half_mass))', 4)} AS p
  FROM simpson)"""


# Display labels as the original report printed them, stated here on their own so that a wrong
# label on the Spark side shows.
_LABELS = {
    ("top_categories", "family"): "Product Category",
    ("top_categories", "total_sales"): "Total Sales",
    ("top_categories", "approx_profit"): "Approximate Profit",
    ("city_growth", "city"): "City",
    ("city_growth", "avg_sales"): "Average Sales",
    ("city_growth", "year"): "Year",
    ("city_growth", "growth_rate_percent"): "Annual Growth Rate (%)",
    ("category_breadth", "unique_categories"): "Number of Product Categories",
    ("category_breadth", "city_count"): "Number of Cities",
    ("category_breadth", "avg_distinct_tx"): "Average Transactions per City",
    ("promotion_impact", "promotion_range"): "Promotion Range",
    ("promotion_impact", "total_sales"): "Total Sales",
    ("promotion_impact", "avg_sales"): "Average Sales",
    ("high_risk_orders", "store_nbr"): "Store Number",
    ("high_risk_orders", "family"): "Product Category",
    ("high_risk_orders", "sales"): "Sales",
    ("high_risk_orders", "transactions"): "Transactions",
}


def _lab(report: str, col: str) -> str:
    """Quoted display label of ``col`` in ``report``."""
    return '"' + _LABELS[report, col] + '"'


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _w_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    raw_cols = "store_nbr, family, city, date, sales, transactions, onpromotion"
    o["csv_parts"] = _w(RAW) + f"SELECT {raw_cols} FROM raw"
    o["csv_scan"] = _w(RAW) + f"SELECT {raw_cols} FROM raw"
    o["clean_drop_nulls"] = _w(TYPED) + f"SELECT {raw_cols} FROM nonnull"
    o["clean_typed"] = _w(TYPED) + "SELECT * FROM typed"
    o["clean_valid"] = _w(TYPED) + "SELECT * FROM typed WHERE sales > 0 AND transactions > 0"
    o["clean_dedup"] = _w(TYPED) + "SELECT DISTINCT * FROM typed"
    o["clean_pipeline"] = _w(CLEAN) + "SELECT * FROM clean"
    o["diag_invalid_counts"] = _w(TYPED) + _INVALID.format(src="typed")
    o["diag_duplicates"] = _w(TYPED) + _DUPS
    o["diag_post_clean"] = _w(CLEAN) + _INVALID.format(src="clean")

    o["top_categories"] = _w(SALES, TOP_CATEGORIES) + "SELECT * FROM top_categories"
    o["city_growth"] = _w(SALES, CITY_GROWTH) + "SELECT * FROM city_growth"
    o["city_growth_filtered"] = _w(SALES, CITY_GROWTH, TOP_CITIES) + """SELECT * FROM city_growth
WHERE city = (SELECT city FROM top_cities ORDER BY city LIMIT 1)"""
    o["city_choices"] = _w(SALES, TOP_CITIES) + "SELECT city FROM top_cities"
    o["category_breadth_city"] = _w(SALES) + f"""SELECT unique_categories, COUNT(city) AS city_count,
       {_mr('AVG(distinct_tx)', 0)} AS avg_distinct_tx
FROM (SELECT city, COUNT(DISTINCT family) AS unique_categories, COUNT(DISTINCT transactions) AS distinct_tx
      FROM sales WHERE sales IS NOT NULL GROUP BY city HAVING COUNT(DISTINCT family) > 2)
GROUP BY unique_categories ORDER BY unique_categories LIMIT 5"""
    o["category_breadth"] = _w(SALES_CUST, BREADTH) + "SELECT * FROM category_breadth"
    o["promotion_impact"] = _w(SALES, PROMO) + "SELECT * FROM promotion_impact"
    o["high_risk_orders"] = _w(SALES, HIGH_RISK_SQL) + "SELECT * FROM high_risk"
    o["city_totals"] = _w(SALES, CITY_TOTALS) + "SELECT * FROM city_totals"
    o["top_cities"] = _w(SALES, TOP_CITIES) + "SELECT * FROM top_cities"
    o["kpi_cards"] = _w(SALES, MONTHLY) + f"""SELECT {_mr('SUM(total_sales)')} AS total_sales,
       {_mr('AVG(total_sales)')} AS avg_group_sales,
       (SELECT COUNT(transactions) FROM sales) AS n_records,
       CAST(MIN(year) AS VARCHAR) || '-' || CAST(MAX(year) AS VARCHAR) AS period
FROM monthly"""
    g = "city_growth"
    o["report_formatted"] = _w(SALES, CITY_GROWTH) + f"""SELECT city AS {_lab(g, 'city')},
       {_cur('avg_sales')} AS {_lab(g, 'avg_sales')}, year AS {_lab(g, 'year')},
       COALESCE(format('{{:,.2f}}', growth_rate_percent) || '%', 'N/A') AS {_lab(g, 'growth_rate_percent')}
FROM city_growth"""
    g = "top_categories"
    o["report_formatted_top_categories"] = _w(SALES, TOP_CATEGORIES) + f"""SELECT family AS {_lab(g, 'family')},
       {_cur('total_sales')} AS {_lab(g, 'total_sales')}, {_cur('approx_profit')} AS {_lab(g, 'approx_profit')}
FROM top_categories"""
    g = "category_breadth"
    o["report_formatted_category_breadth"] = _w(SALES_CUST, BREADTH) + f"""SELECT
       unique_categories AS {_lab(g, 'unique_categories')}, city_count AS {_lab(g, 'city_count')},
       CAST(avg_distinct_tx AS INTEGER) AS {_lab(g, 'avg_distinct_tx')}
FROM category_breadth"""
    g = "promotion_impact"
    o["report_formatted_promotion_impact"] = _w(SALES, PROMO) + f"""SELECT
       promotion_range AS {_lab(g, 'promotion_range')}, {_cur('total_sales')} AS {_lab(g, 'total_sales')},
       {_cur('avg_sales')} AS {_lab(g, 'avg_sales')}
FROM promotion_impact"""
    g = "high_risk_orders"
    o["report_formatted_high_risk_orders"] = _w(SALES, HIGH_RISK_SQL) + f"""SELECT
       store_nbr AS {_lab(g, 'store_nbr')}, family AS {_lab(g, 'family')}, {_cur('sales')} AS {_lab(g, 'sales')},
       transactions AS {_lab(g, 'transactions')}
FROM high_risk"""

    o["monthly_sales"] = _w(SALES, MONTHLY) + "SELECT * FROM monthly"
    o["monthly_series"] = _w(SALES, SERIES) + "SELECT * FROM series"
    o["monthly_series_positional"] = _w(SALES, SERIES) + """SELECT
       CAST(MIN(ds) OVER () + TO_MONTHS(CAST(ROW_NUMBER() OVER (ORDER BY ds) - 1 AS INTEGER)) AS DATE) AS ds,
       y, avg_promotion
FROM series"""
    o["monthly_outliers_removed"] = _w(SALES, SERIES) + "SELECT * FROM trimmed"
    o["train_test_split"] = _w(SALES, SERIES) + "SELECT * FROM split"
    o["price_percentiles"] = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS measure, CAST({q} AS DOUBLE) AS q, {_mr(f'quantile_cont({c}, {q})', 4)} AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity") for q in PERCENTILES)
    o["line_split"] = """SELECT l_orderkey, l_linenumber,
       CASE WHEN ROW_NUMBER() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) <= FLOOR(COUNT(*) OVER () * 0.8)
            THEN 'train' ELSE 'test' END AS split
FROM lineitem"""
    o["line_outliers_removed"] = """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)"""
    o["promo_correlation"] = _w(SALES, MONTHLY) + _corr_body("monthly")

    o["copurchase_pairs"] = _w(SALES, PAIRS) + "SELECT * FROM pairs"
    o["copurchase_pairs_wide"] = f"""WITH a AS (
  SELECT s_nationkey AS city, concat(p_brand, '/', p_size) AS article, l_extendedprice AS sales
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT x.article AS src, y.article AS dst, {_mr('SUM(x.sales)')} AS weight
FROM a x JOIN a y ON x.city = y.city AND x.article < y.article GROUP BY x.article, y.article"""
    o["graph_edges"] = _w(SALES, EDGES_MEAN) + "SELECT * FROM edges"
    o["graph_vertices"] = _w(SALES, EDGES_MEAN) + "SELECT src AS id FROM edges UNION SELECT dst FROM edges"
    o["graph_centrality"] = _w(SALES, CENTRALITY) + f"SELECT id, {_mr('score', 4)} AS score FROM scores"
    o["graph_centrality_topk"] = _w(SALES, TOPK) + f"SELECT id, {_mr('score', 4)} AS score, rank FROM topk"
    o["graph_subgraph"] = _w(SALES, TOPK) + "SELECT * FROM subgraph"
    o["graph_centrality_top10"] = _w(SALES, TOPK) + f"""SELECT id, {_mr('score', 4)} AS score, rank
FROM topk WHERE rank <= {TOP_NODES}"""
    top10 = f"(SELECT id FROM topk WHERE rank <= {TOP_NODES})"
    o["graph_subgraph_top10"] = _w(SALES, TOPK) + f"SELECT * FROM edges WHERE src IN {top10} AND dst IN {top10}"
    o["graph_component_edges_sparse"] = _w_rec(SALES, EDGES_SPARSE, _components_ctes("edges_s", "comp")) + """
SELECT * FROM edges_s WHERE src IN (SELECT id FROM comp_largest) AND dst IN (SELECT id FROM comp_largest)"""
    o["graph_components"] = _w_rec(SALES, EDGES_SPARSE, _components_ctes("edges_s", "comp")) + \
        "SELECT id, component FROM comp"
    o["graph_largest_component"] = _w_rec(SALES, EDGES_SPARSE, _components_ctes("edges_s", "comp")) + \
        "SELECT id FROM comp_largest"
    o["graph_node_profile"] = _w_rec(SALES, TOPK, _components_ctes("subgraph", "sub")) + f""",
totals AS (
  SELECT family AS id, {_mr('SUM(sales)')} AS total_sales FROM sales
  WHERE family IN (SELECT id FROM sub_largest) GROUP BY family)
SELECT l.id, COALESCE(t.total_sales, 0.0) AS total_sales, {_mr('s.score', 4)} AS score
FROM sub_largest l LEFT JOIN totals t ON l.id = t.id LEFT JOIN scores s ON l.id = s.id"""

    o["ttest_top_cities"] = _w(SALES, TTEST) + "SELECT * FROM ttest"
    o["regression_metrics"] = _w(SALES, SERIES) + f""",
pred AS (SELECT ds, split, y AS actual, LAG(y) OVER (ORDER BY ds) AS predicted FROM split),
ok AS (SELECT * FROM pred WHERE actual IS NOT NULL AND predicted IS NOT NULL)
SELECT split, {_mr('SQRT(AVG((actual - predicted) * (actual - predicted)))', 4)} AS rmse,
       {_mr('1 - SUM((actual - predicted) * (actual - predicted)) / NULLIF(VAR_POP(actual) * COUNT(actual), 0)', 4)} AS r2
FROM ok GROUP BY split"""
    o["forecast_features"] = _w(SALES, SERIES) + """SELECT ds, CAST(month(ds) AS INTEGER) AS month,
       CAST(year(ds) AS INTEGER) AS year, y, avg_promotion FROM trimmed"""

    cells = [("top_categories", "top_categories", "family", ("total_sales", "approx_profit")),
             ("city_growth", "city_growth", "city || '/' || year", ("avg_sales", "growth_rate_percent")),
             ("category_breadth", "category_breadth", "CAST(unique_categories AS VARCHAR)", ("city_count", "avg_distinct_tx")),
             ("promotion_impact", "promotion_impact", "promotion_range", ("total_sales", "avg_sales")),
             ("high_risk_orders", "high_risk", "store_nbr || '/' || family", ("sales", "transactions"))]
    o["sink_report_tables"] = _w(SALES, SALES_CUST, TOP_CATEGORIES, CITY_GROWTH, BREADTH, PROMO,
                                 HIGH_RISK_SQL) + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, {key} AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {cte}"
        for name, cte, key, measures in cells for m in measures)
    by_city = o["category_breadth_city"].removeprefix(_w(SALES))
    published = [("category_breadth", "category_breadth_city", "CAST(unique_categories AS VARCHAR)",
                  ("city_count", "avg_distinct_tx")), ("city_totals", "city_totals", "city", ("total_sales",)),
                 *[c for c in cells if c[0] != "category_breadth"]]
    o["sink_published_reports"] = _w(SALES, TOP_CATEGORIES, CITY_GROWTH, PROMO, HIGH_RISK_SQL, CITY_TOTALS,
                                     f"category_breadth_city AS ({by_city})") + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, {key} AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {cte}"
        for name, cte, key, measures in published for m in measures)
    o["ttest_from_cube"] = o["ttest_top_cities"]
    o["monthly_sales_from_cells"] = o["monthly_sales"]
    o["forecast_predict"] = _w(SALES, SERIES) + "SELECT ds, split, y AS actual, TRUE AS in_range FROM split"
    # regression stump: over both features and all midpoints between neighbouring values, the split of least squared error
    stump = f""",
f AS (SELECT ds, split, y, unnest([month(ds), year(ds)]) AS v, unnest(['month', 'year']) AS feature FROM split),
tr AS (SELECT * FROM f WHERE split = 'train'),
vals AS (SELECT feature, v, LEAD(v) OVER (PARTITION BY feature ORDER BY v) AS nxt
         FROM (SELECT DISTINCT feature, v FROM tr)),
cand AS (SELECT feature, (v + nxt) / 2.0 AS cut FROM vals WHERE nxt IS NOT NULL),
sides AS (
  SELECT c.feature, c.cut, AVG(CASE WHEN t.v <= c.cut THEN y END) AS lo, AVG(CASE WHEN t.v > c.cut THEN y END) AS hi,
         COALESCE(VAR_POP(CASE WHEN t.v <= c.cut THEN y END) * COUNT(CASE WHEN t.v <= c.cut THEN y END), 0)
         + COALESCE(VAR_POP(CASE WHEN t.v > c.cut THEN y END) * COUNT(CASE WHEN t.v > c.cut THEN y END), 0) AS sse
  FROM cand c JOIN tr t ON c.feature = t.feature GROUP BY c.feature, c.cut),
best AS (SELECT * FROM sides ORDER BY sse LIMIT 1),
pred AS (
  SELECT f.ds, f.split, f.y AS actual, {_mr('CASE WHEN f.v <= b.cut THEN b.lo ELSE b.hi END')} AS predicted
  FROM f JOIN best b ON f.feature = b.feature)"""
    o["forecast_stump"] = _w(SALES, SERIES) + stump + " SELECT * FROM pred"
    # boosting by squared error: the second tree fits twice the residuals of the first
    o["forecast_two_stumps"] = _w(SALES, SERIES) + stump + f""",
first_tree AS (
  SELECT f.ds, CASE WHEN f.v <= b.cut THEN b.lo ELSE b.hi END AS p FROM f JOIN best b ON f.feature = b.feature),
rest AS (SELECT f.*, a.p, 2 * (f.y - a.p) AS r FROM f JOIN first_tree a ON f.ds = a.ds),
means AS (
  SELECT c.feature, c.cut, AVG(r) FILTER (WHERE t.v <= c.cut) AS lo, AVG(r) FILTER (WHERE t.v > c.cut) AS hi,
         COUNT(*) FILTER (WHERE t.v <= c.cut) AS n_lo, COUNT(*) FILTER (WHERE t.v > c.cut) AS n_hi
  FROM cand c JOIN rest t ON c.feature = t.feature AND t.split = 'train' GROUP BY c.feature, c.cut),
second_tree AS (SELECT * FROM means ORDER BY n_lo * lo * lo + n_hi * hi * hi DESC LIMIT 1)
SELECT t.ds, t.split, t.y AS actual,
       {_mr("t.p + 0.1 * CASE WHEN t.v <= b.cut THEN b.lo ELSE b.hi END")} AS predicted
FROM rest t JOIN second_tree b ON t.feature = b.feature"""
    o["graph_component_edges"] = _w_rec(SALES, TOPK, _components_ctes("subgraph", "sub")) + """
SELECT * FROM subgraph WHERE src IN (SELECT id FROM sub_largest) AND dst IN (SELECT id FROM sub_largest)"""
    o["chart_series"] = _w(SALES, SERIES, TOP_CITIES) + stump + f""",
corr AS ({_corr_body('monthly')})
SELECT 'train_test' AS chart,
       CASE WHEN split = 'train' THEN 'Train Data' ELSE 'Test Data' END AS series,
       strftime(ds, '%Y-%m-%d') AS x, y FROM split
UNION ALL SELECT 'sales_trend', 'Total Sales', strftime(ds, '%Y-%m-%d'), y FROM split
UNION ALL SELECT 'sales_by_city', 'Total Sales', city, total_sales FROM top_cities
UNION ALL SELECT 'actual_vs_predicted', CASE WHEN split = 'train' THEN 'Actual Train Sales' ELSE 'Actual Test Sales' END,
       strftime(ds, '%Y-%m-%d'), actual FROM pred
UNION ALL SELECT 'actual_vs_predicted', CASE WHEN split = 'train' THEN 'Predicted Train Sales' ELSE 'Predicted Test Sales' END,
       strftime(ds, '%Y-%m-%d'), predicted FROM pred
UNION ALL SELECT 'correlation', "row", col, corr FROM corr"""
    o["report_summary"] = _w(SALES, CLEAN, SERIES, TTEST, CENTRALITY) + stump + f""",
model AS (
  SELECT split, {_mr('SQRT(AVG((actual - predicted) * (actual - predicted)))', 4)} AS rmse,
         {_mr('1 - SUM((actual - predicted) * (actual - predicted)) / NULLIF(VAR_POP(actual) * COUNT(actual), 0)', 4)} AS r2
  FROM pred WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY split),
kpi AS (
  SELECT {_mr('SUM(total_sales)')} AS total_sales, {_mr('AVG(total_sales)')} AS avg_group_sales,
         (SELECT COUNT(transactions) FROM sales) AS n_records,
         CAST(MIN(year) AS VARCHAR) || '-' || CAST(MAX(year) AS VARCHAR) AS period
  FROM monthly),
inv AS ({_INVALID.format(src='typed')}),
dup AS (SELECT COUNT(*) AS n FROM ({_DUPS})),
top1 AS (SELECT id, {_mr('score', 4)} AS score FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 1))
SELECT 'kpi' AS section, 'total_sales' AS metric, {_cur('total_sales')} AS value FROM kpi
UNION ALL SELECT 'kpi', 'avg_group_sales', {_cur('avg_group_sales')} FROM kpi
UNION ALL SELECT 'kpi', 'n_records', format('{{:,}}', n_records) FROM kpi
UNION ALL SELECT 'kpi', 'period', period FROM kpi
UNION ALL SELECT 'cleaning', 'zero_sales_with_tx', CAST(zero_sales_with_tx AS VARCHAR) FROM inv
UNION ALL SELECT 'cleaning', 'sales_with_zero_tx', CAST(sales_with_zero_tx AS VARCHAR) FROM inv
UNION ALL SELECT 'cleaning', 'duplicate_groups', CAST(n AS VARCHAR) FROM dup
UNION ALL SELECT 'model', split || '_rmse', {_f4('rmse')} FROM model
UNION ALL SELECT 'model', split || '_r2', {_f4('r2')} FROM model
UNION ALL SELECT 'ttest', 'groups', group1 || ' vs ' || group2 FROM ttest
UNION ALL SELECT 'ttest', 't', {_f4('t')} FROM ttest
UNION ALL SELECT 'ttest', 'p_value', {_f4('p')} FROM ttest
UNION ALL SELECT 'centrality', 'top_category', id FROM top1
UNION ALL SELECT 'centrality', 'score', {_f4('score')} FROM top1
UNION ALL SELECT 'recommendation', 'inventory',
       'Increase inventory for ' || id || ' due to high sales impact.' FROM top1
UNION ALL SELECT 'recommendation', 'marketing',
       'Focus marketing efforts in ' || group1 || ' as it has significantly higher sales (T-Test p-value: ' || {_f4('p')} || ').' FROM ttest"""
    return o


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query. No entry for ``forecast_values`` (the predictions of 100 boosted trees)."""
    return {**_oracles(), **_LLM_ORACLES}
