"""The whole report job, from raw text rows to written outputs.

Shape of the job (each arrow a Spark job or a few; nothing collected):

  raw text --cast--> typed  [written]  --> diagnostics (invalid counts, duplicate groups)
                       |
                       +--valid + dedup--> clean  [written], read four times:
                                             |--> cells by place, category, year, promotion [checkpoint]
                                             |      --> top categories, growth, totals, promotion impact, t-test,
                                             |          node profile, checks, record count, categories per place
                                             |--> cells by store, category, month [written] --> low-value orders
                                             |      --> monthly facts --> series --> trim --> split, KPIs
                                             |                   |--> correlation
                                             |                   '--> GBT fit / predict / metrics
                                             |--> distinct transaction values per place --> breadth
                                             '--> co-purchase pairs --> edges --> centrality --> top-k
                                                                 --> subgraph --> largest component
  outputs: report tables, chart data (by chart), summary, model: one set, published by its manifest at the end

The typed and clean tables are written once to the shared staging folder:
every later job reads a columnar, pruned source instead of re-parsing the
text and repeating the de-duplication shuffle, and a lost executor costs at
most the job it was running.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions.formatting import format_report
from tillsight.operators import cleaning, cube, diagnostics, graph, reports, stats, timeseries
from tillsight.operators import forecast as fc
from tillsight.session import checkpointed, delete_path, staging_path
from tillsight.sinks import OutputSet, chart_series, read_reports, summary, write_chart_series, write_reports


@dataclass
class ReportParams:
    """Thresholds; defaults are the original job's values."""
    date_format: str = cleaning.DEFAULT_DATE_FORMAT
    place: str = "city"
    top_k_categories: int = 5
    breadth_min_categories: int = 2
    breadth_k: int = 5
    promo_cuts: tuple = (0, 10, 50)
    risk_max_sales: float = 10
    risk_max_transactions: int = 10
    risk_k: int = 5
    city_choices: int = 10
    edge_min_weight: float | str = 2e7   # a number, or "mean" for the mean pair weight
    top_nodes: int = 100
    outlier_q: float = 0.95
    train_frac: float = 0.8
    series_mode: str = "calendar"
    trees: int = 100
    rate: float = 0.1
    depth: int = 5
    seed: int = 42
    fmt: str = "parquet"


def stage(df: DataFrame, name: str, staged: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared staging folder and read it back (cuts lineage).

    The path is appended to ``staged`` so the caller can delete it when done.
    """
    path = staging_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    if staged is not None:
        staged.append(path)
    return df.sparkSession.read.parquet(path)


def _threshold(pairs: DataFrame, spec) -> float | Column:
    if spec == "mean":
        return pairs.select(F.avg("weight")).scalar()
    return float(spec)


def run_report(spark: SparkSession, raw: DataFrame, out_dir: str,
               params: ReportParams | None = None, *, parallel: int = 4,
               keep_stages: bool = False, keep_sets: int = 2) -> dict[str, str]:
    """Run the whole job; returns output name -> path.

    The outputs are one set under ``out_dir``, published when all of it is written
    (``sinks.read_published`` reads the newest): a run that fails leaves the set before as it was.
    ``keep_sets`` published sets stay, older ones are deleted.

    After the shared stages are written, the independent branches (forecast,
    graph, reports, t-test) are submitted as concurrent Spark jobs from
    ``parallel`` driver threads: the boosted-tree fit is a long chain of tiny
    jobs on the month-grain frame and would otherwise leave the executors
    idle. ``parallel=1`` runs everything in order. The staged typed, clean
    and monthly tables (together about twice the input) are deleted at the end, also after a
    failure, unless ``keep_stages``. Display tables are formatted from the written numeric tables.
    """
    staged: list[str] = []
    outputs, params = OutputSet(spark, out_dir), params or ReportParams()
    try:
        paths = _run(spark, raw, outputs.folder, params, parallel, staged)
        outputs.publish(paths, fmt=params.fmt, keep=keep_sets)
        return paths
    except BaseException:
        outputs.discard()
        raise
    finally:
        if not keep_stages:
            for path in staged:
                delete_path(spark, path)


def _run(spark: SparkSession, raw: DataFrame, out: str, p: ReportParams, parallel: int,
         staged: list[str]) -> dict[str, str]:

    typed = stage(cleaning.cast_sales(cleaning.drop_nulls(raw), date_format=p.date_format), "typed", staged)
    invalid = diagnostics.invalid_counts(typed)
    duplicates = diagnostics.duplicate_groups(typed)
    sales = stage(cleaning.dedup(cleaning.keep_valid(typed)), "clean", staged)
    months = stage(cube.store_months(sales, max_sales=p.risk_max_sales, max_transactions=p.risk_max_transactions),
                   "monthly", staged)
    monthly = cube.monthly_sales(months)
    cells = checkpointed(cube.sales_cube(sales, place=p.place, cuts=p.promo_cuts))
    series = timeseries.monthly_series(monthly, mode=p.series_mode)
    split = timeseries.chrono_split(timeseries.drop_upper_outliers(series, q=p.outlier_q),
                                    frac=p.train_frac)
    split = checkpointed(split)

    # totals and growth hold a row per place (and year): computed once, and all that follows reads them
    totals = checkpointed(reports.city_totals(cells, place=p.place))
    growth = checkpointed(cube.city_growth(cells, place=p.place, ordered=False))
    choices = reports.city_choices(totals, k=p.city_choices, place=p.place)
    tables = {
        "top_categories": cube.top_categories(cells, k=p.top_k_categories),
        "city_growth": growth.orderBy(p.place, "year"),
        "category_breadth": cube.category_breadth(cells, sales, place=p.place,
                                                  min_categories=p.breadth_min_categories, k=p.breadth_k),
        "promotion_impact": cube.promotion_impact(cells),
        "high_risk_orders": cube.high_risk_orders(months, k=p.risk_k),
    }
    displayed = list(tables)
    tables["diag_post_clean"] = cube.invalid_counts(cells)
    tables["city_totals"] = totals
    tables["city_choices"] = choices
    tables["city_growth_filtered"] = reports.growth_of_choice(growth, choices, place=p.place)
    corr = timeseries.correlation_matrix(monthly)
    tables["promo_correlation"] = corr
    # small results the summary also needs: computed once (checkpointed), then
    # both written and summarised, never recomputed from the facts
    shared = {
        "kpis": reports.kpis(sales, monthly, n_records=cube.n_records(cells)),
        "ttest": cube.welch_ttest_top(cells, place=p.place),
        "diag_invalid_counts": invalid,
        "diag_duplicate_groups": duplicates,
    }

    def forecast_branch() -> dict[str, DataFrame]:
        model = fc.fit_forecast(split.where(F.col("split") == "train"), trees=p.trees, rate=p.rate,
                                depth=p.depth, seed=p.seed)
        fc.save_model(model, f"{out}/model")
        predictions = checkpointed(fc.predict(model, split))
        return {"forecast_predictions": predictions,
                "forecast_metrics": checkpointed(stats.regression_metrics(predictions))}

    def graph_branch() -> dict[str, DataFrame]:
        pairs = checkpointed(graph.copurchase_pairs(sales))
        edge_df = checkpointed(graph.edges(pairs, min_weight=_threshold(pairs, p.edge_min_weight)))
        scores = checkpointed(graph.eigenvector_centrality(edge_df))
        top = checkpointed(graph.top_nodes(scores, k=p.top_nodes))
        sub = checkpointed(graph.induced(edge_df, top))
        comp_nodes = checkpointed(graph.largest_component(graph.vertices(sub), sub))
        return {"graph_edges": edge_df, "graph_top_nodes": top,
                "graph_component_edges": graph.induced(sub, comp_nodes),
                "graph_node_profile": graph.node_profile(comp_nodes, scores, cells)}

    def write(name: str, df: DataFrame) -> dict[str, str]:
        done = write_reports({name: df}, f"{out}/tables", fmt=p.fmt, parallel=1)
        if name in displayed:     # formatted from what was written, not computed again
            shown = format_report(read_reports(spark, done, fmt=p.fmt, schemas={name: df.schema})[name], name)
            done |= write_reports({f"{name}_display": shown}, f"{out}/tables", fmt=p.fmt, parallel=1)
        return done

    paths: dict[str, str] = {}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        branches = [pool.submit(forecast_branch), pool.submit(graph_branch)]
        done_shared = {name: pool.submit(checkpointed, df) for name, df in shared.items()}
        writes = [pool.submit(write, name, df) for name, df in tables.items()]
        results: dict[str, DataFrame] = {name: fut.result() for name, fut in done_shared.items()}
        writes += [pool.submit(write, name, df) for name, df in results.items()]
        for fut in branches:
            branch = fut.result()
            writes += [pool.submit(write, name, df) for name, df in branch.items()]
            results.update(branch)
        charts = chart_series(split_series=split, predictions=results["forecast_predictions"],
                              top_cities=totals.orderBy(F.col("total_sales").desc(), F.col(p.place)).limit(p.city_choices),
                              correlation=corr, place=p.place)
        writes.append(pool.submit(lambda: {"charts": write_chart_series(charts, f"{out}/charts", fmt=p.fmt)}))
        top = results["graph_top_nodes"]
        summ = summary(kpis=results["kpis"], invalid=results["diag_invalid_counts"],
                       duplicates=results["diag_duplicate_groups"], ttest=results["ttest"],
                       top_node=top.where(F.col("rank") == 1).select("id", "score"),
                       metrics=results["forecast_metrics"])
        writes.append(pool.submit(write_reports, {"summary": summ}, out, fmt=p.fmt, parallel=1))
        for fut in writes:
            paths.update(fut.result())
    paths["model"] = f"{out}/model"
    return paths
