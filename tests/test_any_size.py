"""Operators that take frames of any size: exact percentiles, positions, wide baskets, hubs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillsight.operators import graph, ordering, selection, timeseries


def _one_task(df):
    """Whether the plan gathers rows in a single partition."""
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [4096, 3])
def test_percentiles_of_lineitem_equal_sql(spark, few):
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    want = duckdb.sql(f"SELECT quantile_cont(l_extendedprice, {qs}) FROM '{SF_SMALL}/lineitem.parquet'").fetchall()[0][0]
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert selection.exact_percentiles(items, "l_extendedprice", qs, few=few) == pytest.approx(want, rel=1e-12)
    # many ties: a few distinct values
    want = duckdb.sql(f"SELECT quantile_cont(l_discount, {qs}) FROM '{SF_SMALL}/lineitem.parquet'").fetchall()[0][0]
    assert selection.exact_percentiles(items, "l_discount", qs, few=few) == pytest.approx(want, rel=1e-12)


def test_order_statistics_of_odd_values(spark):
    rng = random.Random(5)
    values = [rng.choice((1, -1)) * 10.0 ** rng.randint(-300, 300) for _ in range(400)] + [0.0] * 30 + [1.7e308, -1.7e308, 5e-324]
    rows = [(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    df = spark.createDataFrame(rows, "x double").repartition(5)
    ranks = [0, 1, 57, 200, 216, 300, len(values) - 1]
    assert selection.order_statistics(df, "x", ranks, few=5) == {r: sorted(values)[r] for r in ranks}
    assert selection.exact_percentiles(df.where("x is null"), "x", [0.5, 0.9]) == [None, None]
    assert selection.exact_percentiles(df.where("x = 0"), "x", [0.5]) == [0.0]


def test_rows_are_numbered_without_one_task(spark):
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber")
    out = ordering.number_rows(items.repartition(9), "l_shipdate", "l_orderkey", "l_linenumber")
    want = duckdb.sql("SELECT l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) "
                      f"FROM (SELECT l_shipdate, l_orderkey, l_linenumber FROM '{SF_SMALL}/lineitem.parquet')").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not _one_task(out) and "Window" not in plan


def test_split_of_the_facts_equals_row_numbers(spark):
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber")
    out = timeseries.chrono_split(items, order=("l_shipdate", "l_orderkey", "l_linenumber"), frac=0.7)
    n = items.count()
    cut = items.orderBy("l_shipdate", "l_orderkey", "l_linenumber").limit(math.floor(n * 0.7))
    assert out.where("split = 'train'").drop("split").exceptAll(cut).isEmpty()
    assert out.where("split = 'train'").count() == math.floor(n * 0.7) and out.count() == n
    assert not _one_task(out)
    assert timeseries.chrono_split(items.limit(0), order="l_orderkey").collect() == []


def test_outlier_cut_of_the_facts(spark):
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    out = timeseries.drop_upper_outliers(items, col="l_extendedprice", q=0.9)
    assert not _one_task(out)
    want = duckdb.sql(f"SELECT count(*) FROM '{SF_SMALL}/lineitem.parquet' WHERE l_extendedprice <= "
                      f"(SELECT quantile_cont(l_extendedprice, 0.9) FROM '{SF_SMALL}/lineitem.parquet')").fetchall()[0][0]
    assert out.count() == want
    assert timeseries.drop_upper_outliers(items.limit(0), col="l_extendedprice").collect() == []


@pytest.mark.parametrize("block", [7, 40, 512])
def test_wide_baskets_equal_sql(spark, block):
    rng = random.Random(11)
    rows = [("wide", "d", f"sku{k:04d}", float(rng.randint(1, 9))) for k in range(300) for _ in range(rng.randint(1, 3))]
    rows += [(f"s{rng.randint(1, 40)}", "d", f"sku{rng.randint(0, 399):04d}", float(rng.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame(rows, "store_nbr string, date string, family string, sales double").repartition(6)
    got = {(r.src, r.dst): r.weight for r in graph.copurchase_pairs(df, block=block).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE s (store VARCHAR, d VARCHAR, f VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    want = {(a, b): w for a, b, w in con.execute("SELECT x.f, y.f, sum(x.v) FROM s x JOIN s y USING (store, d) WHERE x.f < y.f GROUP BY ALL").fetchall()}
    assert got == want and len(want) > 40_000


def test_tasks_of_a_wide_basket_are_bounded(spark):
    df = spark.createDataFrame([("w", "d", f"sku{k:05d}", 1.0) for k in range(2000)], "store_nbr string, date string, family string, sales double")
    pairs = graph.copurchase_pairs(df, block=100)
    assert pairs.count() == 2000 * 1999 // 2 and pairs.where("weight <> 1").isEmpty()


def _star(spark, leaves):
    return spark.range(leaves).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("dst"),
                                      F.lit(1.0).alias("weight"))


def test_edges_of_a_hub_are_dealt_to_blocks(spark):
    leaves = 40_000
    sym = graph._symmetric(_star(spark, leaves)).withColumn("ident", F.lit(False))
    blocked, nodes = graph._blocked(sym, block_rows=500)
    assert nodes.where("id = 'hub'").first()["blocks"] == 80 and nodes.where("blocks > 1").count() == 1
    sizes = [r["count"] for r in blocked.repartition(8, "src", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * leaves and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert blocked.groupBy("src", "salt").count().agg(F.max("count")).first()[0] < 2 * 500


def test_hub_blocks_do_not_change_scores(spark):
    rng = random.Random(2)
    rows = [("hub", f"v{k}", 1.0 + k % 3) for k in range(60)]
    rows += [(f"v{a}", f"v{b}", 1.0) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)}]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    whole = {r.id: r.score for r in graph.eigenvector_centrality(e).collect()}
    cut = {r.id: r.score for r in graph.eigenvector_centrality(e, block_rows=4).collect()}
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(v, abs=1e-12) for k, v in whole.items())
    star = {r.id: r.score for r in graph.eigenvector_centrality(_star(spark, 100), block_rows=9).collect()}
    assert star["hub"] == pytest.approx(math.sqrt(0.5), abs=1e-4) and star["leaf5"] == pytest.approx(math.sqrt(0.5) / 10, abs=1e-4)


def test_centres_of_components_can_be_split(spark):
    # a star whose edges are most of the graph: its rows of the join are spread over several tasks
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = _star(spark, 60_000).unionByName(spark.createDataFrame([("x", "y", 1.0), ("y", "z", 1.0)], "src string, dst string, weight double"))
        large = graph._large_star(graph._undirected(star).repartition(8))
        large.collect()
        assert "skew=true" in large._jdf.queryExecution().executedPlan().toString()
        comps = graph.connected_components(graph.vertices(star), star)
        assert sorted(map(tuple, comps.groupBy("component").count().collect())) == [("hub", 60_001), ("x", 3)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
