"""The code paths a large cluster takes: shuffle joins instead of broadcasts in
the graph loops, and hot keys holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tillsight.operators import cleaning, graph, reports


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_graph_loops_by_shuffle_joins_match(spark):
    rows = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "d", 1.0), ("x", "y", 5.0)]
    e = _edges(spark, rows)
    v = graph.vertices(e)

    def both():
        return ({r.id: r.score for r in graph.eigenvector_centrality(e).collect()},
                {r.id: r.component for r in graph.connected_components(v, e).collect()})
    small, c1 = both()
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big, c2 = both()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert small.keys() == big.keys()
    for k in small:
        assert big[k] == pytest.approx(small[k], abs=1e-12)
    assert c1 == c2 == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_hot_basket_and_hot_duplicate_group(spark):
    # one basket (store 1, one day) and one group of exact copies hold a third of the rows
    hot = [("1", "A", "Q", "01/05/2014", "10", "1", "0")] * 300
    rest = [(str(s), fam, "L", f"01/{d:02d}/2014", str(d + s), "2", "5")
            for s in range(2, 5) for d in range(1, 21) for fam in "ABCDE"]
    other_hot = [("1", fam, "Q", "01/05/2014", "3", "1", "0") for fam in "BCDE"]
    raw = spark.createDataFrame(hot + rest + other_hot + [("1", "B", "Q", "01/05/2014", "4", "1", "0")],
                                "store_nbr string, family string, city string, date string, "
                                "sales string, transactions string, onpromotion string")
    typed = cleaning.cast_sales(cleaning.drop_nulls(raw))
    clean = cleaning.clean(raw)
    assert clean.where((F.col("family") == "A") & (F.col("store_nbr") == "1")).count() == 1
    assert clean.count() == 1 + len(rest) + len(other_hot) + 1
    # pairs on the raw-typed rows (copies kept) equal the naive self-join
    pre = {(r.src, r.dst): r.weight for r in graph.copurchase_pairs(typed).collect()}
    joined = {(r.src, r.dst): r.weight for r in graph.copurchase_pairs(typed, block=2).collect()}
    assert pre.keys() == joined.keys() and all(pre[k] == pytest.approx(joined[k]) for k in pre)
    rows = typed.collect()
    naive = {}
    for t1 in rows:
        for t2 in rows:
            if (t1.store_nbr, t1.date) == (t2.store_nbr, t2.date) and t1.family < t2.family:
                naive[(t1.family, t2.family)] = naive.get((t1.family, t2.family), 0.0) + t1.sales
    assert pre.keys() == naive.keys()
    for k in naive:
        assert pre[k] == pytest.approx(naive[k])
    # per-city reports over the hot city stay exact
    totals = {r.city: r.total_sales for r in reports.city_totals(typed).collect()}
    assert totals["Q"] == pytest.approx(300 * 10 + 4 * 3 + 4)
