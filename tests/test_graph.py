import pytest
from pyspark.sql import functions as F

from tillsight.operators import graph


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def _scores(df):
    return {r.id: r.score for r in df.collect()}


def test_star_needs_shift(spark):
    e = _edges(spark, [("c", "a", 1.0), ("c", "b", 1.0), ("c", "d", 1.0)])
    s = _scores(graph.eigenvector_centrality(e))
    assert s["c"] == pytest.approx(0.7071, abs=1e-4)
    for leaf in "abd":
        assert s[leaf] == pytest.approx(0.4082, abs=1e-4)


def test_complete_graph_and_single_edge(spark):
    k4 = _edges(spark, [(a, b, 1.0) for a in "abcd" for b in "abcd" if a < b])
    assert all(v == pytest.approx(0.5, abs=1e-5) for v in _scores(graph.eigenvector_centrality(k4)).values())
    one = _edges(spark, [("a", "b", 1.0)])
    assert all(v == pytest.approx(0.7071, abs=1e-4) for v in _scores(graph.eigenvector_centrality(one)).values())


def test_two_triangles(spark):
    e = _edges(spark, [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0),
                       ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0)])
    s = _scores(graph.eigenvector_centrality(e))
    for v in "abc":
        assert s[v] == pytest.approx(0.5774, abs=1e-4)
    for v in "xyz":
        assert s[v] < 1e-3
    comps = {r.id: r.component for r in graph.connected_components(graph.vertices(e), e).collect()}
    assert comps == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_scores_are_an_eigenvector(spark):
    rows = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "d", 1.0), ("b", "d", 5.0)]
    e = _edges(spark, rows)
    s = _scores(graph.eigenvector_centrality(e, tol=1e-10, max_iter=1000))
    ax = {k: 0.0 for k in s}
    for a, b, w in rows:
        ax[a] += w * s[b]
        ax[b] += w * s[a]
    lam = sum(ax[k] * s[k] for k in s)
    for k in s:
        assert ax[k] == pytest.approx(lam * s[k], rel=1e-6)
    assert sum(v * v for v in s.values()) == pytest.approx(1.0)


def test_empty_graph(spark):
    e = _edges(spark, [])
    assert graph.eigenvector_centrality(e).count() == 0
    assert graph.vertices(e).count() == 0
    assert graph.connected_components(graph.vertices(e), e).count() == 0


def test_non_convergence_raises(spark):
    e = _edges(spark, [("a", "b", 1.0), ("b", "c", 1.0)])
    with pytest.raises(graph.ConvergenceError):
        graph.eigenvector_centrality(e, max_iter=1, tol=1e-12)


def test_components_long_chain_and_order_independence(spark):
    n = 40
    rows = [(f"v{i:03d}", f"v{i+1:03d}", 1.0) for i in range(n)]
    a = _edges(spark, rows)
    b = _edges(spark, list(reversed(rows)))
    ca = {r.id: r.component for r in graph.connected_components(graph.vertices(a), a).collect()}
    cb = {r.id: r.component for r in graph.connected_components(graph.vertices(b), b).collect()}
    assert ca == cb
    assert set(ca.values()) == {"v000"}


def test_largest_component_and_induced(spark):
    e = _edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)])
    assert sorted(r.id for r in graph.largest_component(graph.vertices(e), e).collect()) == ["a", "b", "c"]
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    assert [(r.src, r.dst) for r in graph.induced(e, nodes).collect()] == [("a", "b")]


def test_edges_threshold_and_null_weight(spark):
    pairs = _edges(spark, [("a", "b", None), ("a", "c", 5.0), ("b", "c", 0.5)])
    got = sorted((r.src, r.dst, r.weight) for r in graph.edges(pairs, min_weight=0.9).collect())
    assert got == [("a", "b", 1.0), ("a", "c", 5.0)]


def test_top_nodes(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5), ("d", 0.5)], "id string, score double")
    got = [(r.id, r.rank) for r in graph.top_nodes(scores, k=3).orderBy("rank").collect()]
    assert got == [("b", 1), ("c", 2), ("d", 3)]


def test_copurchase_equals_naive_self_join(spark, clean_sales):
    pre = {(r.src, r.dst): r.weight for r in graph.copurchase_pairs(clean_sales).collect()}
    s = clean_sales.where(F.col("date").isNotNull())
    t1, t2 = s.alias("t1"), s.alias("t2")
    naive = (t1.join(t2, (F.col("t1.store_nbr") == F.col("t2.store_nbr")) & (F.col("t1.date") == F.col("t2.date"))
                     & (F.col("t1.family") < F.col("t2.family")))
             .groupBy(F.col("t1.family").alias("src"), F.col("t2.family").alias("dst"))
             .agg(F.sum("t1.sales").alias("weight")))
    nv = {(r.src, r.dst): r.weight for r in naive.collect()}
    assert set(pre) == set(nv) and pre
    for k in nv:
        assert pre[k] == pytest.approx(nv[k])
    assert ("BREAD", "GROCERY") in pre and pre[("BREAD", "GROCERY")] == pytest.approx(5.0)


def test_node_profile_with_apostrophes(spark, clean_sales):
    nodes = spark.createDataFrame([("CHEF'S CUT",), ("NOPE",)], "id string")
    scores = spark.createDataFrame([("CHEF'S CUT", 0.3)], "id string, score double")
    got = {r.id: (r.total_sales, r.score) for r in graph.node_profile(nodes, scores, clean_sales).collect()}
    assert got == {"CHEF'S CUT": (8.0, 0.3), "NOPE": (0.0, None)}


def test_components_long_path_with_shuffled_ids(spark):
    import random
    ids = [f"p{i:04d}" for i in range(300)]
    order = ids[:]
    random.Random(3).shuffle(order)
    rows = [(order[i], order[i + 1], 1.0) for i in range(len(order) - 1)] + [("z1", "z2", 1.0)]
    e = _edges(spark, rows)
    got = {r.id: r.component for r in graph.connected_components(graph.vertices(e), e).collect()}
    assert set(got.values()) == {"p0000", "z1"}
    assert sum(1 for v in got.values() if v == "p0000") == 300
