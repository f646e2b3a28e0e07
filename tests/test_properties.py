"""Randomised checks against brute force on small inputs (fixed seeds)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.operators import cleaning, graph
from tillsight.sources import register_views


def _union_find(nodes, pairs):
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for v in nodes:
        comp.setdefault(find(v), []).append(v)
    return {v: min(members) for members in comp.values() for v in members}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(25)}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    got = {r.id: r.component for r in graph.connected_components(graph.vertices(e), e).collect()}
    used = sorted({v for p in pairs for v in p})
    assert got == _union_find(used, pairs)


@pytest.mark.parametrize("seed", [4, 5])
def test_centrality_matches_dense_eigenvector(spark, seed):
    rng = np.random.default_rng(seed)
    n = 12
    nodes = [f"c{i:02d}" for i in range(n)]
    rows = []
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            if rng.random() < 0.5 or j == i + 1:      # connected: a path plus random chords
                w = float(rng.integers(1, 100))
                rows.append((nodes[i], nodes[j], w))
                a[i, j] = a[j, i] = w
    vals, vecs = np.linalg.eigh(a)
    v = np.abs(vecs[:, np.argmax(vals)])
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = {r.id: r.score for r in graph.eigenvector_centrality(e, tol=1e-12, max_iter=1000).collect()}
    for i, name in enumerate(nodes):
        assert got[name] == pytest.approx(v[i], abs=1e-6)


@pytest.mark.parametrize("seed", [6, 7])
def test_copurchase_matches_naive_on_random_baskets(spark, seed):
    rng = random.Random(seed)
    fams = ["A", "B", "C", "D", "E"]
    rows = []
    for _ in range(300):
        store = rng.randint(1, 4)
        day = rng.randint(1, 6)
        rows.append((store, f"2014-01-0{day}", rng.choice(fams), float(rng.randint(1, 50)) if rng.random() > .05 else None))
    df = (spark.createDataFrame(rows, "store_nbr int, d string, family string, sales double")
          .withColumn("date", F.to_date("d")).drop("d"))
    pre = {(r.src, r.dst): r.weight for r in graph.copurchase_pairs(df).collect()}
    naive = {}
    for s1, d1, f1, v1 in rows:
        for s2, d2, f2, _ in rows:
            if s1 == s2 and d1 == d2 and f1 < f2 and v1 is not None:
                naive[(f1, f2)] = naive.get((f1, f2), 0.0) + v1
    assert set(pre) == set(naive)
    for k, v in naive.items():
        assert pre[k] == pytest.approx(v)


def test_dedup_and_clean_idempotent_on_random_rows(spark):
    rng = random.Random(8)
    vals = ["1", "2", "0", "-1", "x", "3.5", None]
    rows = [(str(rng.randint(1, 3)), rng.choice("AB"), rng.choice(["Q", "L", None]),
             rng.choice(["01/05/2014", "1/6/2014", "13/45/2014"]), rng.choice(vals), rng.choice(vals),
             rng.choice(vals)) for _ in range(400)]
    raw = spark.createDataFrame(rows, "store_nbr string, family string, city string, date string, "
                                      "sales string, transactions string, onpromotion string")
    once = cleaning.clean(raw)
    twice = cleaning.keep_valid(cleaning.dedup(once))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == once.distinct().count()
    assert once.where((F.col("sales") <= 0) | (F.col("transactions") <= 0)).count() == 0


def test_register_views(spark, clean_sales, dirty_raw):
    names = register_views(raw=dirty_raw, clean=clean_sales)
    assert names == ["sales_raw", "sales_clean"]
    assert spark.sql("SELECT COUNT(*) AS n FROM sales_clean").first().n == 8
    assert spark.sql("SELECT COUNT(*) AS n FROM sales_raw").first().n == 15
