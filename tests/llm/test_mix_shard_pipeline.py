"""Mixing, sharding and the pipeline: invariants, SQL and brute force on small tables."""

import os
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT, SF_SMALL, SF_SMOKE
from tests.llm.conftest import edge_rows, label_rows
from tests.llm.test_dedup import expected_near, plain
from tillsight.llm import mixing, queries, sharding

N_EDGE = len(edge_rows())


def duck(sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_of_the_queries(spark, name):
    columns, want = duck(queries.ORACLES[name], SF_SMOKE)
    df = queries.QUERIES[name](spark, SF_SMOKE)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


def test_mix_hits_targets_and_is_stable(spark):
    query = queries.QUERIES["op4_mix_sources"]
    rows = query(spark, SF_SMALL).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for source in by.values():
        assert sum(r.taken for r in source) == pytest.approx(source[0].target, rel=0.01)
    assert sum(s[0].target for s in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        again = query(spark, SF_SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / sum(w[x] for x in sizes if x not in full) for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_equal_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, "e": 70, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_hot_source_is_cut_in_bins(spark):
    # one source with most rows: the bins give the same sample for any number of bins
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + pmod(id * 7, 40))").alias("text"),
                                  F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    one, many = (sorted(map(tuple, mixing.mix(df, bins=b).collect())) for b in (1, 512))
    assert one == many


def test_mix_edges(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == N_EDGE and all(r.taken == 0 for r in rows if not (r.size or 0))
    mixed = mixing.mix_rows(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mix_rows(empty).count() == 0


def test_shards_are_near_equal_and_gapless(spark):
    rows = queries.QUERIES["op7_shard_documents"](spark, SF_SMALL).collect()
    shards, texts = defaultdict(list), defaultdict(set)
    for r in rows:
        shards[r.shard].append(r)
        texts[r.text_crc32, r.size].add(r.shard)
    sizes = [sum(r.size for r in s) for s in shards.values()]
    largest = max(r.size for r in rows)
    assert sorted(shards) == list(range(8)) and max(sizes) - min(sizes) <= 2 * largest
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert all(len(s) == 1 for s in texts.values())          # equal texts stay together


def test_kd_cuts_are_weighted_medians(spark):
    rng = np.random.default_rng(4)
    n = 2000
    df = spark.createDataFrame([(i, bytes([i % 256, i // 256]), int(s), float(a), float(b)) for i, (s, a, b) in enumerate(
        zip(rng.integers(1, 100, n), rng.normal(0, 1, n), rng.normal(0, 1, n)))],
        "row long, text_id binary, size long, axis_0 double, axis_1 double")
    owner = {bytes(r.text_id): r.shard for r in sharding.assign_shards(df, 5, ["axis_0", "axis_1"]).collect()}
    weight = defaultdict(int)
    rows = df.collect()
    for r in rows:
        weight[owner[bytes(r.text_id)]] += r.size
    total = sum(weight.values())
    assert sorted(weight) == list(range(5)) and all(abs(w - total / 5) < 150 for w in weight.values())
    # the first cut, along one axis, parts the shards 0-1 from 2-4
    sides = [[[r[a] for r in rows if (owner[bytes(r.text_id)] < 2) == left] for left in (True, False)]
             for a in ("axis_0", "axis_1")]
    assert any(max(low) <= min(high) + 1e-4 for low, high in sides)


def test_shard_edges(edge, empty):
    rows = sharding.shard_documents(edge, shards=3).collect()
    assert len(rows) == N_EDGE and sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert sharding.shard_documents(empty).count() == 0


def test_hot_groups_have_shards_of_their_own(spark):
    # copies of one text hold a third of the bytes: the other shards share the rest evenly
    def sizes(hot, shards):
        rows = [(i, f"text {i} " + "w " * (i % 40)) for i in range(1500)]
        other = sum(len(t) + 1 for _, t in rows)
        for k, part in enumerate(hot):
            body = f"hot {k} " + "h " * 100
            rows += [(10_000 * (k + 1) + j, body) for j in range(int(other * part / (1 - sum(hot)) / (len(body) + 1)))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("s").alias("source"), F.lit("en").alias("lang"))
        got = sharding.shard_documents(docs, shards=shards).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        total = sum(r.n for r in got)
        return sorted((r.n / total for r in got), reverse=True)
    one = sizes([1 / 3], 8)
    assert len(one) == 8 and one[0] == pytest.approx(1 / 3, abs=0.01) and all(abs(x - 2 / 21) < 0.01 for x in one[1:])
    two = sizes([0.4, 0.3], 5)
    assert len(two) == 5 and two[:2] == pytest.approx([0.4, 0.3], abs=0.01) and all(abs(x - 0.1) < 0.01 for x in two[2:])
    near = sizes([0.11], 8)                        # just under a shard: the tree carries it
    assert len(near) == 8 and max(near) < 0.17 and min(near) > 0.06


@pytest.mark.parametrize("hot", [0, 0.3])
def test_leaves_reach_the_target_bytes(spark, hot):
    # 3000 texts; with ``hot`` copies of one text hold that part of all bytes
    texts = [f"{i} " + "x" * (i * 7919 % 400) for i in range(3000)]
    total = sum(len(t) + 1 for t in texts)
    copies = int(hot / (1 - hot) * total / 1001)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + ["y" * 1000] * copies)],
                                 "doc_id long, text string, lang string, source string")
    target = 9000
    rows = sharding.shard_documents(docs, target_bytes=target).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == len(texts) + copies
    wide = [n for n in sizes.values() if n > target + 410]
    assert len(wide) == (1 if copies else 0) and sum(wide) == copies * 1001     # the group of copies alone
    rest = [n for n in sizes.values() if n not in wide]
    assert len(rest) >= total / target and min(rest) > target / 2


def test_scopes_delete_what_is_staged(spark, tmp_path, monkeypatch):
    import os
    import threading

    from tillsight.llm import common
    made = []

    def path(_, name):
        made.append(str(tmp_path / f"{name}-{len(made)}"))
        return made[-1]
    monkeypatch.setattr(common, "staging_path", path)
    with pytest.raises(RuntimeError):
        with common.scratch(spark):
            common.stage(spark.range(3), "a")
            with common.scratch(spark):
                common.stage(spark.range(3), "b")
                kept = common.stage(spark.range(3), "c", keep=True)
            assert [os.path.exists(p) for p in made] == [True, False, True] and kept.count() == 3
            # another thread's table is not in this scope
            other = threading.Thread(target=lambda: common.stage(spark.range(3), "d"))
            other.start()
            other.join()
            raise RuntimeError
    assert [os.path.exists(p) for p in made] == [False, False, False, True]
    free = common.stage(spark.range(3), "e")
    common.drop_staged(free)
    common.drop_staged(spark.range(3))
    assert not os.path.exists(made[-1])


def test_shards_of_a_node_follow_its_bytes():
    assert sharding._left_shards(50, 50, 4) == 2 and sharding._left_shards(40, 60, 5) == 2
    assert sharding._left_shards(75, 25, 4) == 3 and sharding._left_shards(100, 0, 4) == 3


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from tillsight.llm.common import documents, stage
    labels = label_rows(SF_SMOKE)
    docs = documents(spark, SF_SMOKE)
    names, seen = [n for n, _ in P.STAGES], {}
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "encode_pieces"]
    for name, function in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        columns = docs.columns
        docs = stage(function(spark, docs, SF_SMOKE), f"test-{name}")
        seen[name] = (before, columns, docs)
    before, columns, out = seen["quality_rules"]
    kept = {r.doc_id for r in out.collect()}
    junk = {i for i, (q, _) in labels.items() if q == 0}
    assert out.columns == columns and not kept & junk and len(kept) > 0.7 * len(before)
    before, columns, out = seen["exact_dedup"]
    assert out.columns == columns and out.count() == len({plain(t) for _, t in before})
    before, columns, out = seen["near_dedup"]
    want, groups = expected_near(before, 5)
    assert out.columns == columns and out.count() == groups
    assert {r.doc_id for r in out.collect()} == {c for _, _, c in want}
    before, columns, out = seen["mix_sources"]
    copies = Counter(r.doc_id for r in out.collect())
    assert out.columns == columns and set(copies) <= {i for i, _ in before} and max(copies.values()) <= 2
    before, _, out = seen["encode_pieces"]
    rows = out.collect()
    assert len(rows) == len(before) and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    whole = P.run(spark, SF_SMOKE).collect()
    assert Counter((r.doc_id, r.n_ids) for r in whole) == Counter((r.doc_id, r.n_ids) for r in rows)


def test_pipeline_stages_on_edges(spark, edge, empty):
    import corpus_pipeline as P
    for docs in (edge, empty):
        for name, function in P.STAGES:
            out = function(spark, docs, "unused")
            n = out.count()
            assert n <= 2 * N_EDGE if docs is edge else n == 0
            if name != "encode_pieces":
                assert out.columns == docs.columns
                clash = out.select("kept", "score", "size", "row", "node", "ids", "input", "n_words", "bucket").distinct()
                assert all(tuple(r) == ("k", "0.5", "9", "r", "n", "ids", "in", "7", "b") for r in clash.collect())


def test_executors_need_no_package(tmp_path):
    script = tmp_path / "bare.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {ROOT!r})\n"
        "from tillsight.session import build_session\n"
        "import __spark_entry__ as E\n"
        "spark = build_session('local[2]', shuffle_partitions=4)\n"
        f"print('ROWS', [E.queries()[q](spark, {SF_SMOKE!r}).count() for q in ('op6_quality_rules', 'op8_language_id')])\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [200, 200]" in out.stdout, out.stderr[-2000:]
