"""Collocations, source divergence and near-duplicate vectors against brute force, and their defined edge results."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, SF_SMOKE
from tests.llm.conftest import edge_rows
from tillsight.llm import collocation, divergence, queries, tokens, vector_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE_TEXTS = [("a b c, a b c. A B C\ta b", None, None), (None, "en", "s"), ("", "en", "s"), ("...;;", "en", None),
              ("x x x x x x", "en", "s"), ("x x x x x x", "en", "s"), ("ÄÖ äö\x0bÄÖ äö  ÄÖ äö\x00 a.b", "en", "t"),
              ("w w w\u0085w 字字 字字 字字", "zh", "u")]


def smoke(sf=SF_SMOKE):
    return duckdb.sql(f"SELECT text, lang, source FROM '{sf}/documents.parquet'").fetchall()


def docs_of(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, "p", "s") for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, prefix string, n long, phrase string, term string").repartition(5)


def expected_phrases(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rows_ = []
        for p, a in cand.items():
            if len(p) == 2 and p in longer and 100 * longer[p] >= 50 * a:
                continue
            score, _, l_, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                  for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l_, r))
        out += [(lang, i + 1, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("sf", "least", "top"), [(SF_SMOKE, 4, 50), (None, 2, 2000)])
def test_collocations_equal_brute_force(spark, sf, least, top):
    rows = (smoke(sf) if sf else []) + EDGE_TEXTS
    got = collocation.collocations(docs_of(spark, rows), min_count=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected_phrases(rows, least, top)
    assert sorted(map(tuple, got.collect())) == want and want


def test_collocations_with_small_tables_and_many_collisions(spark, monkeypatch):
    # a filter of 64 places lets nearly all through; stripes are written often; all prefixes are cut into slices
    monkeypatch.setattr(tokens, "FILTER_BITS", 64)
    monkeypatch.setattr(collocation, "HELD", 50)
    monkeypatch.setattr(collocation, "HOT_SHARE", 10**9)
    rows = smoke()[:60] + EDGE_TEXTS
    got = collocation.collocations(docs_of(spark, rows), min_count=2, top=10**6)
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, 2, 10**6)


def test_collocation_scores_stay_exact_over_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_019, 3_000_000_033, 3_000_000_067)], "a long, l long, r long")
    got = df.select(collocation._score(df.l, df.r)).first()[0]
    assert got == 1_000_000 * 3_000_000_019**2 // (3_000_000_033 * 3_000_000_067)


def test_key_filter_never_misses(spark):
    words = [f"w{i}é" for i in range(5000)]
    bits = tokens.key_filter(spark.createDataFrame([(w,) for w in words], "w string"), F.col("w"))
    assert tokens.passes(bits.value, tokens.combined([tokens.hashes([w.encode() for w in words])])).all()
    other = tokens.passes(bits.value, tokens.combined([tokens.hashes([f"v{i}".encode() for i in range(5000)])]))
    assert other.mean() < 0.01


def expected_divergence(rows, min_docs):
    d = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))
         for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in d}:
        df = Counter(t for la, _, ts in d if la == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter() for la, s, _ in d if la == lang}
        for la, s, ts in d:
            if la == lang:
                counts[s].update(t for t in ts if df[t] >= min_docs)

        def p(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares, usual = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        far = lambda x, y, t: (x[t] - y[t])**2 // (x[t] + y[t])
        for s, x in shares.items():
            pairs = [(-sum(far(x, y, t) for t in kept), o.encode()) for o, y in shares.items() if o != s]
            terms = [(-far(x, usual, t), t.encode()) for t in kept if counts[s][t] > 0 and x[t] > usual[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "block", "terms"), [(5, 128, 4096), (2, 3, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, least, block, terms):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "HELD", 200)
    monkeypatch.setattr(divergence, "FIRST_LENGTH", 2)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    rows = smoke() + EDGE_TEXTS + [("!!! 123", "xx", "only"), ("", "xx", "other"), ("Z" * 300 + " é" * 3, "yy", "a"), ("z" * 300, "yy", "b")]
    got = divergence.source_divergence(docs_of(spark, rows), min_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected_divergence(rows, least)


def test_prefix_levels_keep_the_frequent_terms(spark):
    rows = smoke(SF_SMALL)
    df = Counter((lang or "", t) for text, lang, _ in rows
                 for t in set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))))
    texts = docs_of(spark, rows).selectExpr("coalesce(lang, '') AS lang", "cast(coalesce(text, '') AS binary) AS text")
    got = divergence.kept_terms(texts, 10).collect()
    assert sorted(map(tuple, got)) == sorted(k for k, n in df.items() if n >= 10) and any(len(r.term) > 12 for r in got)


def expected_links(rows, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.asarray(v, float) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, usable)]
    n = len(rows)
    link = [[j for j in range(n) if i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold] for i in range(n)]
    root, out = {}, []
    for i in range(n):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in link[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            root |= dict.fromkeys(seen, min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
        out.append((rows[i][0], len(link[i]), root[i], rows[i][0] == root[i]))
    return out


KEY = lambda r: tuple((x is None, x or 0) for x in r)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, cid string, size int").repartition(4)


def clustered(seed=3):
    """Lone vectors, chains, exact copies, and a dense group much wider than a window and a cell."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(150)]
    for _ in range(30):
        centre = rng.standard_normal(16)
        out += [centre + 0.08 * rng.standard_normal(16) for _ in range(rng.integers(2, 6))]
    centre = rng.standard_normal(16)
    out += [centre + 0.22 * rng.standard_normal(16) for _ in range(220)]
    step = rng.standard_normal(16) * 0.2
    out += [out[0] + k * step for k in range(12)]
    out += [out[7]] * 40
    return [(1000 - k, np.float32(v).tolist()) for k, v in enumerate(out)]


@pytest.mark.parametrize(("cell", "fan", "window", "block"), [(256, 16, 128, 2048), (8, 3, 4, 32)])
def test_vector_links_equal_brute_force(spark, monkeypatch, cell, fan, window, block):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "FAN", fan)
    monkeypatch.setattr(vector_dedup, "SORTED_BLOCK", block)
    rows = clustered()
    got = vector_dedup.near_vectors(vectors_of(spark, rows), window=window, miss=0.001).collect()
    want = expected_links(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(w[1] for w in want) > 60 and sum(w[1] == 0 for w in want) > 100


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [1e-30, 0, 0]), (4, [0, 0, 0]), (5, None), (6, []), (7, [1, None, 0]), (8, [1, nan, 0]),
            (9, [inf, 0, 0]), (10, [1, 0]), (11, [3, 0]), (12, [-1, 0, 0]), (13, [0, 1, 0]), (13, [0, 1, 0]), (None, [0, 1, 0]),
            (None, [0, 0, 1]), (None, [0, 0, 1]), (16, [0, 1, 0.32]), (17, [0, 1, 0.33]), (4, [0, 0, 0]), (20, [5e-39, 0, 0])]
    got = vector_dedup.near_vectors(vectors_of(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(expected_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]), key=KEY)
    assert vector_dedup.near_vectors(vectors_of(spark, [])).collect() == []


def test_passes_follow_from_the_number_of_classes():
    n = [vector_dedup.n_passes(k, 128, 0.95, 0.01) for k in (0, 100, 10**4, 10**6, 10**10)]
    assert n == sorted(n) and n[0] == n[1] == 1 and n[-1] < 100


def test_mining_edges(edge, empty):
    rows = [(r[1], r[2], r[3]) for r in edge_rows()]
    got = collocation.collocations(edge, min_count=3)
    assert sorted(map(tuple, got.collect())) == expected_phrases(rows, 3, 2000)
    got = divergence.source_divergence(edge, min_docs=2)
    assert sorted(map(tuple, got.collect())) == expected_divergence(rows, 2)
    assert collocation.collocations(empty).collect() == [] and divergence.source_divergence(empty).collect() == []


def test_new_queries_are_registered():
    assert {"op11_collocations", "op12_source_divergence", "op13_vector_dedup"} <= set(queries.QUERIES)
    assert {"op11_collocations", "op12_source_divergence"} <= set(queries.ORACLES)
