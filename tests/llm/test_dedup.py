"""Exact, near and substring de-duplication against brute force, and their defined edge results."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF_SMOKE
from tests.llm.conftest import LONG, edge_rows, smoke_texts
from tillsight.llm import exact_dedup, near_dedup, queries, suffix_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    return BLANKS.sub("", text or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for i, t in rows:
        group = sorted(groups[plain(t)])
        best = group[0]
        out.append((i, None if best[1] else best[2], len(group), hashlib.sha256(plain(t).encode()).hexdigest()))
    return out, len(groups)


@pytest.mark.parametrize("bits", [64, 6])
def test_exact_copies_equal_brute_force(spark, bits):
    # with 6-bit digests nearly all chunks collide: identifiers then rest on the comparison of bytes
    rows = smoke_texts() + [(i, t) for i, t, *_ in edge_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_copies(df, digest_bits=bits).collect()
    want, groups = expected_exact(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == groups


def test_exact_edges(edge, empty):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({plain(t) for t in texts}) == len({plain(r[1]) for r in edge_rows()})
    assert exact_dedup.exact_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).columns == empty.columns


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def expected_near(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)], \
        len({find(x) if sets[x] else (x, 0) for x in range(len(rows))})


def near_variants():
    """A group around the threshold: copies of one text with more and more words changed."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(60):
        words = list(base)
        for j in range(k % 12):
            words[(7 * j + 11 * k) % 120] = f"n{k}x{j}"
        out.append((10_000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies_equal_brute_force(spark, k):
    rows = smoke_texts() + near_variants() + [(i, t) for i, t, *_ in edge_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_copies(df, near_dedup.NearParams(words=k)).collect()
    want, kept = expected_near(rows, k)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == kept


def test_blocks_join_components_without_centres(spark, monkeypatch):
    # many small blocks: the block path alone must find what the centres did not
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = near_variants()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_copies(df, near_dedup.NearParams(words=2)).collect()}
    assert got == {(i, c) for i, _, c in expected_near(rows, 2)[0]}


def test_near_edges(edge, empty):
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sum(r.text == LONG for r in kept.select("text").collect()) == 1
    assert sum(not plain(r.text) for r in kept.select("text").collect()) == 3      # nothing to link them by
    assert near_dedup.near_copies(empty).count() == 0 and near_dedup.drop_near_copies(empty).count() == 0


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(1)
    params = near_dedup.NearParams()
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(30):
            pool = rng.permutation(np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64)))
            cut = int(len(pool) * (1 - share) / 2)
            a, b = np.sort(pool[:len(pool) - cut]), np.sort(pool[cut:])
            true = (len(pool) - 2 * cut) / len(pool)
            regs = [near_dedup.registers(*near_dedup.minima(x, params.buckets)) for x in (a, b)]
            errors.append(near_dedup.estimate(*regs)[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def expected_removed(rows, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for s in range(len(raw) - length + 1):
            seen[raw[s:s + length]] += 1
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                gone[s:s + length] = True
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def substring_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(90), text(30)
    rows = [(100 + k, text(int(rng.integers(0, 40))) + " " + shared[int(rng.integers(0, 40)):] + text(20)) for k in range(12)]
    rows += [(200, other + shared + other + shared), (201, "x" * 900), (202, "ab" * 600), (203, "x" * 399), (204, "é" * 300)]
    return rows


@pytest.mark.parametrize("kinds", [suffix_dedup.MAX_KINDS, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, kinds):
    # with MAX_KINDS 2 the string-by-string path does most of the work
    monkeypatch.setattr(suffix_dedup, "MAX_KINDS", kinds)
    rows = substring_rows() + [(i, t) for i, t in smoke_texts()[:60]] + [(i, t) for i, t, *_ in edge_rows() if t != LONG]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r[:4]) + (r[4],)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=key) == \
        sorted(expected_removed(rows, 400), key=key)


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 11)
    rows = substring_rows()[:3] + [(1, substring_rows()[0][1] * 3 + "tail" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted((i, n, h) for i, _, n, _, h in expected_removed(rows, 400))


def test_planted_passages_of_the_registered_query(spark, tmp_path):
    # passages of over 50 words at odd places of the given documents: those of 400 bytes and more go, shorter ones stay
    rng = np.random.default_rng(9)
    rows, planted = dict(smoke_texts()[:80]), []
    ids = sorted(rows)
    for k in range(24):
        size = 5 if k % 3 == 0 else 8
        passage = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), size)) for _ in range(51 + k))
        for i in (ids[k], ids[24 + 2 * k]):
            at = int(rng.integers(0, len(rows[i]) + 1))
            rows[i] = rows[i][:at] + passage + rows[i][at:]
        planted.append((ids[k], len(passage.encode())))
    rows = sorted(rows.items())
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op9_suffix_dedup"](spark, str(tmp_path)).collect()))
    assert got == sorted(expected_removed(rows, 400))
    removed, alone = {r[0]: r[2] for r in got}, {r[0]: r[2] for r in expected_removed(smoke_texts()[:80], 400)}
    long, short = [p for p in planted if p[1] >= 400], [p for p in planted if p[1] < 400]
    assert long and short
    assert all(removed[i] >= size for i, size in long)
    assert all(removed[i] == 0 for i, _ in short if alone[i] == 0)


def test_kept_bytes_and_edges(edge, empty):
    got = suffix_dedup.remove_repeats(edge, with_kept=True).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (4, 5))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_registered_columns(spark):
    q = queries.QUERIES
    assert q["op2_near_dedup"](spark, SF_SMOKE).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert q["op9_suffix_dedup"](spark, SF_SMOKE).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
