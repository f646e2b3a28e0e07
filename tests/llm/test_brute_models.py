"""Quality verdicts and language predictions of the registered queries against plain versions that keep no tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import SF_SMOKE
from tests.llm.conftest import smoke_texts
from tillsight.llm import queries

BLANK = "\x20\x09\x0A\x0B\x0C\x0D"


def plain_votes(text):
    """Base failure and the nine votes of one text, each rule spelt out."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    again = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    caps = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    marks = sum(c in "!?" for c in text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    odd = sum(ord(c) < 128 and not c.isalpha() and c not in BLANK for c in text)
    kinds = len(set(words))

    def vote(bad, good):
        return -1 if bad else 1 if good else 0
    found = (
        vote(n < 50, n >= 80),
        vote(chars < 2.5 * n or chars > 15 * n, 3.5 * n <= chars <= 10 * n),
        vote(10 * symbols > n, 100 * symbols <= n),
        vote(4 * odd > chars, 10 * odd <= chars),
        vote(5 * again > 2 * len(lines), again == 0),
        vote(5 * len(repeated) > 2 * n, 20 * len(repeated) <= n),
        vote(2 * caps > n, 10 * caps <= n),
        vote(10 * marks > 3 * n, 10 * marks <= n),
        vote(10 * kinds < n, 5 * kinds >= n))
    return n < 50 or 100 * len(repeated) > 50 * n, found


def plain_posteriors(votes):
    """Expectation-maximisation over single documents: two classes, votes independent within a class."""
    total, rules = len(votes), len(votes[0])
    prior = ({-1: 0.30, 0: 0.20, 1: 0.50}, {-1: 0.003, 0: 0.247, 1: 0.75})
    tables = [[dict(p) for _ in range(rules)] for p in prior]
    share = 0.5
    kinds = Counter(votes)

    def posterior(v):
        odds = math.log(share / (1 - share)) + sum(
            math.log(tables[1][r][x]) - math.log(tables[0][r][x]) for r, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))
    for _ in range(1000):
        good = {v: posterior(v) for v in kinds}
        moved, new = 0.0, []
        for c in (0, 1):
            weight = {v: n * (good[v] if c else 1 - good[v]) for v, n in kinds.items()}
            rows = []
            for r in range(rules):
                mass = {x: prior[c][x] * 0.02 * total + 1e-3 + sum(w for v, w in weight.items() if v[r] == x)
                        for x in (-1, 0, 1)}
                rows.append({x: m / sum(mass.values()) for x, m in mass.items()})
                moved = max(moved, *(abs(rows[r][x] - tables[c][r][x]) for x in rows[r]))
            new.append(rows)
        share = (sum(n * good[v] for v, n in kinds.items()) + 0.5 * 0.02 * total) / (total * 1.02)
        tables = new
        if moved < 1e-9:
            break
    return {v: posterior(v) for v in kinds}


def test_quality_verdicts_equal_brute_force(spark):
    judged = {i: plain_votes(t) for i, t in smoke_texts()}
    p = plain_posteriors([v for _, v in judged.values()])
    rows = queries.QUERIES["op6_quality_rules"](spark, SF_SMOKE).collect()
    assert len(rows) == len(judged) and len({r.kept for r in rows}) == 2
    for r in rows:
        failed, votes = judged[r.doc_id]
        assert r.p_good == pytest.approx(p[votes], abs=1e-6)
        assert (r.base_failed, r.kept) == (failed, not failed and p[votes] >= 0.5)


def runs(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_table(counts, languages, keep):
    """Centred log frequencies of the keys kept; ``counts``: (key, language) -> n."""
    total = Counter()
    for (key, _), n in counts.items():
        total[key] += n
    keys = set()
    for c in languages:
        mine = sorted((-n, k) for (k, lang), n in counts.items() if lang == c and n and total[k] > 1)
        keys |= {k for _, k in mine[:keep]}
    sums = {c: sum(counts[k, c] + 0.5 for k in keys) for c in languages}
    out = {}
    for k in keys:
        logs = [math.log((counts[k, c] + 0.5) / sums[c]) for c in languages]
        out[k] = [x - sum(logs) / len(logs) for x in logs]
    return out


def test_languages_equal_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, lang, text FROM '{SF_SMOKE}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs}
    words, grams = Counter(), defaultdict(Counter)
    for i, lang, text in docs:
        if not held[i] and lang is not None:
            words.update((w, lang) for w in runs(text))
    for (w, lang), n in words.items():
        w = f"^{w}$"
        for order in range(1, 6):
            for k in range(len(w) - order + 1):
                grams[order][w[k:k + order], lang] += n
    languages = sorted({lang for _, lang in words})
    known = plain_table(words, languages, 30_000)
    tables = {order: plain_table(grams[order], languages, 8_000) for order in range(1, 6)}

    def row(word):
        if word in known:
            return known[word]
        word = f"^{word}$"
        for order in (5, 4, 3, 2, 1):
            hits = [tables[order][g] for k in range(len(word) - order + 1) if (g := word[k:k + order]) in tables[order]]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits)]
        return [0.0] * len(languages)

    rows = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, SF_SMOKE).collect()}
    assert len(rows) == len(docs) and any(w not in known for _, _, t in docs for w in runs(t))
    for i, _, text in docs:
        got = rows[i]
        assert got.held_out == held[i]
        if not runs(text):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(row, runs(text)))]
        share = [math.exp(x - max(total)) for x in total]
        assert got.score == pytest.approx(max(share) / sum(share), abs=1e-3)
        assert got.lang_pred == languages[total.index(max(total))] or sorted(share)[-2] > 0.999
