"""Toxicity, quality, pieces, language and licences: held-out accuracy, exact references and edge results."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, SF_SMOKE
from tests.llm.conftest import LONG, edge_rows, label_rows, smoke_texts
from tillsight.llm import language, licenses, pieces, quality, queries, toxicity
from tillsight.llm.common import PIECE_MODEL

N_EDGE = len(edge_rows())


# ---- quality ---------------------------------------------------------------

def brute_measures(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    triples = list(zip(words, words[1:], words[2:]))
    twice = {k for k, t in enumerate(triples) if triples.count(t) > 1} if len(triples) < 400 else {
        k for k, t in enumerate(triples) if sum(t == u for u in triples) > 1}
    covered = {k + d for k in twice for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force():
    texts = [t for _, t in smoke_texts() if len(t) < 4000][:80] + [r[1] for r in edge_rows() if r[1] != LONG]
    texts += ["a b c a b c", "a a a a", "x\n\nx\n x\nx", "#*$ %&|<>"]
    for t in texts:
        assert quality.measure_text(t)[:5] == brute_measures(t), repr((t or "")[:80])


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    rows = []
    for acc, coverage in ((0.95, 0.9), (0.9, 0.8), (0.85, 0.7), (0.9, 0.9), (0.92, 0.6)):
        right = rng.random(len(good)) < acc
        rows.append(np.where(rng.random(len(good)) < coverage, np.where(right == good, 1, -1), 0))
    patterns, counts = np.unique(np.array(rows).T, axis=0, return_counts=True)
    model = quality.fit_votes(patterns.astype(np.int8), counts.astype(float))
    assert model.share_good == pytest.approx(0.8, abs=0.03)
    assert model.accuracies() == pytest.approx([0.95, 0.9, 0.85, 0.9, 0.92], abs=0.04)


def test_quality_keeps_clean_and_drops_junk(spark):
    labels = label_rows()
    rows = queries.QUERIES["op6_quality_rules"](spark, SF_SMALL).collect()
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    judged = [(labels[r.doc_id][0], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.97
    assert np.mean([k for q, k in judged if q == 0]) < 0.1


def test_quality_edges(edge, empty):
    out = quality.quality_verdicts(edge)
    assert out.count() == N_EDGE and not out.where("doc_id IN (1, 2, 3)").where("kept").count()
    assert quality.quality_verdicts(edge, carry=["doc_id"]).columns[0] == "doc_id"
    assert quality.quality_verdicts(empty).count() == 0


# ---- toxicity --------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    labels = label_rows()
    rows = [r for r in queries.QUERIES["op1_toxicity"](spark, SF_SMALL).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id][1], r.score) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([s for t, s in held if t == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.85 and np.mean([s >= 0.7 for s in clean]) < 0.02 and np.mean([s >= 0.7 for s in toxic]) > 0.6


@pytest.mark.parametrize("lists", [True, False])
def test_toxicity_by_language(spark, monkeypatch, lists):
    # held-out rows of each language; without the fixed lists everything rests on what is learned
    if not lists:
        monkeypatch.setattr(toxicity, "INSULTS", frozenset())
        monkeypatch.setattr(toxicity, "CONTEMPT", frozenset())
    sf = SF_SMALL.replace("sf0.01", "sf0.1")
    rows = (queries.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
            .groupBy("lang", "toxic").agg(F.avg("predicted").alias("share")).collect())
    share = {(r.lang, r.toxic): r.share for r in rows}
    assert share["en", 1] > 0.85 and share["fr", 1] > 0.8 and share["es", 1] > 0.8 and share["de", 1] > 0.4
    assert max(v for (_, toxic), v in share.items() if not toxic) < 0.005


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.fit_toxicity(edge, labels)
        scored = toxicity.score_toxicity(edge, model, F.col("text"))
        assert scored.columns == edge.columns and scored.where("score BETWEEN 0 AND 1").count() == N_EDGE
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none), F.col("text")).count() == 0


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(0)
    toxic = rng.random(5000) < 0.3
    one = np.where(rng.random(5000) < 0.85, toxic, ~toxic).astype(int) * 2 - 1
    alone = np.where(rng.random(5000) < 0.85, toxic, ~toxic).astype(int) * 2 - 1
    third = np.where(rng.random(5000) < 0.85, toxic, ~toxic).astype(int) * 2 - 1
    patterns, counts = np.unique(np.array([one, one, alone, third]).T, axis=0, return_counts=True)
    model = quality.fit_votes(patterns.astype(np.int8), counts.astype(float), start=0.3)
    w = toxicity.voter_weights(patterns, counts.astype(float), model)
    assert w[0] == pytest.approx(w[1]) and w[0] < 0.75 < w[2]


# ---- pieces ----------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def odd_texts():
    rng = np.random.default_rng(5)
    letters = list(" abe\n\t字é𝔘xyz0")
    return (["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 300)]
            + ["", "   ", " a", "x" * 300, "the" * 200, " " * 50 + "a", "hello world" * 50, "\r\n \v"])


def test_ids_equal_the_library(library):
    model = pieces.load_pieces(pieces.model_bytes(PIECE_MODEL))
    texts = [t for _, t in smoke_texts()] + odd_texts()
    ids, counts = pieces.Encoder(model)(texts)
    cut = np.split(ids, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == library.encode(texts)
    assert pieces.Decoder(model)(ids, counts) == texts


def test_viterbi_reaches_the_library_score():
    from sentencepiece import sentencepiece_model_pb2 as schema
    proto = schema.ModelProto()
    proto.ParseFromString(pieces.model_bytes(PIECE_MODEL))
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for p in proto.pieces:
        p.score = p.score / 1000 if p.score > -1e8 else -50.0
    raw = proto.SerializeToString()
    model, library = pieces.load_pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [t for _, t in smoke_texts()][:60] + odd_texts()
    ids, counts = pieces.Encoder(model)(texts)
    same = 0
    for got, want in zip(np.split(ids, np.cumsum(counts)[:-1]), library.encode(texts)):
        total = [model.scores[[i for i in x if model.types[i] == pieces.NORMAL]].sum() for x in (got.tolist(), want)]
        assert total[0] == pytest.approx(total[1], rel=1e-5)       # equal sums may be cut differently
        same += got.tolist() == want
    assert same > 0.9 * len(texts)
    assert pieces.Decoder(model)(ids, counts) == texts


def test_long_units_agree_with_the_matrix(library):
    model = pieces.load_pieces(pieces.model_bytes(PIECE_MODEL))
    rng = np.random.default_rng(2)
    units = ["▁" + "".join(rng.choice(list("therinéa"), 120)) for _ in range(20)]
    matrix, n = pieces.encode_units(units, model)
    long = [pieces._to_ids(u, pieces._merge_long(u, model), model) for u in units]
    assert [x.tolist() for x in np.split(matrix, np.cumsum(n)[:-1])] == long


def test_pieces_edges(spark, edge, empty):
    raw = pieces.model_bytes(PIECE_MODEL)
    out = pieces.encode_texts(edge, raw)
    assert [c for c in out.columns if c in ("ids", "n_ids", "round_trip")] == ["ids", "n_ids", "round_trip"]
    rows = out.collect()
    assert len(rows) == N_EDGE and all(r.round_trip == (r.doc_id != 14) for r in rows)   # 14 holds the blank mark
    assert all(r.n_ids == len(r.ids) for r in rows) and {r.n_ids for r in rows if r.doc_id in (1, 2)} == {0}
    back = pieces.encode_texts(edge, raw, keep=["doc_id", "text"]).select(
        "text", "round_trip", pieces.decode_ids(F.col("ids"), raw).alias("again")).collect()
    assert all((r.text or "") == r.again for r in back if r.round_trip)
    assert pieces.encode_texts(empty, raw).count() == 0


# ---- language --------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    import duckdb
    true = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_SMALL}/documents.parquet'").fetchall())
    rows = queries.QUERIES["op8_language_id"](spark, SF_SMALL).collect()
    held = [r.lang_pred == true[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(true) and np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_backoff_order():
    model = language.LanguageModel(
        ["x", "y"], (["known"], np.array([[1.0, -1.0]])),
        (["^abcd", "bc", "c"], np.array([[-2.0, 2.0], [3.0, -3.0], [5.0, -5.0]])))
    score = language.Scorer(model)
    said = lambda t: score([t])[0][0]
    assert said("known") == "x" and said("KNOWN 1") == "x"
    assert said("abcde") == "y"                  # the 5-gram ^abcd decides before bc and c
    assert said("xbcx") == "x" and said("c") == "x"
    assert score([None, "", "12 !", "²"]) == [("und", 0.0)] * 4
    assert said("zzz") == "x"                    # nothing known: a tie, first by name


def test_language_edges(spark, edge, empty):
    model = language.fit_languages(edge)
    out = language.predict_languages(edge, model, F.col("text")).collect()
    assert len(out) == N_EDGE and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 16)} == {"und"}
    nothing = language.fit_languages(edge.where(F.lit(False)))
    assert {r.lang_pred for r in language.predict_languages(edge, nothing, F.col("text")).collect()} == {"und"}
    assert language.predict_languages(empty, model, F.col("text")).count() == 0


def test_each_language_keeps_its_own_words(spark):
    # the long texts of one language do not push out the words of another, nor its documents
    rows = [(i, "aa", " ".join(f"a{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)) + " ") for i in range(40)]
    rows += [(100 + i, "bb", "bone btwo bthree") for i in range(4)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string"),
                                   max_docs=40, max_words=20, max_grams=20)
    assert {"bone", "btwo", "bthree"} <= set(model.words[0]) and len(model.words[0]) == 23
    assert language.Scorer(model)(["bone bthree"])[0][0] == "bb"
    assert {"^bone", "three"} <= set(model.grams[0])


# ---- licences --------------------------------------------------------------

def test_licence_variants_share_a_digest(spark, edge, empty):
    mit = licenses.TEXTS["MIT"]
    odd = "Copyright (c) 2021 Some Body\n" + mit.upper().replace('"', "'").replace(", ", " ,\n ")
    docs = spark.createDataFrame([
        (1, mit), (2, odd), (3, mit + " And more."), (4, licenses.TEXTS["ISC"].replace("software", "SOFTWARE")),
        (5, "Intro.\nReleased under the MIT Licence.\nThe end, not licensed under the Apache License, Version 2.0. at all"),
        (6, "x\r\n  LICENSED UNDER CC BY-NC 4.0\r\ny"), (7, None), (8, "")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: ("ISC", ""), 5: (None, "MIT"),
                   6: (None, "CC-BY-NC-4.0"), 7: (None, ""), 8: (None, "")}
    assert licenses.scan_licenses(edge).count() == N_EDGE and licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs, texts={}, notices={}).where("license IS NOT NULL OR notices <> ''").count() == 0


def test_licences_on_the_table(spark):
    import duckdb
    rows = queries.QUERIES["op10_license_scan"](spark, SF_SMOKE).collect()
    lines = {i: set(t.split("\n")) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMOKE}/documents.parquet'").fetchall()}
    for r in rows:
        assert ("MIT" in r.notices.split(",")) == ("Released under the MIT License." in lines[r.doc_id])


def test_every_form_of_a_known_licence_is_found(spark):
    import re
    year, short = "Copyright (c) 2019 Some Body\n\n", {n: licenses._from(licenses.TEXTS[n], "Permission") for n in ("MIT", "ISC")}
    apache = licenses._file("Apache-2.0")
    bsd = licenses._file("BSD-3-Clause")
    cases = [
        ("MIT", short["MIT"]), ("MIT", "The MIT License (MIT)\n\n" + year + short["MIT"]),
        ("MIT", "MIT License\n\nCopyright (c) [year] [fullname]\n\n" + short["MIT"]),
        ("ISC", year + short["ISC"]), ("ISC", "The ISC License\n\n" + year + short["ISC"]),
        ("Apache-2.0", apache), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2019 Some Body")),
        ("Apache-2.0", apache[:apache.index("APPENDIX")]), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + year + bsd),
        ("BSD-3-Clause", re.sub(r"(?m)^[1-3]\.", "*", bsd).replace("HOLDER OR", "OWNER OR")),
        ("BSD-2-Clause", year + re.sub(r"(?m)^3\..*$", "", bsd)),
        ("GPL-2.0-only", licenses._file("GPL-2.0-only")), ("GPL-3.0-only", licenses._file("GPL-3.0-only")),
        ("GPL-3.0-only", licenses._file("GPL-3.0-only").split("How to Apply")[0]), ("MPL-2.0", licenses._file("MPL-2.0")),
        ("CC-BY-SA-4.0", licenses._file("CC-BY-SA-4.0")), ("Zlib", "zlib License\n\n" + year + licenses.TEXTS["Zlib"]),
        (None, bsd.replace("3. Neither", "3. Either"))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]
    assert set(licenses.NOTICES) - set(licenses.KNOWN_TEXTS) == {"CC-BY-4.0", "CC-BY-NC-4.0"}     # as the README says


def test_header_lines_are_notices(spark):
    lines = [("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");'),
             ("Apache-2.0", "//     https://www.apache.org/licenses/LICENSE-2.0"),
             ("MPL-2.0", " * License, v. 2.0. If a copy of the MPL was not distributed with this"),
             ("GPL-2.0-only", " * it under the terms of the GNU General Public License version 2 as"),
             ("", "Licensed under the Apache License, Version 1.1 (the \"License\");")]
    docs = spark.createDataFrame([(i, f"Some words.\n{t}\nmore") for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(lines))] == [name for name, _ in lines]
