"""Toxicity by weak supervision.

1. Voters: fixed lexicons, lexicons of words and word stems learned from labelled rows (those that
   stand in toxic documents far more often than chance allows, by a likelihood ratio), and patterns
   over their hits. Each votes toxic (1), clean (-1) or abstains (0) on a whole text.
2. Label model: the vote patterns of all documents are counted (at most 3 ** voters rows); their class
   tables, so the voters' accuracies, come from expectation-maximisation, and voters that are
   correlated within a class share their weight (1 / (1 + sum of positive correlations)).
3. A linear classifier (logistic regression) learns the posterior labels of a sample over votes,
   words and stems, and scores every whole text.

The classifier and the lexicons are fitted on about ``max_rows`` labelled rows, chosen by a hash of the
id (the documented bound of the fit); votes and scores cover all documents.

Defined results: null and empty texts are scored by their votes like any other; labels of ids without a
document, null ids and null labels teach nothing; without any usable label the lexicons are the fixed ones
and the score is the label model's; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import bound_batches, letter_runs, stage
from tillsight.llm.quality import LabelModel, fit_votes

#: Insults and contempt in four languages, second persons.
INSULTS = frozenset("""idiot moron loser clown stupid fool imbecile dumbass jerk bastard trottel dummkopf arschloch
imbécile connard crétin idiota imbécil estúpido""".split())
CONTEMPT = frozenset("""scum trash worthless pathetic disgusting vermin filth abschaum ordure basura escoria""".split())
SECOND_PERSON = frozenset("you your du dich dir tu toi vous eres tú".split())

#: Share of the learned features that chance may have put among them.
FALSE_SHARE = 0.2
STEMS = (4, 5, 6)
VOTERS = ("insult", "contempt", "word", "stem4", "stem5", "stem6", "several", "addressed", "dense", "none")
#: Vote shares (clean, abstain, toxic) of a voter in clean and in toxic documents to begin with.
PRIOR = np.array([[0.30, 0.695, 0.005], [0.01, 0.49, 0.50]])


def kinds(word: str) -> list[str]:
    """The word and its stems as features: "=word", "4word", "5word.", ..."""
    return [f"={word}", *[f"{n}{word[:n]}" for n in STEMS if len(word) >= n]]


@dataclass(frozen=True)
class Lexicon:
    """Features that count as hits of the learned voters."""
    features: frozenset[str]

    def hits(self, word: str) -> tuple[bool, ...]:
        """Whether a word hits each of the voters insult, contempt, word, stem4, stem5, stem6."""
        return (word in INSULTS, word in CONTEMPT, f"={word}" in self.features,
                *[f"{n}{word[:n]}" in self.features for n in STEMS])


def cast_votes(words: list[str], lexicon: Lexicon, memory: dict[str, tuple[bool, ...]]) -> list[int]:
    """One vote per voter for the words of a text."""
    found = {}
    for word in set(words):
        hit = memory.get(word)
        if hit is None:
            hit = memory[word] = lexicon.hits(word)
        if any(hit):
            found[word] = hit
    if not found:
        return [0] * (len(VOTERS) - 1) + [-1]
    votes = [int(any(h[i] for h in found.values())) for i in range(6)]
    at = [i for i, w in enumerate(words) if w in found]
    near = any(w in SECOND_PERSON for i in at for w in words[max(0, i - 4):i + 5])
    return [*votes, int(len(found) > 1), int(near), 1 if 100 * len(at) >= len(words) else 0, 0]


def _vote_udf(lexicon: Lexicon):
    @F.pandas_udf(T.ArrayType(T.ByteType()))
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, tuple[bool, ...]] = {}
        for texts in batches:
            if len(memory) > 300_000:
                memory.clear()
            yield pd.Series([cast_votes(letter_runs(t or ""), lexicon, memory) for t in texts], dtype=object)
    return vote


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_features(texts: pd.Series) -> pd.Series:
    """Distinct words and stems of each text."""
    return pd.Series([sorted({k for w in set(letter_runs(t or "")) for k in kinds(w)}) for t in texts], dtype=object)


def associated(rows: DataFrame, keep: int, least: float) -> list[str]:
    """Features that mark class 1 (at most ``keep``): rows hold ``features`` and ``p``, the label or posterior.

    A feature counts when a share of ``least`` of its documents is of class 1 and it passes a cut by false discovery
    rate (Benjamini and Hochberg's step-up over all features, a feature's chance being bounded by exp(-likelihood ratio)
    against the base rate): about ``FALSE_SHARE`` of what is kept may be there by chance, however many features are
    tried, so the words of a language with few labelled rows are not held to the luckiest of all. Rows with equal features (copies
    of one text) count once, or a copied toxic text would make all of its words suspect.
    """
    rows = rows.groupBy("features").agg(F.avg("p").alias("p"))
    base = rows.agg(F.sum("p").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not base["n"] or not base["t"]:
        return []
    share = min(max(base["t"] / base["n"], 1e-4), 1 - 1e-4)
    counted = stage(rows.select("p", F.explode("features").alias("feature")).groupBy("feature")
                    .agg(F.sum("p").alias("t"), F.count(F.lit(1)).alias("n")).where("n >= 3"), "features")
    tried = math.log(max(counted.count(), 1) / FALSE_SHARE)
    rate = F.col("t") / F.col("n")
    ratio = (F.col("t") * F.log(rate / F.lit(share))
             + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((1 - rate) / F.lit(1 - share))).otherwise(0.0))
    best = (counted.where(rate >= least).withColumn("ratio", ratio).where(F.col("ratio") >= tried - math.log(keep))
            .orderBy(F.col("ratio").desc(), "feature").limit(keep).select("feature", "ratio")).collect()   # at most ``keep`` rows
    passed = [k for k, r in enumerate(best, 1) if r["ratio"] >= tried - math.log(k)]
    return [r["feature"] for r in best[:max(passed, default=0)]]


def voter_weights(patterns: np.ndarray, counts: np.ndarray, model: LabelModel) -> np.ndarray:
    """1 / (1 + a voter's positive correlations with the others within the classes)."""
    if not len(patterns):
        return np.ones(patterns.shape[1])
    log = model.log_odds()[np.arange(patterns.shape[1]), patterns + 1].sum(1)
    toxic = 1 / (1 + np.exp(-np.clip(log + np.log(model.share_good / (1 - model.share_good)), -500, 500)))
    together = np.zeros((patterns.shape[1],) * 2)
    for mass in (counts * toxic, counts * (1 - toxic)):
        mean = (mass[:, None] * patterns).sum(0) / max(mass.sum(), 1e-9)
        off = patterns - mean
        cov = (off * mass[:, None]).T @ off / max(mass.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        together += mass.sum() / counts.sum() * np.clip(cov / np.outer(sd, sd), 0, 1)
    np.fill_diagonal(together, 0)
    return 1 / (1 + together.sum(1))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: dict[str, float]                # by feature; "#voter:vote" for votes
    bias: float


def _vote_names(column: Column) -> Column:
    return F.transform(column, lambda v, i: F.concat(F.lit("#"), i.cast("string"), F.lit(":"), v.cast("string")))


def fit_toxicity(docs: DataFrame, labelled: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                 label: str = "toxic", max_rows: int = 8000, max_lexicon: int = 3000,
                 max_features: int = 2000) -> ToxicityModel:
    """Model of ``docs`` with the labels of ``labelled`` (doc_id, label): only these rows teach labels."""
    bound_batches(docs.sparkSession)
    usable = labelled.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    dice = F.pmod(F.xxhash64(F.col(doc_id), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = min(1.0, max_rows / max(usable.count(), 1))
    # about max_rows short rows, so the broadcast is bounded
    chosen = F.broadcast(usable.where(dice < share).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("p")))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = stage(texts.join(chosen, F.col("id") == F.col("_id"))
                   .select("p", "text", text_features("text").alias("features")), "toxic-sample")
    lexicon = Lexicon(frozenset(associated(sample, max_lexicon, 0.95)))
    vote = _vote_udf(lexicon)
    histogram = docs.select(vote(F.col(text)).alias("votes")).groupBy("votes").count().collect()  # <= 3 ** voters rows
    patterns = np.array([r["votes"] for r in histogram], dtype=np.int64).reshape(-1, len(VOTERS))
    counts = np.array([r["count"] for r in histogram], dtype=float)
    rate = sample.agg(F.avg("p")).first()[0]
    start = min(max(rate if rate is not None else 0.05, 0.01), 0.5)
    model = fit_votes(patterns, counts, prior=PRIOR, start=start)
    add = model.log_odds() * voter_weights(patterns, counts, model)[:, None]
    weights = {f"#{i}:{v}": float(add[i, v + 1]) for i in range(len(VOTERS)) for v in (-1, 0, 1)}
    bias = float(np.log(model.share_good / (1 - model.share_good)))
    if rate is None:
        return ToxicityModel(lexicon, weights, bias)
    # posterior labels of the sample, then a linear classifier over votes, words and stems
    names = _vote_names(vote(F.col("text")))
    odds = F.aggregate(F.transform("names", lambda n: F.coalesce(*[F.when(n == k, F.lit(w)) for k, w in weights.items()])),
                       F.lit(bias), lambda a, b: a + b)
    judged = stage(sample.select(names.alias("names"), "features")
                   .select("names", "features", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("p")), "toxic-posterior")
    vocabulary = [*weights, *associated(judged, max_features, 0.9)]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="all", outputCol="x")
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")),
                              F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - F.col("p")).alias("w"))))
    points = counted.transform(judged.select("p", F.concat("names", "features").alias("all")))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=60,
                                standardization=False).fit(points.select("x", sides.alias("s")).select("x", "s.*"))
    return ToxicityModel(lexicon, {k: float(w) for k, w in zip(vocabulary, fitted.coefficients.toArray())},
                         float(fitted.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: Column) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; a column of that name is replaced)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(          # bounded by the fit's parameters
        (sorted(model.lexicon.features), model.weights, model.bias))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, weights, bias = shared.value
        lexicon = Lexicon(frozenset(features))
        hits: dict[str, tuple[bool, ...]] = {}
        terms: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            if len(hits) > 300_000:
                hits.clear()
                terms.clear()
            out = []
            for t in texts:
                words = letter_runs(t or "")
                z = bias + sum(weights.get(f"#{i}:{v}", 0.0) for i, v in enumerate(cast_votes(words, lexicon, hits)))
                present: set[str] = set()
                for word in set(words):
                    known = terms.get(word)
                    if known is None:
                        known = terms[word] = tuple(k for k in kinds(word) if k in weights)
                    if known:
                        present.update(known)
                z += sum(weights[k] for k in sorted(present))
                out.append(1 / (1 + math.exp(-min(max(z, -500.0), 500.0))))
            yield pd.Series(out, dtype=float)

    return docs.withColumn("score", score(text))
