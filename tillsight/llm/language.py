"""Language identification: words first, character n-grams for unseen words.

Training counts words and character n-grams per language over a sample of the labelled
rows (a hash of the id decides; about ``max_docs`` rows of each language, the documented bound
of this fitted classifier) and keeps each language's most frequent ``max_words`` words and
``max_grams`` n-grams of each order, whatever the other languages have. So the model has at most
that many keys a language, with a number for every language beside each. A known word scores its log frequency in
each language. An unseen word scores the mean log frequency of its known n-grams of the
longest order that has one, from ``ORDERS[0]`` down to single characters. A text's language
has the highest mean score over its words; ``score`` is its share among the languages.

Every document is scored over its whole text, in Arrow batches of bounded size, with a bounded
memory of scored unseen words in each task.

Defined results: null text and text without a letter give ``und`` with score 0; languages with
equal scores go to the first by name; with no labelled row at all every text is ``und``;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import bound_batches, free_name, letter_runs, stage

ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
SMOOTHING = 0.5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def has_letter(words: list[str]) -> bool:
    """Whether one character is a letter (runs may also hold other numerals)."""
    return any(any(map(str.isalpha, w)) for w in words)


@dataclass
class LanguageModel:
    """Tables of log frequencies: keys in order and a row per key with a column per language."""
    languages: list[str]
    words: tuple[list[str], np.ndarray]
    grams: tuple[list[str], np.ndarray]     # all orders; the length tells the order


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _gram_hashes(codes: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """By order n: a 64-bit hash of the n code points from each position on."""
    out = {1: codes * _FACTOR}
    for n in range(2, longest + 1):
        out[n] = (out[n - 1][:-1] + codes[n - 1:]) * _FACTOR if len(codes) >= n else codes[:0]
        out[n] ^= out[n] >> np.uint64(29)
    return out


class Scorer:
    """Scores batches of texts; remembers word scores (emptied when many, so its memory is bounded)."""

    WORDS_AT_ONCE = 200_000

    def __init__(self, model: LanguageModel, remember: int = 300_000):
        self.languages, self.remember = model.languages, remember
        self.known = {w: i for i, w in enumerate(model.words[0])}
        width = max(len(self.languages), 1)
        self.fixed = np.asarray(model.words[1], np.float32).reshape(-1, width)
        self.gram_rows = np.asarray(model.grams[1], np.float32).reshape(-1, width)
        self.grams = {}
        for n in ORDERS:
            at = [i for i, g in enumerate(model.grams[0]) if len(g) == n]
            hashes = _gram_hashes(_codes("".join(model.grams[0][i] for i in at)), n)[n][::n]
            order = np.argsort(hashes)
            self.grams[n] = (hashes[order], np.array(at, np.int64)[order])
        self._forget()

    def _forget(self) -> None:
        self.rows, self.at = self.fixed, dict(self.known)

    def _learn(self, words: list[str]) -> None:
        """Rows of unseen words: the mean of their known n-grams of the longest order that has one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = _codes("".join([f"^{w}$" for w in words]))
        owner = np.repeat(np.arange(len(words)), sizes)
        hashes = _gram_hashes(codes, max(ORDERS))
        new = np.zeros((len(words), len(self.languages)), np.float32)
        open_ = np.ones(len(words), bool)
        for n in ORDERS:
            known, rows = self.grams[n]
            if not len(known) or len(codes) < n:
                continue
            first = owner[:len(codes) - n + 1]
            at = np.flatnonzero((first == owner[n - 1:]) & open_[first])
            place = np.minimum(np.searchsorted(known, hashes[n][at]), len(known) - 1)
            hit = known[place] == hashes[n][at]
            word = first[at[hit]]
            if len(word):
                begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                times = np.diff(np.append(begin, len(word)))
                new[word[begin]] = np.add.reduceat(self.gram_rows[rows[place[hit]]], begin, axis=0) / times[:, None]
                open_[word] = False
        self.at.update(zip(words, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, new])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, part, size = [], [], 0
        for text in texts:
            words = letter_runs(text) if text else []
            part.append(words if self.languages and has_letter(words) else [])
            size += len(words)
            if size >= self.WORDS_AT_ONCE:
                out += self._score(part)
                part, size = [], 0
        return out + self._score(part)

    def _score(self, lists: list[list[str]]) -> list[tuple[str, float]]:
        if len(self.at) > self.remember + len(self.known):
            self._forget()
        new = {w for words in lists for w in words if w not in self.at}
        if new:
            self._learn(list(new))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(lists)
        some = np.flatnonzero(sizes)
        if len(some):
            ids = np.fromiter((self.at[w] for words in lists for w in words), np.int64, int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[some]
            total = np.add.reduceat(self.rows[ids].astype(np.float64), starts, axis=0)
            share = np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0))
            best = share.argmax(1)
            score = share[np.arange(len(some)), best] / share.sum(1)
            for k, language, value in zip(some, best, score):
                out[k] = (self.languages[language], float(value))
        return out


def _table(counts: DataFrame, languages: list[str], keep: int) -> tuple[list[str], np.ndarray]:
    """Each language's ``keep`` most frequent keys with log frequencies per language (key, lang, n)."""
    wide = counts.groupBy("key").pivot("lang", languages).agg(F.sum("n")).na.fill(0)
    wide = stage(wide.where(sum(F.col(f"`{c}`") for c in languages) > 1), "language-keys")
    chosen = None
    for c in languages:
        mine = wide.where(F.col(f"`{c}`") > 0).orderBy(F.col(f"`{c}`").desc(), "key").limit(keep)
        chosen = mine if chosen is None else chosen.unionByName(mine)
    top = chosen.distinct().orderBy("key").toPandas()                            # at most ``keep`` rows a language
    if top.empty:
        return [], np.empty((0, len(languages)), np.float32)
    n = top[languages].to_numpy(float) + SMOOTHING
    logs = np.log(n / n.sum(0))
    logs -= logs.mean(1, keepdims=True)                                          # what tells languages apart
    return top["key"].to_list(), logs.astype(np.float32)


def fit_languages(rows: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  max_docs: int = 6000, max_words: int = 30_000, max_grams: int = 8_000) -> LanguageModel:
    """Counts over about ``max_docs`` labelled rows a language; the language list is read over all of them."""
    labelled = rows.where(F.col(lang).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    languages = {r["lang"]: r["n"] for r in sizes.collect()}                     # one row a language
    names = sorted(languages)
    if not names:
        return LanguageModel([], ([], np.empty((0, 0))), ([], np.empty((0, 0))))
    # as many rows of each language, chosen by a hash of the id
    share = F.coalesce(*[F.when(F.col(lang) == name, F.lit(max_docs / n)) for name, n in languages.items()])
    dice = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(dice < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for name, body in zip(batch["lang"], batch["text"]):
                for word, n in Counter(letter_runs(body or "")).items():
                    found[name, word] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["lang", "key", "n"])

    counted = stage(sample.mapInPandas(count, "lang string, key string, n long").groupBy("lang", "key")
                    .agg(F.sum("n").alias("n")), "language-words")
    padded = counted.select("lang", "n", F.concat(F.lit("^"), F.col("key"), F.lit("$")).alias("w"))
    grams = []
    for order in ORDERS:
        cut = (padded.where(F.length("w") >= order)
               .select("lang", "n", F.explode(F.expr(
                   f"transform(sequence(1, length(w) - {order - 1}), i -> substring(w, i, {order}))")).alias("key"))
               .groupBy("lang", "key").agg(F.sum("n").alias("n")))
        grams.append(_table(cut, names, max_grams))
    return LanguageModel(names, _table(counted, names, max_words),
                         ([g for keys, _ in grams for g in keys], np.concatenate([rows for _, rows in grams])))


def predict_languages(docs: DataFrame, model: LanguageModel, text: Column) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced)."""
    bound_batches(docs.sparkSession)
    # bounded by the fit's parameters; plain values, since a broadcast is read without this package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(LanguageModel(*shared.value))
        for texts in batches:
            yield pd.DataFrame(score(texts.tolist()), columns=["lang_pred", "score"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = free_name(docs, "found")
    return (docs.select(*[F.col(c) for c in keep], predict(text).alias(found))
            .select(*keep, f"{found}.lang_pred", f"{found}.score"))
