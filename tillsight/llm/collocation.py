"""Phrase collocation mining with stripes.

The stripe of a prefix is a counter of the words that follow it. A task counts the stripes of its
documents (for prefixes of 0, 1 and 2 words), Spark brings the stripes of a prefix together and adds
them up element by element. Everything the scores need is in that one structure: an entry of a
stripe is the frequency of prefix and word (an extension), the whole stripe of the empty prefix is the word
total of a language, a prefix's own frequency is its entry one level up, and the largest entries
of the stripes that a phrase begins or ends tell whether a longer phrase subsumes it.

Levels are built one after another. A phrase is at most as frequent as its parts, so a level only
counts entries whose parts reached ``min_count``: a filter of fixed size says which (false alarms are
counted too and fall by their exact count). Stripes of a prefix that holds more than a thousandth of all words (at
most a thousand a level, known exactly from the level before), and that of the empty prefix, are cut by
the next word into ``SLICES`` slices, so no hot prefix meets in one task.

Defined results: null language is ``und``, null text is empty; documents without words give nothing; repeated rows
count each time; an empty table gives an empty result; other columns of the input are not looked at.
Words may be of any length, and a text of any length is read whole (a task's tables hold about ``HELD`` words
beside one Arrow batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import bound_batches, stage
from tillsight.llm.tokens import Numbering, combined, hashes, key_filter, passes

#: Words that a task holds before it writes its stripes.
HELD = 2_000_000
#: Bytes of text that are cut into words at once (words as Python objects take ten times their bytes).
CHUNK = 4 << 20
SLICES = 64
HOT_SHARE = 1000
_BREAK = b"\xff"            # no byte of UTF-8: stands between pieces
_MAP = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _BREAK * 10 + b" abcdefghijklmnopqrstuvwxyz")
_SCHEMA = "lang string, prefix string, slice int, next array<string>, n array<long>"
_ROWS_AT_ONCE = 20_000


def _tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words and breaks of all texts, about ``CHUNK`` bytes at a time; chunks end at breaks."""
    body = _BREAK.join([b"", *texts, b""]).translate(_MAP)
    at = 0
    while at < len(body):
        end = body.find(_BREAK, at + CHUNK) + 1 or len(body)
        yield body[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def _stripes(lang: str, prefix: np.ndarray, follow: np.ndarray, n: np.ndarray, cut: np.ndarray, words: pa.Array,
             word_hashes: np.ndarray, name) -> Iterator[pa.RecordBatch]:
    """Entries (ordered by prefix) as rows of (prefix, slice) with parallel lists."""
    piece = np.where(cut, word_hashes[follow] % SLICES, 0)
    order = np.lexsort((piece, prefix))
    prefix, follow, n, piece = prefix[order], follow[order], n[order], piece[order]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (piece[1:] != piece[:-1])]) if len(prefix) else prefix
    ends = np.append(first, len(prefix))
    for at in range(0, len(first), _ROWS_AT_ONCE):
        rows = first[at:at + _ROWS_AT_ONCE]
        lo, hi = rows[0], ends[min(at + _ROWS_AT_ONCE, len(first))]
        offsets = pa.array(np.append(rows, hi) - lo, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows), pa.string()), name(prefix[rows]), pa.array(piece[rows], pa.int32()),
             pa.ListArray.from_arrays(offsets, words.take(pa.array(follow[lo:hi]))),
             pa.ListArray.from_arrays(offsets, pa.array(n[lo:hi], pa.int64()))],
            names=["lang", "prefix", "slice", "next", "n"])


def _counted(lang: str, numbers: np.ndarray, numbering: Numbering, level: int, filters, hot: set) -> Iterator[pa.RecordBatch]:
    """The stripes of one language's words (number 0 stands between pieces)."""
    known = [b"", *numbering.words()[1:]]
    words, h = pa.array(known, pa.binary()).cast(pa.string()), hashes(known)
    size, tag = len(known), int(hashes([lang.encode()])[0])
    if level == 0:
        n = np.bincount(numbers, minlength=size)
        follow = np.flatnonzero(n[1:]) + 1
        zero = np.zeros(len(follow), np.int64)
        yield from _stripes(lang, zero, follow, n[follow], zero == 0, words, h, lambda p: pa.array([""] * len(p), pa.string()))
        return
    fit = passes(filters[0], combined([tag, h]))
    fit[0] = False
    a, b = numbers[:-1], numbers[1:]
    at = np.flatnonzero(fit[a] & fit[b])
    pairs, which, n = np.unique(a[at] * size + b[at], return_inverse=True, return_counts=True)
    first, second = pairs // size, pairs % size
    if level == 1:
        heavy = np.fromiter((w in hot for w in known), bool, size) if hot else np.zeros(size, bool)
        yield from _stripes(lang, first, second, n, heavy[first], words, h, lambda p: words.take(pa.array(p)))
        return
    fit = passes(filters[1], combined([tag, h[first], h[second]]))
    good = fit[which]
    left = np.flatnonzero(good[:-1] & good[1:] & (at[1:] == at[:-1] + 1))
    triples, n = np.unique(which[left] * size + second[which[left + 1]], return_counts=True)
    prefix, follow = triples // size, triples % size

    def name(p: np.ndarray) -> pa.Array:
        return pa.array([known[x] + b" " + known[y] for x, y in zip(first[p], second[p])], pa.binary()).cast(pa.string())

    heavy = np.zeros(len(pairs), bool)
    if hot:
        for k in np.unique(prefix).tolist():
            heavy[k] = known[first[k]] + b" " + known[second[k]] in hot
    yield from _stripes(lang, prefix, follow, n, heavy[prefix], words, h, name)


def _level(texts: DataFrame, level: int, filters: list, hot: dict[str, set]) -> DataFrame:
    """``lang, prefix, word, f``: the merged stripes of all prefixes of ``level`` words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbering, list]] = {}
        total = 0

        def out():
            for lang, (numbering, parts) in held.items():
                yield from _counted(lang, np.concatenate(parts).astype(np.int64), numbering, level, [f.value for f in filters], hot.get(lang, set()))
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pc.equal(langs.indices, k))
                if lang not in held:
                    held[lang] = (Numbering(), [])
                    held[lang][0]([_BREAK])
                numbering, parts = held[lang]
                for words in _tokens(own.to_pylist()):
                    parts.append(numbering(words).astype(np.int32))
                    total += len(words)
            if total >= HELD:
                yield from out()
                total = 0
        yield from out()

    parts = texts.mapInArrow(count, _SCHEMA).repartition("lang", "prefix", "slice")
    # the merge needs no second exchange: entries of a (prefix, slice) are together already
    return (parts.select("lang", "prefix", "slice", F.inline(F.arrays_zip("next", "n")))
            .groupBy("lang", "prefix", "slice", F.col("next").alias("word")).agg(F.sum("n").alias("f"))
            .select("lang", "prefix", "word", "f"))


def _phrase() -> Column:
    return F.concat_ws(" ", "prefix", "word")


def _hot(level: DataFrame, total: int, phrase: Column) -> dict[str, set]:
    """Phrases that hold over a thousandth of all words: at most ``HOT_SHARE`` of any one length."""
    out: dict[str, set] = {}
    for r in level.where(F.col("f") * HOT_SHARE > total).select("lang", phrase.alias("p")).collect():
        out.setdefault(r["lang"], set()).add(r["p"].encode())
    return out


def _score(l_: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact in 38 digits."""
    whole = lambda c: c.cast("decimal(38,0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")
    return F.call_function("div", whole(top), whole(l_.cast("decimal(18,0)") * r.cast("decimal(18,0)")))



def collocations(docs: DataFrame, *, min_count: int = 10, top: int = 2000, subsumed_percent: int = 50) -> DataFrame:
    """The ``top`` phrases of 2 or 3 words of each language, with the counts behind their scores.

    ``lang, rank, phrase, a, l, r, n, score``: ``a`` occurrences of the phrase, ``l`` and ``r`` those
    of the two parts at its lowest-scoring cut, ``n`` words of the language. Phrases that a longer one holds
    for at least ``subsumed_percent`` of their occurrences are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    one = stage(_level(texts, 0, [], {}).select("lang", "word", "f"), "collocation-words")
    lang_words = one.groupBy("lang").agg(F.sum("f").alias("n"))
    total = lang_words.agg(F.sum("n")).first()[0] or 0
    known = one.where(F.col("f") >= min_count)
    filters = [key_filter(known, F.col("lang"), F.col("word"))]
    two = stage(_level(texts, 1, filters, _hot(one, total, F.col("word"))).where(F.col("f") >= min_count), "collocation-pairs")
    filters.append(key_filter(two, F.col("lang"), F.col("prefix"), F.col("word")))
    three = stage(_level(texts, 2, filters, _hot(two, total, _phrase())).where(F.col("f") >= min_count), "collocation-triples")

    freq = two.select("lang", _phrase().alias("p"), "f")
    word = known.select("lang", F.col("word").alias("p"), "f")

    def with_f(df: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
        return df.join(table.select("lang", F.col("p").alias(key), F.col("f").alias(name)), ["lang", key])

    ends = three.select("lang", F.col("f"), _phrase().alias("phrase"), F.col("prefix").alias("head"), F.col("word").alias("last"),
                        F.split("prefix", " ").alias("w"))
    longest = (ends.select("lang", "f", F.explode(F.array("head", F.concat_ws(" ", F.col("w")[1], "last"))).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))

    pairs = two.select("lang", _phrase().alias("phrase"), F.col("f").alias("a"), F.col("prefix").alias("w1"), F.col("word").alias("w2"))
    pairs = with_f(with_f(pairs, "w1", word, "l"), "w2", word, "r").join(longest, ["lang", "phrase"], "left")
    pairs = (pairs.where(F.coalesce(100 * F.col("longer") < subsumed_percent * F.col("a"), F.lit(True)))
             .select("lang", "phrase", "a", F.struct(_score(F.col("l"), F.col("r")).alias("score"), F.lit(1).alias("k"), "l", "r").alias("cut")))

    triples = ends.select("lang", "phrase", F.col("f").alias("a"), F.col("w")[0].alias("w1"), F.concat_ws(" ", F.col("w")[1], "last").alias("w23"),
                          F.col("head").alias("w12"), F.col("last").alias("w3"))
    triples = with_f(with_f(with_f(with_f(triples, "w1", word, "l1"), "w23", freq, "r1"), "w12", freq, "l2"), "w3", word, "r2")
    cut = lambda k: F.struct(_score(F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                             F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    triples = triples.select("lang", "phrase", "a", F.least(cut(1), cut(2)).alias("cut"))

    scored = (pairs.unionByName(triples).join(lang_words, "lang")
              .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
