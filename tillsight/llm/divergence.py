"""Source divergence audit: how far the term use of each source lies from that of its language's other sources.

Which terms are frequent enough is found by iceberg prefix refinement. Level by level, tasks count the distinct
documents of every term prefix of the level's length in bytes (6, 36, 216 ...), Spark adds the counts up, and
prefixes in fewer than ``min_docs`` documents are discarded: no term below them can be kept, so none is
looked at again. A term that ends within a level's length is complete there, its count is exact, and it is
kept or dropped for good. The next level extends only the surviving prefixes, until none is left.

Survivors reach the tasks as a filter of fixed size (``tokens.key_filter``); what passes it by
accident is counted too and falls by its exact count, or by the join with the kept terms at the end.

Smoothed shares ``p`` of the kept terms are exact integers. Pairs of sources are summed up in blocks of
terms and sources: a task holds the shares of at most 2 x ``BLOCK`` sources for about ``TERMS`` terms.

Defined results: null text, language and source are read as the empty string; a group without terms has count 0 everywhere,
a language without kept terms has value 0 for all its pairs; repeated rows are documents of their own; ties in
value are ranked by item; an empty table gives an empty result; other columns of the input are not looked at.
Texts and terms of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import bound_batches, stage
from tillsight.llm.tokens import combined, hashes, key_filter, passes

#: Length of the first level's prefixes in bytes; each further level's are ``GROWTH`` times as long.
FIRST_LENGTH, GROWTH = 6, 6
BLOCK, TERMS = 128, 4096
#: Terms a task holds before it writes their counts.
HELD = 3_000_000
#: Bytes of text whose terms are Python objects at one time (they take ten times their bytes).
CHUNK = 4 << 20
ROWS_AT_ONCE = 20_000
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Bytes outside terms become blanks, A-Z is lower-cased.
_MAP = bytes(ord(chr(b).lower()) if b < 0x80 and b in _LETTERS else b if b in _LETTERS else 0x20 for b in range(256))


class _Held:
    """Terms of at least ``least`` bytes of the documents a task has met, by language, each with its owner (document or source)."""

    def __init__(self, distinct: bool, least: int = 1):
        self.distinct, self.total, self.langs = distinct, 0, {}
        self.cut = bytes.split if least == 1 else re.compile(rb"[^ ]{%d,}" % least).findall

    def add(self, lang: str, owner: int, text: bytes) -> None:
        words = self.cut(text.translate(_MAP))
        if self.distinct:
            words = list(set(words))
        entry = self.langs.setdefault(lang, {"words": [], "owners": [], "sizes": [], "arrays": [], "bytes": 0})
        entry["words"] += words
        entry["owners"].append(owner)
        entry["sizes"].append(len(words))
        entry["bytes"] += len(text)
        self.total += len(words)
        if entry["bytes"] >= CHUNK:
            self._pack(entry)

    @staticmethod
    def _pack(entry: dict) -> None:
        entry["arrays"].append(pa.array(entry["words"], pa.binary()))
        entry["words"], entry["bytes"] = [], 0

    def full(self) -> bool:
        return self.total >= HELD

    def empty(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """Language, words, owners and numbers of all that is held, which is forgotten."""
        for lang, entry in self.langs.items():
            self._pack(entry)
            coded = pa.concat_arrays(entry["arrays"]).dictionary_encode()
            yield (lang, coded.dictionary.to_pylist(), np.repeat(np.array(entry["owners"], np.int64), entry["sizes"]),
                   coded.indices.to_numpy(zero_copy_only=False))
        self.langs, self.total = {}, 0


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _level(texts: DataFrame, length: int, before: int, survivors: Broadcast | None) -> DataFrame:
    """``lang, key, complete, docs`` for the prefixes of ``length`` bytes of terms longer than ``before``."""
    def counted(held: _Held) -> Iterator[pa.RecordBatch]:
        for lang, known, doc, term in held.empty():
            live = np.arange(len(known))
            if survivors is not None:
                places = combined([int(hashes([lang.encode()])[0]), hashes([known[i][:before] for i in live])])
                live = live[passes(survivors.value, places)]
            prefixes: dict[tuple, int] = {}
            prefix = np.full(len(known), -1)
            for i in live.tolist():
                prefix[i] = prefixes.setdefault((known[i][:length], len(known[i]) <= length), len(prefixes))
            of = prefix[term]
            good = of >= 0
            pairs = np.unique(doc[good] * max(len(prefixes), 1) + of[good])
            docs = np.bincount(pairs % max(len(prefixes), 1), minlength=len(prefixes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(prefixes), pa.string()), pa.array([k for k, _ in prefixes], pa.binary()),
                 pa.array([c for _, c in prefixes], pa.bool_()), pa.array(docs, pa.int64())],
                names=["lang", "key", "complete", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = _Held(distinct=True, least=before + 1), 0
        for batch in batches:
            for lang, text in zip(_column(batch, "lang"), batch.column(1)):
                held.add(lang, n, text.as_py())
                n += 1
                if held.full():
                    yield from counted(held)
        yield from counted(held)

    return (texts.select("lang", "text").mapInArrow(count, "lang string, key binary, complete boolean, docs long")
            .repartition("lang", "key").groupBy("lang", "key", "complete").agg(F.sum("docs").alias("docs")))


def kept_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` of the terms in at least ``min_docs`` documents of a language, by prefix refinement."""
    before, length, survivors, kept = 0, FIRST_LENGTH, None, None
    while True:
        found = stage(_level(texts, length, before, survivors).where(F.col("docs") >= min_docs), f"prefixes-{length}")
        done = found.where("complete").select("lang", F.col("key").cast("string").alias("term"))
        kept = done if kept is None else kept.unionByName(done)
        open_ = found.where(~F.col("complete"))
        if open_.isEmpty():
            return kept
        survivors = key_filter(open_, F.col("lang"), F.col("key"))
        before, length = length, length * GROWTH


def _term_counts(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, count`` of the kept terms that a group has."""
    wanted = key_filter(kept, F.col("lang"), F.col("term"))

    def counted(held: _Held, sources: list[str]) -> Iterator[pa.RecordBatch]:
        """A row for each term, with the sources that have it and their counts."""
        names = pa.array(sources, pa.string())
        for lang, known, source, term in held.empty():
            words = pa.array(known, pa.binary()).cast(pa.string())
            number = np.cumsum(good := passes(wanted.value, combined([int(hashes([lang.encode()])[0]), hashes(known)]))) - 1
            words, at = words.filter(pa.array(good)), good[term]
            codes = number[term[at]] * len(sources) + source[at]
            if len(words) * len(sources) <= HELD:                # a table of all terms and sources; else sorted
                n = np.bincount(codes)
                codes = np.flatnonzero(n)
                n = n[codes]
            else:
                codes, n = np.unique(codes, return_counts=True)
            of = codes // len(sources)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
            ends = np.append(first, len(of))
            for at in range(0, len(first), ROWS_AT_ONCE):
                rows = first[at:at + ROWS_AT_ONCE]
                lo, hi = rows[0], ends[min(at + ROWS_AT_ONCE, len(first))]
                offsets = pa.array(np.append(rows, hi) - lo, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), words.take(pa.array(of[rows])),
                     pa.ListArray.from_arrays(offsets, names.take(pa.array(codes[lo:hi] % len(sources)))),
                     pa.ListArray.from_arrays(offsets, pa.array(n[lo:hi], pa.int64()))],
                    names=["lang", "term", "source", "count"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sources = _Held(distinct=False), {}
        for batch in batches:
            for lang, source, text in zip(_column(batch, "lang"), _column(batch, "source"), batch.column(2)):
                held.add(lang, sources.setdefault(source, len(sources)), text.as_py())
                if held.full():
                    yield from counted(held, list(sources))
                    sources.clear()
        yield from counted(held, list(sources))

    parts = (texts.select("lang", "source", "text")
             .mapInArrow(count, "lang string, term string, source array<string>, count array<long>").repartition("lang", "term"))
    # all counts of a term are together, so their sums need no second exchange
    return (parts.select("lang", "term", F.inline(F.arrays_zip("source", "count")))
            .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
            .join(kept.hint("shuffle_hash"), ["lang", "term"], "left_semi"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact."""
    whole = lambda c: c.cast("decimal(38,0)")
    top = whole(F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"))
    return F.when(terms > 0, F.call_function("div", top, whole(total + 2 * terms)) + 1)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Summed distance of every pair of sources (one of block ``bi``, one of ``bj``) over one bucket of terms."""
    lang, bi, bj = rows["lang"].iloc[0], rows["bi"].iloc[0], rows["bj"].iloc[0]
    heads = rows[rows["term"].isna()].sort_values("idx")
    terms = rows[rows["term"].notna()]
    idx, zero = heads["idx"].to_numpy(np.int64), heads["p"].to_numpy(np.int64)
    column, uniq = pd.factorize(terms["term"])
    p = np.repeat(zero[:, None], len(uniq), axis=1)
    p[np.searchsorted(idx, terms["idx"].to_numpy(np.int64)), column] = terms["p"].to_numpy(np.int64)
    absent = int(heads["n_terms"].iloc[0]) - len(uniq)
    left, right = np.flatnonzero(idx // BLOCK == bi), np.flatnonzero(idx // BLOCK == bj)
    out = []
    for g in left:
        other = right[right > g]
        value = _apart(p[g][None, :], p[other]).sum(axis=1)
        if absent:
            value = value + absent * _apart(zero[g], zero[other])
        out.append(pd.DataFrame({"lang": lang, "g": idx[g], "h": idx[other], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "g": [], "h": [], "value": []})


def _pairs(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    langs = groups.groupBy("lang").agg(F.max("n_terms").alias("all_terms"), F.max("idx").alias("last"))
    langs = langs.select("lang", (F.lit(1) + F.floor(F.col("all_terms") / TERMS)).alias("n_buckets"),
                         F.floor(F.col("last") / BLOCK).alias("last_block"))
    bucket = F.pmod(F.xxhash64("term"), F.col("n_buckets")).alias("bucket")
    in_bucket = (kept.join(langs, "lang").select("lang", bucket).groupBy("lang", "bucket")
                 .agg(F.count(F.lit(1)).alias("n_terms")))
    buckets = (langs.select("lang", "last_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)).alias("bucket"))
               .join(in_bucket, ["lang", "bucket"], "left").na.fill(0, ["n_terms"]))
    heads = groups.select("lang", "idx", F.coalesce("p0", F.lit(1)).alias("p")).join(buckets, "lang").select(
        "lang", "bucket", "last_block", "idx", F.lit(None).cast("string").alias("term"), "p", "n_terms")
    own = groups.select("lang", "source", "idx")
    body = counts.join(own, ["lang", "source"]).join(langs, "lang").select(
        "lang", bucket, "last_block", "idx", "term", "p", F.lit(0).cast("long").alias("n_terms"))
    block = F.floor(F.col("idx") / BLOCK)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last_block")),
                         lambda b: F.struct(F.least(b, block).alias("bi"), F.greatest(b, block).alias("bj")))
    found = (heads.unionByName(body).select("lang", "bucket", "idx", "term", "p", "n_terms", F.inline(blocks))
             .groupBy("lang", "bucket", "bi", "bj").applyInPandas(_block_pairs, "lang string, g long, h long, value long")
             .groupBy("lang", "g", "h").agg(F.sum("value").alias("value")))
    both = found.select("lang", "value", F.explode(F.array(F.struct(F.col("g").alias("a"), F.col("h").alias("b")),
                                                           F.struct(F.col("h").alias("a"), F.col("g").alias("b")))).alias("s"))
    return (both.select("lang", "value", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
            .join(own.select("lang", "source", F.col("idx").alias("a")), ["lang", "a"])
            .join(own.select("lang", F.col("source").alias("item"), F.col("idx").alias("b")), ["lang", "b"])
            .select("lang", "source", "item", "value"))


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language by distance over all kept terms, farthest first.
    Part ``term``: the ``top_terms`` kept terms by which a source exceeds its language most.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kept = stage(kept_terms(texts, min_docs), "divergence-kept")
    counts = stage(_term_counts(texts, kept), "divergence-counts")

    sizes = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (texts.select("lang", "source").distinct().withColumn("idx", number.cast("long"))
              .join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "n_terms"])
              .withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"))))
    groups = stage(groups, "divergence-groups")
    shares = stage(counts.join(groups.select("lang", "source", "total", "n_terms"), ["lang", "source"])
                   .select("lang", "source", "term", "count", share(F.col("count"), F.col("total"), F.col("n_terms")).alias("p")),
                   "divergence-shares")

    in_lang = shares.groupBy("lang", "term").agg(F.sum("count").alias("all_count"))
    lang_sizes = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("n_terms").alias("n_terms"))
    usual = in_lang.join(lang_sizes, "lang").select("lang", "term", share(F.col("all_count"), F.col("all_total"), F.col("n_terms")).alias("q"))
    over = (shares.join(usual, ["lang", "term"]).where(F.col("p") > F.col("q"))
            .select("lang", "source", F.col("term").alias("item"),
                    F.expr("((p - q) * (p - q)) div (p + q)").alias("value")))

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(by))
    return (ranked(_pairs(shares, kept, groups), "pair")
            .unionByName(ranked(over, "term").where(F.col("rank") <= top_terms))
            .select("lang", "source", "part", "item", "value", "rank"))
