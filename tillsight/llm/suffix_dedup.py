"""Removal of byte strings that repeat, by distributed prefix doubling on sampled suffixes.

Every byte inside a string of ``length`` bytes that also starts anywhere else is removed. Sorting all
positions by doubling would move several times 16 bytes for each byte of text, so only content-chosen
positions take part; the result is the same as with all of them:

1. The anchor of a string of ``length`` bytes is its (leftmost) smallest 32-byte hash: equal strings
   have equal anchors at equal places. Strings that start side by side and share an anchor form a run, about
   one for 185 bytes. A run's first rank is the hash of the 32 bytes at its anchor.
2. Doubling: Spark regroups runs by (rank, bytes up to the next offset: 64, 128, 256), drops those that
   became unique, and leaves alone those whose strings all need fewer bytes right of the anchor.
3. Runs of one rank whose whole span is equal are repeated as a whole. Where one rank stands for different
   spans, one span of each kind is cut out, and all its strings are compared (hash with rank, 128 bits) in
   buckets of bounded size; ranks with more than ``MAX_KINDS`` kinds of span (a passage in very many
   documents) are compared string by string in an aggregate instead. Both ways are exact.
4. The repeated strings of a document give the bytes to remove.

Strings never cross documents and are judged on the input. Two hashes of id and text name a row, so rows
equal in both get equal results (and repeat each other).

Defined results: null counts as empty; texts shorter than ``length`` keep all bytes; a repeat inside one
document counts, overlapping or not; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import bound_batches, stage

GRAM = 32
OFFSETS = (64, 128, 256)
BLOCK = 1 << 18                       # bytes worked on at once, whatever the length of a text
POSITION_BITS = np.uint64(20)
MAX_KINDS = 1000
BUCKET_KINDS = 2000
_BASE = 0x9E3779B97F4A7C15
_FULL = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prints:
    """Hash of any span of a buffer in constant time: prefix sums of byte value times power, mod 2 ** 64."""

    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def __init__(self, size: int):
        powers = np.full(size + 1, _BASE, np.uint64)
        inverse = np.full(size + 1, pow(_BASE, -1, _FULL), np.uint64)
        powers[0] = inverse[0] = 1
        self.powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)

    def load(self, buffer: np.ndarray) -> None:
        if len(buffer) >= len(self.powers):
            self.__init__(2 * len(buffer))
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.BYTES[buffer] * self.powers[:len(buffer)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        """Of every span of that size."""
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:size + n] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    low = x
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[width - step:width - step + n])


def find_runs(buffer: np.ndarray, ends: np.ndarray, length: int, prints: Prints) -> dict[str, np.ndarray]:
    """Runs of the documents that lie one after another in ``buffer`` (``ends``: where each ends)."""
    prints.load(buffer)
    grams = prints.all(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(((grams >> POSITION_BITS) << POSITION_BITS) | place, length - GRAM + 1)
    anchor = (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    whole = np.arange(len(anchor)) + length <= ends[doc] if len(anchor) else np.empty(0, bool)
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (anchor[1:] == anchor[:-1]))
    start = np.flatnonzero(first)
    number = np.cumsum(first)[whole] - 1
    count = np.bincount(number, minlength=len(start)).astype(np.int64) if len(start) else np.empty(0, np.int64)
    at, owner = anchor[start], doc[start]
    out = {"doc": owner, "start": start, "count": count, "need": length - (at - start),
           "rank": grams[at], "span": mix(prints(start, count + length - 1) + count.astype(np.uint64))}
    for offset in OFFSETS:
        fits = at + offset <= ends[owner]
        out[f"rank{offset}"] = np.where(fits, prints(np.where(fits, at, 0), np.where(fits, offset, 0)), np.uint64(0))
    return out


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Buffers of up to ``BLOCK`` bytes: documents one after another, a long one in overlapping parts.

    Yields the buffer, the document of each part and the part's place in its document.
    """
    parts, owner, place, size = [], [], [], 0
    for k, raw in enumerate(texts):
        for at in range(0, max(len(raw) - length + 1, 0), BLOCK):
            part = raw[at:at + BLOCK + length - 1]
            if size and size + len(part) > BLOCK:
                yield parts, owner, place
                parts, owner, place, size = [], [], [], 0
            parts.append(part)
            owner.append(k)
            place.append(at)
            size += len(part)
    if parts:
        yield parts, owner, place


RUNS = ("k1 long, k2 long, start long, count int, need int, rank long, span long, "
        + ", ".join(f"rank{o} long" for o in OFFSETS))


def _runs(rows: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(BLOCK + 2 * length)
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            texts = [t or b"" for t in batch.column("raw").to_pylist()]
            for parts, owner, place in _blocks(texts, length):
                ends = np.cumsum([len(p) for p in parts])
                found = find_runs(np.frombuffer(b"".join(parts), np.uint8), ends, length, prints)
                part = found["doc"]
                begin = ends - [len(p) for p in parts]
                doc = np.array(owner)[part]
                start = found["start"] - begin[part] + np.array(place)[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[doc]), pa.array(k2[doc]), pa.array(start.astype(np.int64)),
                     pa.array(found["count"].astype(np.int32)), pa.array(found["need"].astype(np.int32)),
                     *[pa.array(found[c].view(np.int64)) for c in ("rank", "span", *[f"rank{o}" for o in OFFSETS])]],
                    names=["k1", "k2", "start", "count", "need", "rank", "span", *[f"rank{o}" for o in OFFSETS]])
    return rows.select("k1", "k2", "raw").mapInArrow(work, RUNS)


def _doubled(runs: DataFrame) -> DataFrame:
    """Runs that are not unique after each doubling of the offset, as far as they need it."""
    repeated = stage(runs.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"), "ranks")
    live = stage(runs.join(repeated, "rank"), "live-runs")
    for offset in OFFSETS:
        name = f"rank{offset}"
        pairs = stage(live.groupBy("rank", name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select("rank", name, F.lit(True).alias("again")), "rank-pairs")
        live = stage(live.join(pairs, ["rank", name], "left").where(F.col("again") | (F.col("need") < offset))
                     .drop("again", name), "live-runs")
    return live


def _intervals(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last positions of the stretches of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _strings(kinds: pd.DataFrame, length: int, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every string of ``length`` bytes in the spans."""
    sizes = kinds["bytes"].map(len).to_numpy()
    prints.load(np.frombuffer(b"".join(kinds["bytes"]), np.uint8))
    n = sizes - length + 1
    row = np.repeat(np.arange(len(kinds)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return row, prints((np.cumsum(sizes) - sizes)[row] + inside, length)


KIND_RESULT = "rank long, span long, firsts array<int>, lasts array<int>"


def _few_kinds(kinds: DataFrame, length: int) -> DataFrame:
    """Repeated strings of each kind of span, compared in buckets of whole ranks."""
    buckets = max(1, kinds.count() // BUCKET_KINDS)

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        row, code = _strings(bucket, length, Prints(int(bucket["bytes"].map(len).sum()) + 1))
        rank, times = bucket["rank"].to_numpy()[row], bucket["n"].to_numpy()[row]
        order = np.lexsort((code, rank))
        new = np.ones(len(order), bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (rank[order][1:] != rank[order][:-1])
        total = np.bincount(np.cumsum(new) - 1, weights=times[order])
        again = np.zeros(len(order), bool)
        again[order] = total[np.cumsum(new) - 1] > 1
        edges = np.flatnonzero(np.diff(row)) + 1
        found = [_intervals(m) for m in np.split(again, edges)]
        return pd.DataFrame({"rank": bucket["rank"], "span": bucket["span"],
                             "firsts": [f[0] for f in found], "lasts": [f[1] for f in found]})

    return kinds.withColumn("bucket", F.pmod("rank", F.lit(buckets))).groupBy("bucket").applyInPandas(
        compare, KIND_RESULT)


def _many_kinds(kinds: DataFrame, length: int) -> DataFrame:
    """The same for ranks with very many kinds: strings are counted one by one in an aggregate."""
    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Prints(BLOCK)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                row, code = _strings(part, length, prints)
                inside = np.arange(len(row)) - np.searchsorted(row, row)
                yield pd.DataFrame({"rank": part["rank"].to_numpy()[row], "span": part["span"].to_numpy()[row],
                                    "n": part["n"].to_numpy()[row], "place": inside.astype(np.int32),
                                    "code": code.view(np.int64)})

    strings = stage(kinds.select("rank", "span", "n", "bytes").mapInPandas(
        spell, "rank long, span long, n long, place int, code long"), "strings")
    again = stage(strings.groupBy("rank", "code").agg(F.sum("n").alias("times")).where("times > 1")
                  .select("rank", "code"), "repeated-strings")
    # a kind has at most ``length`` strings, so its list is bounded
    return (strings.join(again, ["rank", "code"]).groupBy("rank", "span")
            .agg(F.array_sort(F.collect_set("place")).alias("firsts")).select("rank", "span", "firsts",
                                                                              F.col("firsts").alias("lasts")))


def _repeated(rows: DataFrame, length: int) -> DataFrame:
    """Text and repeated strings (first and last starts) of every row that has some: k1, k2, raw, firsts, lasts."""
    runs = stage(_runs(rows, length), "runs")
    live = _doubled(runs)
    shape = stage(live.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("a"), F.max("span").alias("b"))
                  .where("n > 1").select("rank", (F.col("a") == F.col("b")).alias("alike")), "rank-shapes")
    live = stage(live.join(shape, "rank").select("k1", "k2", "start", "count", "rank", "span", "alike"), "live-runs")
    kinds = stage(live.where(~F.col("alike")).groupBy("rank", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "count")).alias("one")), "kinds")
    # one text move: the rows with live runs, and in each the spans it stands for
    cuts = kinds.select(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"), F.struct(
        F.col("one.start").alias("start"), F.col("one.count").alias("count"), "rank", "span", "n").alias("cut"))
    wanted = (live.select("k1", "k2").distinct()
              .join(cuts.groupBy("k1", "k2").agg(F.collect_list("cut").alias("cuts")), ["k1", "k2"], "left"))
    texts = stage(rows.select("k1", "k2", "raw").join(wanted, ["k1", "k2"]), "texts")
    spans = stage(texts.select("raw", F.explode("cuts").alias("c")).select(
        "c.rank", "c.span", "c.n", F.expr(f"substring(raw, cast(c.start + 1 as int), c.count + {length - 1})").alias("bytes"))
        .dropDuplicates(["rank", "span"]), "spans")
    sizes = stage(spans.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MAX_KINDS)
                  .select("rank"), "large-ranks")
    few = _few_kinds(spans.join(sizes, "rank", "left_anti"), length)
    found = few if sizes.isEmpty() else few.unionByName(_many_kinds(spans.join(sizes, "rank", "left_semi"), length))
    found = stage(found.where(F.size("firsts") > 0), "kind-results")
    marks = (live.where("alike").select("k1", "k2", F.col("start").alias("first"),
                                        (F.col("start") + F.col("count") - 1).alias("last"))
             .unionByName(live.where(~F.col("alike")).join(found, ["rank", "span"])
                          .select("k1", "k2", "start", F.explode(F.arrays_zip("firsts", "lasts")).alias("p"))
                          .select("k1", "k2", (F.col("start") + F.col("p.firsts")).alias("first"),
                                  (F.col("start") + F.col("p.lasts")).alias("last"))))
    lists = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    return texts.select("k1", "k2", "raw").join(lists, ["k1", "k2"])


def cut_bytes(raw: bytes, marks: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans and what is left; ``marks``: first and last start of stretches of repeated strings."""
    spans: list[list[int]] = []
    for first, last in sorted(marks):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    edges = [0, *[e for s in spans for e in s], len(raw)]
    return [tuple(s) for s in spans], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


REMOVED = "k1 long, k2 long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"


def remove_repeats(docs: DataFrame, *, length: int = 400, text: str = "text", doc_id: str = "doc_id",
                   with_kept: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    ``spans`` are the removed byte ranges (start inclusive, end exclusive; null if none); with ``with_kept``
    the remaining bytes come along as ``kept`` (null where nothing was removed).
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    bound_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), body).alias("k1"),
                       F.xxhash64(body, F.lit("second"), F.col(doc_id)).alias("k2"), body.cast("binary").alias("raw"))
    base = stage(rows.select("doc_id", "k1", "k2", F.octet_length("raw").cast("long").alias("n_bytes"),
                             F.sha2("raw", 256).alias("whole")), "sizes")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [cut_bytes(raw, [(m["first"], m["last"]) for m in marks], length)
                     for raw, marks in zip(batch["raw"], batch["marks"])]
            yield pd.DataFrame({
                "k1": batch["k1"], "k2": batch["k2"],
                "n_removed": [len(raw) - len(kept) for raw, (_, kept) in zip(batch["raw"], found)],
                "kept_sha256": [hashlib.sha256(kept).hexdigest() for _, kept in found],
                "spans": [[{"start": a, "end": b} for a, b in spans] for spans, _ in found],
                "kept": [kept if with_kept else None for _, kept in found]})

    removed = stage(_repeated(rows.where(F.octet_length("raw") >= length), length).mapInPandas(cut, REMOVED)
                    .dropDuplicates(["k1", "k2"]), "removed")
    out = base.join(removed, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "spans", "kept")
    return out if with_kept else out.drop("kept")
