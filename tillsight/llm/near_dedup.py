"""Near-duplicate documents by HyperMinHash sketches.

1. Per document one Python pass makes the set of word shingles and its sketch:
   ``bands * rows`` buckets, each keeping the smallest hash of its shingles as a
   16-bit register (6 bits for the count of leading zeros, 10 mantissa bits).
   Documents with equal sets form one class; only classes go on.
2. Empty buckets borrow the register of another bucket by fixed random priority
   (so short texts band like long ones), and every band of ``rows`` registers
   becomes one key. Classes that share a key are candidates: a pair of similarity
   0.8 misses all 40 bands of 5 with probability 1.2e-7.
3. Every member of a key is compared with the key's centre (the class that is first in an order
   of the key's own, so the keys of a large group have different centres). Pairs
   whose collision-corrected estimate lies 5.5 standard deviations below the threshold go; the
   others are confirmed on their full shingle sets.
4. Links give components. Only keys that still hold more than one component apart
   from their centre are compared further, in blocks inside tasks: sketches first, then the full
   sets, between different components only and each pair in the first key it shares. A task writes
   only the links that join components: no pair list of a group is ever made, and nothing is capped.

Defined results: null and empty texts have no shingles and are linked with
nothing; fewer words than a shingle make one shingle of all words; equal sets are
copies; component_id is the smallest doc_id of the component (null if all are
null); of repeated rows with that id the first stored one is kept; an empty table
gives an empty result. Input columns come back unchanged (``drop_near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import bound_batches, scratch, stage
from tillsight.llm.components import components

MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)
#: Chance that two different minima of sets of like size give the same register.
COLLISION = 2.0 ** -MANTISSA_BITS / 3
#: Estimates this many standard deviations under the threshold are not verified.
MARGIN = 5.5
#: Room for what the correction takes off an exact estimate.
SLACK = 0.01
#: Most members of a block on average, and most shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5

    @property
    def buckets(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Remembers the hash of each word; emptied when large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case (bytes.lower and bytes.split are ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(acc)


def minima(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the smallest hash and whether there is one (``hashes`` sorted)."""
    at = ((mix(hashes ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    low, full = np.zeros(buckets, np.uint64), np.zeros(buckets, bool)
    low[at[::-1]] = hashes[::-1]                  # of a repeated index the last value stays: the smallest
    full[at] = True
    return low, full


def registers(low: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and mantissa (10 bits) of each minimum; ``EMPTY`` where none is."""
    top = (low >> np.uint64(11)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)
    exponent = (top >> np.uint64(MANTISSA_BITS)).astype(np.int64) - 1023
    zeros = np.where(exponent < 0, 53, 52 - exponent)
    out = (zeros << MANTISSA_BITS | (top & np.uint64((1 << MANTISSA_BITS) - 1)).astype(np.int64)).astype(np.uint16)
    return np.where(full, out, EMPTY)


def _priorities(buckets: int) -> np.ndarray:
    return np.random.default_rng(20240229).random((buckets, buckets)).argsort(1).argsort(1).astype(np.uint16)


def densify(regs: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Empty registers of one sketch filled from the full bucket of first priority."""
    full = regs != EMPTY
    empty, have = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty) and len(have):
        regs = regs.copy()
        regs[empty] = regs[have[priority[np.ix_(empty, have)].argmin(1)]]
    return regs


def band_keys(dense: np.ndarray, params: NearParams) -> np.ndarray:
    """One 64-bit key per sketch (row) and band."""
    factors = np.random.default_rng(7).integers(1, 2**63, params.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cut = dense.reshape(len(dense), params.bands, params.rows).astype(np.uint64)
    key = (mix(cut + np.uint64(1)) * factors).sum(2, dtype=np.uint64)
    return mix(key + np.arange(params.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketcher(params: NearParams):
    @F.pandas_udf(SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, priority = WordHashes(), _priorities(params.buckets)
        for texts in batches:
            sizes, prints, lows, fulls = [], [], [], []
            for text in texts:
                found = shingle_hashes(words_of(text), params.words, hashes)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                low, full = minima(found, params.buckets)
                lows.append(low)
                fulls.append(full)
            regs = registers(np.array(lows).reshape(-1, params.buckets), np.array(fulls).reshape(-1, params.buckets))
            dense = np.array([densify(r, priority) for r in regs]).reshape(-1, params.buckets)
            keys = band_keys(dense, params).view(np.int64)
            yield pd.DataFrame({"n_shingles": sizes, "print": prints, "sketch": [r.tobytes() for r in regs],
                                "bands": [k if n else k[:0] for k, n in zip(keys, sizes)]})
    return sketch


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of sketch rows and the buckets it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    share = ((a == b) & (a != EMPTY)).sum(-1) / np.maximum(used, 1)
    return (share - COLLISION) / (1 - COLLISION), used


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, params: NearParams) -> np.ndarray:
    """Whether a link is possible; ``sizes``: the two set sizes added up.

    The buckets are a sample without replacement of the union, which has sizes / (1 + t) members at the
    threshold t: small sets fill a bucket for almost each member, and their estimate is nearly exact.
    """
    t = params.percent / 100
    guess, used = estimate(a, b)
    union = np.maximum(sizes / (1 + t), 2)
    left = np.clip((union - used) / (union - 1), 0, 1)
    return guess >= t - SLACK - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1) * left)


def _sizes_fit(a: str, b: str, params: NearParams):
    return F.lit(100) * F.least(a, b) >= F.lit(params.percent) * F.greatest(a, b)


def _estimated(pairs: DataFrame, classes: DataFrame, params: NearParams) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    @F.pandas_udf(T.BooleanType())
    def possible(x: pd.Series, y: pd.Series, sizes: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (x, y))
        return pd.Series(may_link(a, b, sizes.to_numpy(), params))
    side = lambda n: classes.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n_{n}"),
                                    F.col("sketch").alias(f"s_{n}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("n_a", "n_b", params))
            .where(possible("s_a", "s_b", F.col("n_a") + F.col("n_b"))).select("a", "b"))


def _full_sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame, params: NearParams) -> DataFrame:
    """``node``, ``set`` (sorted shingle hashes) of the classes in ``nodes``; texts move once."""
    wanted = nodes.select("node").distinct().join(classes.select("node", "print", "key"), "node")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(words_of(t), params.words, hashes) for t in batch["text"]]
            # a key may be shared by rows with other texts (repeated ids): the print decides
            same = [xxhash.xxh3_128_digest(s.tobytes()) == p for s, p in zip(sets, batch["print"])]
            yield pd.DataFrame({"node": batch["node"], "set": [s.tobytes() for s in sets]})[same]

    return stage(rows.join(wanted.select("node", "print", "key"), "key").select("node", "print", "text")
                 .mapInPandas(make, "node long, set binary").dropDuplicates(["node"]), "sets")


def alike(a: np.ndarray, b: np.ndarray, params: NearParams) -> bool:
    """Whether two full shingle sets are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= params.percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, params: NearParams) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    pairs = stage(pairs, "candidates")
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, rows, params)

    @F.pandas_udf(T.BooleanType())
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), params)
                          for a, b in zip(x, y)], dtype=bool)

    side = lambda n: sets.select(F.col("node").alias(n), F.col("set").alias(f"s_{n}"))
    return stage(pairs.join(side("a"), "a").join(side("b"), "b").where(similar("s_a", "s_b"))
                 .select("a", "b"), "near-links")


def join_components(x: pd.DataFrame, y: pd.DataFrame, at: int, params: NearParams) -> list[tuple[int, int]]:
    """Links that join components of one block with those of another (columns node, root, n_shingles, sketch, short, set).

    ``at``: the band of the key; a pair that shares an earlier band was compared there.
    """
    if x.empty or y.empty:
        return []
    a, b = (np.frombuffer(b"".join(s["sketch"]), np.uint16).reshape(len(s), -1) for s in (x, y))
    p, q = (np.stack(s["short"].to_list())[:, :at] for s in (x, y))
    yn, yk = y["n_shingles"].to_numpy(), y["node"].to_list()
    owner: dict[int, int] = {}

    def find(r: int) -> int:
        while owner.get(r, r) != r:
            r = owner[r]
        return r

    links, xr, yr = [], x["root"].to_list(), np.array(y["root"])
    for k, (node, n, own) in enumerate(zip(x["node"], x["n_shingles"], x["set"])):
        top = find(xr[k])
        to = np.flatnonzero((yr != top) & (100 * np.minimum(n, yn) >= params.percent * np.maximum(n, yn)))
        to = to[may_link(a[k], b[to], n + yn[to], params)] if len(to) else to
        to = to[~(p[k] == q[to]).any(1)] if len(to) else to
        own = np.frombuffer(own, np.uint64)
        for j in to:
            other = find(int(yr[j]))
            if other != top and alike(own, np.frombuffer(y["set"].iat[j], np.uint64), params):
                links.append((min(node, yk[j]), max(node, yk[j])))
                owner[other] = top
                yr[yr == other] = top
    return links


def _rest(members: DataFrame, roots: DataFrame, classes: DataFrame, rows: DataFrame, params: NearParams) -> DataFrame:
    """Links between different components of a band key, its centre left out.

    Members of a key are dealt into blocks of bounded number and size; each task compares one block with
    another and writes only links that join components.
    """
    others = (members.where(F.col("node") != F.col("centre"))
              .select("at", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .join(classes.select("node", "n_shingles"), "node"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)))
    open_bands = stage(others.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"),
                                                  blocks.cast("long").alias("blocks")).where("x <> y")
                       .select("band", "blocks"), "open-bands")
    if open_bands.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    others = stage(others.join(open_bands, "band"), "open-members")
    sets = _full_sets(others, classes, rows, params)
    dealt = (others.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("at", "band", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
             .join(classes.select("node", "n_shingles", "sketch", F.transform("bands", lambda b: F.hash(b)).alias("short"))
                   .join(sets, "node"), "node"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        links = join_components(block[block["left"]], block[block["right"]], int(block["at"].iloc[0]), params)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _decided(rows: DataFrame, params: NearParams) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept; ``rows``: row, doc_id, key, text."""
    bound_batches(rows.sparkSession)
    sig = stage(rows.select("row", "doc_id", "key", sketcher(params)("text").alias("s"))
                .select("row", "doc_id", "key", "s.*"), "sketches")
    classes = stage(sig.where("n_shingles > 0").groupBy("print").agg(
        F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.posexplode("bands").alias("at", "band"))
    # an order of the key's own: node xor key, which also gives the node back
    own = F.col("node").bitwiseXOR(F.col("band"))
    centres = stage(banded.groupBy("band").agg(F.min(own).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("band", F.col("low").bitwiseXOR(F.col("band")).alias("centre")), "centres")
    members = stage(banded.join(centres, "band"), "members")
    spokes = (members.where(F.col("node") != F.col("centre"))
              .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = _confirmed(_estimated(spokes, classes, params), classes, rows, params)
    roots = stage(components(links), "roots")
    more = stage(_rest(members, roots, classes, rows, params), "more-links")
    if not more.isEmpty():
        # links between the components found so far
        joined = components(more.join(roots.withColumnRenamed("root", "ra"), F.col("a") == F.col("node"), "left").drop("node")
                            .join(roots.withColumnRenamed("root", "rb"), F.col("b") == F.col("node"), "left")
                            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        joined = stage(joined, "joined-roots").select(F.col("node").alias("root"), F.col("root").alias("above"))
        above = roots.unionByName(joined.select(F.col("root").alias("node"), "root")).dropDuplicates(["node"])
        roots = stage(above.join(joined, "root", "left").select(
            "node", F.coalesce("above", "root").alias("root")), "roots")
    named = classes.select("print", "node", "best").join(roots, "node", "left").select(
        "print", "best", F.coalesce("root", "node").alias("root"))
    firsts = stage(named.groupBy("root").agg(F.min("best").alias("first")), "firsts")
    named = stage(named.select("print", "root").join(firsts, "root").select("print", "first"), "named")
    return (sig.select("row", "doc_id", "n_shingles", "print").join(named, "print", "left")
            .select("row", "doc_id", "n_shingles",
                    F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
                    .alias("component_id"),
                    F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept")))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> list:
    # the key finds a class's text again: the id, or for a null id a hash of the text
    return [F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text))).alias("key"), F.col(text).alias("text")]


def near_copies(docs: DataFrame, params: NearParams = NearParams(), *, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(*_keyed(docs, text, doc_id))
    return _decided(rows, params).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, params: NearParams = NearParams(), *, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay (one of each component), with all their columns."""
    rows = stage(docs.select(*_keyed(docs, text, doc_id),
                             F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("input")), "near-input")
    with scratch(docs.sparkSession):
        gone = stage(_decided(rows.drop("input"), params).where(~F.col("kept")).select("row"), "dropped", keep=True)
    return (rows.join(gone, "row", "left_anti")
            .select(*[(F.col("text") if c == text else F.col(f"input.`{c}`")).alias(c) for c in docs.columns]))
