"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors become one class (with a partial step, so a vector that very many rows share is one row).
2. A pass hashes each class to the signs of its products with ``KEY_BITS`` random directions, orders all
   classes by that bit string and compares each with the next ``window`` in order, in cosine and double
   precision. Verified pairs of all passes are united into connected components.
3. The number of passes follows from the number of classes (``n_passes``): two vectors right at the threshold share the bits
   that tell window-sized ranges apart with a known chance, and ``miss`` bounds the chance that no pass
   has them close. Closer pairs are missed less often. A bounded window is therefore no cap on links:
4. Links are counted over whole components. Members are ordered by the first pass's key and cut into cells of ``CELL``,
   cells into nodes of ``FAN``, and so on; each has a centre and a radius. From the top, two nodes whose
   caps lie within the threshold's angle are linked as a whole, two that lie beyond it have no links, and only what is
   undecided goes down, at last to products of two cells. So a dense group of any size is counted, not
   spelt out in pairs, and every pair of a component that reaches the threshold is a link.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component links with nothing; vectors of
different lengths do not link; equal vectors always link; repeated ids are rows of their own; a null id counts
as a row, but is never the smallest id of a component with other ids; an empty table gives an empty result; columns other than
id and vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import bound_batches, stage
from tillsight.llm.components import components
from tillsight.operators.ordering import number_rows

KEY_BITS = 48
PASSES_AT_ONCE = 4
SORTED_BLOCK = 2048
CELL, FAN = 256, 16
#: Rounding of angles: nodes this near to the threshold's angle count as undecided.
MARGIN = 1e-6


def n_passes(classes: int, window: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at ``threshold`` has been within a window with chance 1 - ``miss``."""
    bits = max(0, math.ceil(math.log2(max(classes, 1) / window))) if classes > window else 0
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def _directions(passes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * KEY_BITS))


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)           # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: Column) -> Column:
    """Whether a vector can link: all components present and finite, one of them not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """``classes`` with the sort keys of all passes."""
    weights = 1 << np.arange(KEY_BITS, dtype=np.int64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            out = [None] * len(batch)
            dims = batch["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in directions:
                    directions.clear()
                    directions[dim] = _directions(passes, int(dim), seed)
                bits = (_unit(batch["vec"].iloc[at]) @ directions[dim] > 0).reshape(len(at), passes, KEY_BITS)
                for i, k in zip(at, bits @ weights):
                    out[i] = k
            yield batch.assign(dim=dims.astype("int32"), keys=out)

    return classes.mapInPandas(keys, "cid long, size long, low long, vec array<double>, dim int, keys array<long>")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place connected to each of ``n`` places by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _windows(window: int, threshold: float):
    """Links among the rows of one block of the order: at most one for each row, to the first it is connected to."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        out = []
        for _, part in rows.groupby(["dim", "pass"], sort=False):
            x, cid, home = _unit(part["vec"]), part["cid"].to_numpy(), (~part["guest"]).to_numpy()
            a, b = [], []
            for lo in range(0, len(x), window):
                own = x[lo:lo + window]
                i, j = np.nonzero(own @ x[lo:lo + 2 * window].T >= threshold)
                good = (j > i) & (j - i <= window) & home[lo + i]
                a.append(i[good] + lo)
                b.append(j[good] + lo)
            root = _forest(np.concatenate(a), np.concatenate(b), len(x))
            tied = np.flatnonzero(root != np.arange(len(x)))
            out.append(pd.DataFrame({"a": cid[tied], "b": cid[root[tied]]}))
        return pd.concat(out)
    return compare


def _pass_links(keyed: DataFrame, first: int, last: int, window: int, threshold: float) -> DataFrame:
    """Connections that the passes ``first`` to ``last`` - 1 find."""
    each = keyed.select("cid", "dim", "vec", F.posexplode(F.slice("keys", first + 1, last - first)).alias("pass", "key"))
    placed = number_rows(each, "dim", "pass", "key", "cid", name="pos", keep=lambda df: stage(df, "vector-order"))
    block = F.floor((F.col("pos") - 1) / SORTED_BLOCK)
    # the first rows of a block are also guests of the block before it
    near = (F.col("pos") - 1) % SORTED_BLOCK < window
    homes = F.when(near & (block > 0), F.array(F.struct(block.alias("block"), F.lit(False).alias("guest")),
                                               F.struct((block - 1).alias("block"), F.lit(True).alias("guest")))
                   ).otherwise(F.array(F.struct(block.alias("block"), F.lit(False).alias("guest"))))
    return (placed.select("cid", "dim", "pass", "vec", "pos", F.inline(homes)).groupBy("block")
            .applyInPandas(_windows(window, threshold), "a long, b long"))


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    x = _unit(rows["vec"])
    centre, radius = _cap(x, np.zeros(len(x)))
    return pd.DataFrame({"root": rows["root"].iloc[:1], "node": rows["node"].iloc[:1], "centre": [centre], "radius": [radius],
                         "weight": [int(rows["size"].sum())], "cids": [rows["cid"].to_numpy()],
                         "sizes": [rows["size"].to_numpy()], "data": [x.tobytes()]})


def _cap(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction and angle of a cap that holds the caps given."""
    middle = centres.sum(axis=0)
    norm = np.linalg.norm(middle)
    middle = middle / norm if norm > 1e-9 else centres[0]
    angles = np.arccos(np.clip(centres @ middle, -1.0, 1.0))
    return middle, float((angles + radii).max())


def _parents(rows: pd.DataFrame) -> pd.DataFrame:
    centre, radius = _cap(np.stack(rows["centre"]), rows["radius"].to_numpy())
    return pd.DataFrame({"root": rows["root"].iloc[:1], "node": [rows["node"].iloc[0] // FAN], "centre": [centre],
                         "radius": [radius], "weight": [int(rows["weight"].sum())]})


def _products(threshold: float):
    """Rows linked to each member of two cells by the members of the other."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = np.frombuffer(r.data_a).reshape(len(r.cids_a), -1)
                y = np.frombuffer(r.data_b).reshape(len(r.cids_b), -1)
                linked = x @ y.T >= threshold
                if r.a == r.b:
                    np.fill_diagonal(linked, True)
                yield pd.DataFrame({"cid": r.cids_a, "total": linked @ np.asarray(r.sizes_a if r.a == r.b else r.sizes_b)})
                if r.a != r.b:
                    yield pd.DataFrame({"cid": r.cids_b, "total": linked.T @ np.asarray(r.sizes_a)})
    return compare


def _totals(members: DataFrame, threshold: float) -> DataFrame:
    """``cid, total``: rows linked to each member of ``members`` (root, cid, size, vec, key), its own class included."""
    placed = number_rows(members, "root", "key", "cid", name="pos", keep=lambda df: stage(df, "vector-members"))
    node = F.floor((F.col("pos") - 1) / CELL)
    cells = stage(placed.withColumn("node", node).groupBy("root", "node").applyInPandas(
        _cells, "root long, node long, centre array<double>, radius double, weight long, cids array<long>, sizes array<long>, "
                "data binary"), "vector-cells")
    levels = [cells.select("root", "node", "centre", "radius", "weight")]
    while True:
        widest = levels[-1].groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if widest <= FAN:
            break
        levels.append(stage(levels[-1].groupBy("root", F.floor(F.col("node") / FAN)).applyInPandas(
            _parents, "root long, node long, centre array<double>, radius double, weight long"), "vector-nodes"))

    def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on).where(F.col("a") <= F.col("b"))

    angle = math.acos(threshold)
    top = levels[-1]
    todo = paired(top.select("root", F.col("node").alias("a")), top.select("root", F.col("node").alias("b")), ["root"])
    credit = None                                                               # rows linked to all members of a node
    for depth in range(len(levels) - 1, -1, -1):
        caps = levels[depth]
        side = lambda n: caps.select("root", F.col("node").alias(n), F.col("centre").alias(f"c{n}"),
                                     F.col("radius").alias(f"r{n}"), F.col("weight").alias(f"w{n}"))
        dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        apart = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
        reach = F.col("ra") + F.col("rb")
        judged = stage(todo.join(side("a"), ["root", "a"]).join(side("b"), ["root", "b"])
                       .select("root", "a", "b", "wa", "wb", (apart + reach <= angle - MARGIN).alias("all"),
                               (apart - reach > angle + MARGIN).alias("none")), "vector-pairs")
        gained = (judged.where("all").select("root", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.col("wa").alias("w")))).otherwise(
            F.array(F.struct(F.col("a").alias("node"), F.col("wb").alias("w")), F.struct(F.col("b").alias("node"), F.col("wa").alias("w"))))).alias("g"))
                  .select("root", "g.node", "g.w"))
        credit = gained if credit is None else credit.unionByName(gained)
        credit = stage(credit.groupBy("root", "node").agg(F.sum("w").alias("w")), "vector-credit")
        todo = judged.where(~F.col("all") & ~F.col("none")).select("root", "a", "b")
        if depth:
            below = levels[depth - 1].select("root", "node", F.floor(F.col("node") / FAN).alias("up"))
            child = lambda n: below.select("root", F.col("up").alias(n), F.col("node").alias(f"n{n}"))
            todo = (todo.join(child("a"), ["root", "a"]).join(child("b"), ["root", "b"])
                    .select("root", F.col("na").alias("a"), F.col("nb").alias("b")).where(F.col("a") <= F.col("b")))
            credit = (below.join(credit.withColumnRenamed("node", "up"), ["root", "up"]).select("root", "node", "w"))
    held = lambda n: cells.select("root", F.col("node").alias(n), F.col("cids").alias(f"cids_{n}"),
                                  F.col("sizes").alias(f"sizes_{n}"), F.col("data").alias(f"data_{n}"))
    compared = (todo.join(held("a"), ["root", "a"]).join(held("b"), ["root", "b"])
                .mapInPandas(_products(threshold), "cid long, total long"))
    whole = (cells.select("root", "node", "cids").join(credit, ["root", "node"])
             .select(F.explode("cids").alias("cid"), F.col("w").alias("total")))
    return compared.unionByName(whole).groupBy("cid").agg(F.sum("total").alias("total"))


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                 window: int = 128, miss: float = 0.01, seed: int = 13) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: see the module's description.

    ``threshold`` cosine from which two rows are linked; ``window`` rows compared after each in a pass;
    ``miss`` chance that the passes never have a pair right at the threshold within a window.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.select("vec_id", "vec", _usable(F.col("vec")).alias("usable"),
                       F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), F.col("vec")).alias("h2"))
    classes = (rows.where("usable").groupBy("h1", "h2")
               .agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("low"), F.any_value("vec").alias("vec")))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    passes = n_passes(classes.count(), window, threshold, miss)
    keyed = stage(_keyed(classes.select("cid", "size", "low", "vec"), passes, seed), "vector-keys")

    links = None
    for first in range(0, passes, PASSES_AT_ONCE):
        found = stage(_pass_links(keyed, first, min(first + PASSES_AT_ONCE, passes), window, threshold), "vector-links")
        links = found if links is None else links.unionByName(found)
    rooted = stage(components(links), "vector-components")
    tops = rooted.select(F.col("root").alias("node"), "root").distinct()
    tied = stage(rooted.unionByName(tops), "vector-tied")
    members = keyed.join(tied.withColumnRenamed("node", "cid"), "cid").select(
        "root", "cid", "size", "low", "vec", F.col("keys")[0].alias("key"))
    members = stage(members, "vector-component-rows")
    lowest = members.groupBy("root").agg(F.min("low").alias("component_low"))
    known = (members.select("root", "cid").join(lowest, "root").join(_totals(members.drop("low"), threshold), "cid")
             .select("cid", "component_low", "total"))
    each = (classes.select("h1", "h2", "cid", "size", "low").join(known, "cid", "left")
            .select("h1", "h2", F.lit(True).alias("usable"), F.coalesce("total", "size").alias("total"),
                    F.coalesce("component_low", "low").alias("low")))
    each = stage(each, "vector-result")
    alone = F.coalesce(F.col("low"), F.col("vec_id"))
    return (rows.select("vec_id", "usable", "h1", "h2").join(each, ["h1", "h2", "usable"], "left")
            .select("vec_id", F.coalesce(F.col("total") - 1, F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"),
                    F.col("vec_id").eqNullSafe(alone).alias("kept")))
