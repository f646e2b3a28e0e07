"""Sharding by a k-d tree over document metadata.

Units (groups of equal texts, which stay together) are points with one coordinate
per metadata dimension and their bytes as weight. From one node on, every node over the
target bytes is split along its widest dimension (spread over the range
of the whole table) at the weighted median, or, where it is due an odd number of shards, at the
matching weighted quantile. All nodes of a level are split together. The target is given
(``target_bytes``) or follows from a number of shards.

A weighted quantile is found without sorting: keys (coordinate, then a hash of the
text, so that many equal coordinates can still be cut) are summed per node in
``BUCKETS`` buckets, the bucket of the cut is looked into again, and after
``ROUNDS`` rounds it is a single key. The driver holds one split a node, at most
as many as there are shards; tasks get them as a small table joined by node, so the plan of a level is the
same for 8 shards and for 10,000. A node is named by its first shard.

Law ``bytes``: sizes are near equal, up to the size of one unit a split. A unit that fills a shard by
itself (at least the bytes left over the shards left, largest first) gets one of its own before the tree
is built, and a node's children get the numbers of shards that suit the bytes on each side of the cut.

Defined results: a null text counts 0 bytes plus 1 and equals the empty text; very long texts are read whole,
by their size and hashes; null coordinates count as 0; repeated rows go to the same shard with slots of their own;
columns of the input with the names used here or in the result do no harm (only those named are read); an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import drop_staged, scratch, stage

BUCKET_BITS, ROUNDS = 13, 4
KEY_BITS = BUCKET_BITS * ROUNDS
COORDINATE_BITS = 20
SLOT_ROWS = 20_000


def metadata_axes() -> dict[str, Column]:
    """The default dimensions: length (doubling), source, language and id."""
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    return {"length": F.log2(F.col("size")), "source": code("source"), "lang": code("lang"),
            "id": F.col("doc_id").cast("double")}


def _units(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per distinct text: bytes, and per dimension a key: coordinate bits, then hash bits."""
    units = rows.groupBy("text_id").agg(F.sum("size").alias("bytes"),
                                        *[F.min(n).alias(n) for n in names])
    ranges = rows.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    top = (1 << COORDINATE_BITS) - 1
    low_bits = KEY_BITS - COORDINATE_BITS
    tie = F.shiftrightunsigned(F.xxhash64("text_id"), 64 - low_bits)
    keys = []
    for n in names:
        lo, hi = ranges[f"lo_{n}"], ranges[f"hi_{n}"]
        scale = top / (hi - lo) if lo is not None and hi > lo else 0.0
        place = F.floor((F.col(n) - F.lit(float(lo or 0))) * F.lit(scale)).cast("long")
        keys.append((F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(top), place)), low_bits).bitwiseOR(tie)).alias(n))
    return units.select("text_id", "bytes", *keys)


def _filling(units: DataFrame, shards: int) -> list[bytes]:
    """Texts of the units that fill a shard by themselves, largest first (fewer than ``shards``)."""
    left, open_, out = units.agg(F.sum("bytes")).first()[0] or 0, shards, []
    for r in units.orderBy(F.col("bytes").desc(), "text_id").limit(shards - 1).collect():   # fewer rows than shards
        if r["bytes"] * open_ < left:
            break
        out.append(bytes(r["text_id"]))
        left, open_ = left - r["bytes"], open_ - 1
    return out


def _left_shards(left: int, right: int, n: int) -> int:
    """How many of a node's ``n`` shards go left, so that the larger mean size is smallest (ties: nearest n // 2)."""
    return min(range(1, n), key=lambda k: (max(left / k, right / (n - k)), abs(k - n // 2), k))


def _table(units: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """One row a node for a map-side join: at most as many as there are shards."""
    return F.broadcast(units.sparkSession.createDataFrame(rows, schema))


def _cuts(units: DataFrame, nodes: dict[int, int], names: list[str]) -> dict[int, tuple[int, int, int]]:
    """Per open node (node -> number of shards): widest dimension, last key and shards to the left."""
    spread = units.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[
        (F.max(n) - F.min(n)).alias(n) for n in names]).collect()               # one row a node
    axis = {r["node"]: max(range(len(names)), key=lambda i: r[names[i]]) for r in spread}
    goal = {r["node"]: r["bytes"] * (nodes[r["node"]] // 2) / nodes[r["node"]] for r in spread}
    if not axis:
        return {}
    total, left = {r["node"]: r["bytes"] for r in spread}, dict.fromkeys(axis, 0)
    keyed = (units.join(_table(units, list(axis.items()), "node int, axis int"), "node")
             .select("node", "bytes", F.get(F.array(*names), F.col("axis")).alias("key")))
    found = {node: 0 for node in axis}                                          # leading bits of the cut so far
    for step in range(1, ROUNDS + 1):
        shift = KEY_BITS - BUCKET_BITS * step
        state = _table(units, [(n, found[n], float(goal[n])) for n in axis], "node int, prefix long, lacking double")
        sums = (keyed.withColumn("bucket", F.shiftright("key", shift)).join(state, "node")
                .where(F.shiftright("bucket", BUCKET_BITS) == F.col("prefix"))
                .groupBy("node", "lacking", "bucket").agg(F.sum("bytes").alias("bytes")))
        up_to = Window.partitionBy("node").orderBy("bucket")
        # the first bucket that reaches the goal; the last one if none does
        reached = (sums.withColumn("end", F.sum("bytes").over(up_to))
                   .groupBy("node").agg(
                       F.min(F.when(F.col("end") >= F.col("lacking"), F.struct("bucket", "end", "bytes"))).alias("first"),
                       F.max(F.struct("bucket", "end", "bytes")).alias("last")).collect())   # one row a node
        for r in reached:
            hit = r["first"] or r["last"]
            found[r["node"]] = hit["bucket"]
            goal[r["node"]] -= hit["end"] - hit["bytes"]
            left[r["node"]] += hit["end"] - hit["bytes"]
            if step == ROUNDS and goal[r["node"]] * 2 < hit["bytes"]:
                found[r["node"]] -= 1                                           # less than half of it fits left
            elif step == ROUNDS:
                left[r["node"]] += hit["bytes"]
    return {n: (axis[n], found[n], _left_shards(left[n], total[n] - left[n], nodes[n])) for n in axis}


def shards_for(rows: DataFrame, target_bytes: int) -> int:
    """The fewest shards that hold the bytes of ``rows`` at ``target_bytes`` each (at least one)."""
    return max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))


def assign_shards(rows: DataFrame, shards: int, names: list[str]) -> DataFrame:
    """``text_id``, ``shard`` for every distinct text of ``rows`` (text_id, size and the dimensions)."""
    bare = stage(_units(rows, names), "units")
    filling = _filling(bare, shards) if shards > 1 else []
    own = _table(bare, [(bytearray(t), k) for k, t in enumerate(filling)], "text_id binary, own int")
    units = stage(bare.join(own, "text_id", "left").select(
        *bare.columns, F.coalesce("own", F.lit(len(filling))).alias("node")), "units")
    drop_staged(bare)
    nodes = {len(filling): shards - len(filling)}                               # open nodes: shards due to them
    while nodes := {k: n for k, n in nodes.items() if n > 1}:
        cuts = _cuts(units.join(_table(units, [(k,) for k in nodes], "node int"), "node"), nodes, names)
        nodes = {child: n for k, (_, _, part) in cuts.items()
                 for child, n in ((k, part), (k + part, nodes[k] - part))}
        split = _table(units, [(k, *cut) for k, cut in cuts.items()], "node int, axis int, last long, part int")
        beyond = F.get(F.array(*names), F.col("axis")) > F.col("last")
        moved = units.join(split, "node", "left").select(
            "text_id", "bytes", *names, F.when(beyond, F.col("node") + F.col("part")).otherwise(F.col("node")).alias("node"))
        before, units = units, stage(moved, "units")
        drop_staged(before)
    return units.select("text_id", F.col("node").alias("shard"))


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """``slot``: a gapless number from 0 in each shard. Bins of about ``SLOT_ROWS`` rows are numbered apart."""
    bins = max(64, n_rows // SLOT_ROWS)
    dealt = stage(rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "row"), F.lit(bins))), "dealt", keep=True)
    starts = (dealt.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n"))
              .select("shard", "bin", "start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "row"))
    return (dealt.withColumn("inside", inside).join(starts, ["shard", "bin"])
            .withColumn("slot", F.col("start") + F.col("inside") - 1))


def shard_documents(docs: DataFrame, *, shards: int = 8, target_bytes: int | None = None,
                    axes: dict[str, Column] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``target_bytes``: nodes are split until a leaf is due no more than that (it may exceed it by one unit);
    without it there are ``shards`` leaves. ``axes``: dimension name -> numeric column over the input columns and ``size``.
    """
    axes = metadata_axes() if axes is None else axes
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.withColumn("size", (F.octet_length(raw) + 1).cast("long"))
    names = [f"axis_{i}" for i in range(len(axes))]
    with scratch(docs.sparkSession):
        rows = stage(sized.select(
            F.col(doc_id).alias("doc_id"), "size", F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text_id"),
            F.monotonically_increasing_id().alias("row"),
            *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, axes.values())]), "shard-rows")
        if target_bytes is not None:
            shards = shards_for(rows, target_bytes)
        owner = stage(assign_shards(rows, shards, names), "shard-owners")
        placed = rows.select("row", "doc_id", "size", "text_crc32", "text_id").join(owner, "text_id")
        return numbered(placed.drop("text_id"), rows.count()).select("doc_id", "size", "text_crc32", "shard", "slot")
