"""Positions in a total order, for frames of any size.

A window without partition keys gathers a whole frame in one task. Here the frame is partitioned by
ranges of the order instead, every partition is numbered on its own, and the sizes of the partitions before
it (one row a partition) are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.session import checkpointed

_LOCAL_BITS = 33            # of monotonically_increasing_id: the place within the partition


def numbered(df: DataFrame, *order: str | Column, name: str = "rn",
             keep: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame, int]:
    """``number_rows`` and the number of rows, which the partition sizes tell without another pass."""
    place, part = f"_place_{name}", f"_part_{name}"
    kept = keep(df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn(place, F.monotonically_increasing_id()))
    split = kept.withColumn(part, F.shiftright(place, _LOCAL_BITS))
    sizes = split.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).collect()     # one row a partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r[part]):
        before[r[part]], total = total, total + r["_n"]
    if not before:
        return kept.drop(place).withColumn(name, F.lit(None).cast("long")), 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), f"{part} long, _before long"))
    local = F.col(place) - F.shiftleft(part, _LOCAL_BITS)
    return (split.join(offsets, part).withColumn(name, F.col("_before") + local + 1)
            .drop(place, part, "_before")), total


def number_rows(df: DataFrame, *order: str | Column, name: str = "rn",
                keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``df`` with ``name``: 1 for the first row in ``order``, and so on, without gaps.

    ``order`` should be total; rows equal in it are numbered in any order. Nulls come first (ascending
    order's rule). ``keep`` writes the sorted rows once, so that a partition's number means the same rows in
    both uses; the default is a reliable checkpoint. Only the partition sizes are broadcast: one row
    for each partition, whatever the rows. Range partitioning samples its input, so ``df`` should be cheap to read twice.
    """
    return numbered(df, *order, name=name, keep=keep)[0]
