"""Connected components of a link table, as rounds of joins and aggregates.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
rewires links towards smaller ids without changing what is connected, and stops
when every component is a star around its smallest id. Each round is a written
table; one row (a count and an order-free checksum) tells whether it changed.
The minimum per vertex is written too, so that both sides of the join come from
an exchange and a star centre with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stage


def _rewired(both: DataFrame, larger_only: bool) -> DataFrame:
    low = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "lowest")
    joined = both.join(low, "u")
    if larger_only:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    links = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p"))
    return links.select("p.*").where(F.col("a") != F.col("b")).distinct()


def _checksum(links: DataFrame):
    return links.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``links`` (columns a, b) but the roots."""
    now = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where(F.col("a") != F.col("b")).distinct(), "links")
    mark = _checksum(now)
    while mark["n"]:
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                            F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("p"))
        large = stage(_rewired(both.select("p.*"), True), "large-star")
        now = stage(_rewired(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "small-star")
        last, mark = mark, _checksum(now)
        if tuple(last) == tuple(mark):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
