"""Mixing sources to target weights by Pareto order sampling.

1. Targets: each source gets a share of the mix by its weight, at most ``max_copies``
   times its own size; what is over is shared again by weight (water filling, in
   closed form over the table of sources).
2. Inside a source a document is expected ``rate * importance`` times (at most
   ``max_copies``; the rate again in closed form, over at most ``MAX_CLASS``
   importance classes a source). The whole part is taken for certain.
3. The fraction left is the inclusion probability p of one more copy. Documents of a
   source are ranked by Pareto's variable, the odds of a random number over the odds
   of p, and taken in that order while the sizes fit into what the target still lacks;
   the last place of the sample goes to the document, of those left, whose size is
   nearest to the rest (none if that does not bring the source nearer to its target).

No source is sorted as a whole: sizes are summed per source and rank bin (a partial
aggregate), which gives the bin that holds the cut; only that bin's documents are
ordered one by one. A source with a third of all rows is cut into ``bins`` like any other.

The random number is a hash of seed, id and text, so reruns and retried tasks agree.

Defined results: null text and empty text have size 0 and are never taken; a null
source is a source of its own, ordered last; rows equal in source, id and text have the
same rank, and the stored row order decides at the cut; an empty table gives an empty
result; a source of size 0 has target 0. Input columns come back unchanged (``mix_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import WORD_PATTERN, scratch, stage

MAX_CLASS = 64
ODDS_STEPS = 2 ** 40


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Importance 1..64: one more for each doubling of the size, so longer texts repeat sooner."""
    return (F.length(F.bin(size))).cast("long")


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from a hash of seed, id and text (md5: the same in any engine)."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")),
                       F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, 10), 16, 10).cast("long")
    return (number.cast("double") + F.lit(0.5)) / F.lit(float(ODDS_STEPS))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (source, source_size).

    Sources in code-point order (null last) get ``weights`` in turn. The windows run
    over the table of sources: one row a source, not the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", turn).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    open_level = ranked.withColumn("level", level)
    # the first source that its level does not fill sets the level of all the others
    stop = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole)
    return (open_level.withColumn("stop", stop)
            .select("source", "source_size",
                    F.least("cap", F.coalesce(F.col("stop") * F.col("weight"), F.col("cap"))).alias("target")))


def class_rates(classes: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """``source``, ``class``, ``expected`` copies of a document of that class (class_size: words in it)."""
    at = classes.join(targets, F.col("c_source").eqNullSafe(F.col("source")))
    high = Window.partitionBy("source").orderBy(F.col("class").desc())
    before = high.rowsBetween(Window.unboundedPreceding, -1)
    after = high.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = ((F.col("target") - F.lit(float(max_copies)) * F.coalesce(F.sum("class_size").over(before), F.lit(0)))
            / F.sum(F.col("class_size") * F.col("class")).over(after))
    open_rate = at.withColumn("rate", rate)
    stop = F.max(F.when(F.col("rate") * F.col("class") <= max_copies, F.col("rate"))).over(
        Window.partitionBy("source"))
    return (open_rate.withColumn("stop", stop)
            .select("source", "source_size", "target", "class",
                    F.least(F.lit(float(max_copies)), F.coalesce(F.col("stop") * F.col("class"),
                                                                 F.lit(float(max_copies)))).alias("expected")))


def _copies(sized: DataFrame, weights, share, max_copies, seed, bins) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies, taken; ``sized``: row, doc_id, source, size, u."""
    # importance classes keep the tables below small: at most MAX_CLASS rows a source
    classed = sized.withColumn("class", F.least(size_class(F.col("size")), F.lit(MAX_CLASS)))
    by_class = stage(classed.groupBy("source", "class").agg(F.sum("size").alias("class_size")), "class-sizes")
    targets = stage(source_targets(by_class.groupBy("source").agg(F.sum("class_size").alias("source_size")),
                                   weights, share, max_copies), "targets")
    rates = stage(class_rates(by_class.where("class_size > 0").withColumnRenamed("source", "c_source"),
                              targets, max_copies), "rates")
    # documents of size 0 have no rate: their source's row still carries the target
    rated = (classed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
             .select("d.*", "t.source_size", "t.target"))
    rated = (rated.alias("d").join(
        rates.select(F.col("source").alias("r_source"), F.col("class").alias("r_class"), "expected").alias("r"),
        F.col("d.source").eqNullSafe(F.col("r_source")) & (F.col("d.class") == F.col("r_class")), "left")
        .withColumn("expected", F.when(F.col("size") > 0, F.coalesce("expected", F.lit(0.0))).otherwise(0.0))
        .withColumn("certain", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("certain")))
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (F.col("p") / (F.lit(1.0) - F.col("p")))
    ranked = stage(rated.withColumn("q", F.when(F.col("p") > 0, odds))
                   .withColumn("bin", F.floor(F.col("q") / (F.lit(1.0) + F.col("q")) * bins))
                   .select("row", "doc_id", "source", "size", "source_size", "target", "certain", "q", "bin"), "ranked")
    # words still lacking, and the bin of the cut
    filled = ranked.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("q").isNotNull(), F.col("size"))).alias("bin_size"),
        F.sum(F.col("size") * F.col("certain")).alias("sure"), F.max("target").alias("target"))
    by_source = Window.partitionBy("source")
    up_to = by_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = stage(filled.withColumn("lacking", F.col("target") - F.sum("sure").over(by_source))
                .where("bin is not null")
                .withColumn("start", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)))
                .select(F.col("source").alias("c_source"), F.col("bin").alias("c_bin"), "start", "bin_size", "lacking"),
                "bins")
    placed = ranked.alias("d").join(
        cut, F.col("d.source").eqNullSafe(F.col("c_source")) & (F.col("d.bin") == F.col("c_bin")), "left")
    inside = (F.col("start") + F.col("bin_size")) <= F.col("lacking")
    open_bin = ~inside & (F.col("start") < F.col("lacking"))
    order = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "certain", "q"]
    placed = placed.withColumn("state", F.when(F.col("q").isNull() | ~(inside | open_bin), F.lit(0))
                               .when(inside, F.lit(1)).otherwise(F.lit(2)))
    settled = placed.where("state < 2").select(*columns, F.col("state").cast("long").alias("more"))
    at_cut = (placed.where("state = 2")
              .withColumn("reached", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
              .select(*columns, (F.col("reached") + F.col("size") <= F.col("lacking")).cast("long").alias("more")))
    sample = stage(settled.unionByName(at_cut), "sample")
    # the last place: of the documents left, the one whose size is nearest to what still lacks
    gaps = sample.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("size") * (F.col("certain") + F.col("more")))).alias("gap"))
    free = sample.where("q is not null and more = 0").select(F.col("source").alias("f_source"), "size", "q", "doc_id", "row")
    last = (free.join(gaps, F.col("f_source").eqNullSafe(F.col("source")))
            .withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where(F.col("miss") < F.col("gap"))
            .groupBy("source").agg(F.min(F.struct("miss", "q", "doc_id", "row")).alias("best"))
            .select(F.col("best.row").alias("last_row")))
    return (sample.join(last, F.col("row") == F.col("last_row"), "left")
            .withColumn("copies", F.col("certain") + F.col("more") + F.col("last_row").isNotNull().cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("last_row"))


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, seed: int, carry: bool) -> DataFrame:
    size = size_in_words(F.col(text))
    return stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"), size.alias("size"),
        uniform(seed, F.col(doc_id), F.col(text)).alias("u"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("input")] if carry else [])), "sized")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0,
        seed: int = 1, bins: int = 4096, text: str = "text", doc_id: str = "doc_id",
        source: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    sized = _sized(docs, text, doc_id, source, seed, False)
    return _copies(sized, weights, share, max_copies, seed, bins).select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
        F.col("taken").cast("long").alias("taken"))


def mix_rows(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
             max_copies: float = 2.0, seed: int = 1, bins: int = 4096, text: str = "text",
             doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    sized = _sized(docs, text, doc_id, source, seed, True)
    with scratch(docs.sparkSession):
        taken = stage(_copies(sized.drop("input"), weights, share, max_copies, seed, bins)
                      .where("copies > 0").select("row", "copies"), "taken", keep=True)
    return (sized.select("row", "input").join(taken, "row")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("input.*"))
