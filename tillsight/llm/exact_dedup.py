"""Exact de-duplication by content-defined chunk recipes (DataFrame functions only).

1. The text without white space is cut into chunks at places its own content
   defines (after sentence marks, between ``MIN_CHUNK`` and ``MAX_CHUNK``
   characters), so equal texts always get equal chunks.
2. Chunks are de-duplicated by bytes (digest and chunk are the grouping keys,
   with a map-side step: a passage in every document leaves each task once).
   A digest that stands for two different chunks is found there; the rows that
   hold such a digest get a further number for each of those places. So an
   identifier is verified: equal identifiers mean equal bytes.
3. Texts are equal when their ordered identifier lists (recipes) are equal. Only
   these short lists are grouped and joined; a whole text is never moved again.

Defined results: null counts as the empty text; texts without any character but
white space are equal to each other; of equal texts the one with most code
points, then the smallest doc_id (null last), then the first stored row stays;
repeated rows are copies of each other; an empty table gives an empty result.
Input columns named like the ones made here are hidden behind prefixed names and
come back unchanged (``drop_copies``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import scratch, stage

MIN_CHUNK, MAX_CHUNK = 256, 4096
BLANKS = r"[\x20\x09-\x0D]+"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?;:。]|.{{1,{MAX_CHUNK}}}"


def chunked(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
            digest_bits: int = 64) -> DataFrame:
    """One row per document: id, stored row number, code points, SHA-256, chunks and their digests.

    ``digest_bits`` below 64 makes digests collide (for tests). ``carry=["row"]`` keeps the
    row numbers that the input has.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.length(body).alias("n_points"),
        F.regexp_replace(body, BLANKS, "").alias("plain"),
        (F.col("row") if carry else F.monotonically_increasing_id()).alias("row"))
    cut = plain.select("*", F.expr(f"regexp_extract_all(plain, r'{CHUNK}', 0)").alias("chunks"))
    return cut.select(
        "doc_id", "n_points", "row",
        F.sha2(F.col("plain"), 256).alias("text_sha256"), "chunks",
        F.expr(f"transform(chunks, c -> shiftrightunsigned(xxhash64(c), {64 - digest_bits}))").alias("recipe"))


def chunk_store(rows: DataFrame) -> DataFrame:
    """Every distinct chunk once: ``digest``, ``chunk`` and the number of places it stands in."""
    return (rows.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("p"))
            .groupBy(F.col("p.recipe").alias("digest"), F.col("p.chunks").alias("chunk"))
            .agg(F.count(F.lit(1)).alias("places")))


def _verified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``marks``: per place the chunk's number within its digest, empty if all are 0."""
    shared = stage(chunk_store(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("digest"), "shared-digests")
    if shared.isEmpty():
        return rows.withColumn("marks", F.expr("cast(array() as array<int>)"))
    places = (rows.select("row", F.posexplode(F.arrays_zip("recipe", "chunks")).alias("at", "p"))
              .select("row", "at", F.col("p.recipe").alias("digest"), F.col("p.chunks").alias("chunk"))
              .join(shared, "digest", "left_semi"))
    numbered = (places.select("digest", "chunk").distinct()
                .withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")) - 1))
    marks = (places.join(numbered, ["digest", "chunk"]).where("number > 0")
             .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("found")))
    return (rows.join(marks, "row", "left")
            .withColumn("marks", F.when(F.col("found").isNull(), F.expr("cast(array() as array<int>)"))
                        .otherwise(F.expr("transform(recipe, (d, i) -> coalesce(found[i], 0))")))
            .drop("found"))


def _decided(rows: DataFrame) -> DataFrame:
    """Per stored row: the row and id of the copy that stays and the size of its group."""
    narrow = stage(_verified(rows).select("row", "doc_id", "n_points", "text_sha256", "recipe", "marks"),
                   "recipes")
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"),
                          F.bitwise_not("doc_id").alias("early"), F.bitwise_not("row").alias("first"),
                          "doc_id", "row"))
    groups = stage(narrow.groupBy("recipe", "marks").agg(F.count(F.lit(1)).alias("group_size"),
                                                         best.alias("best"))
                   .where("group_size > 1")
                   .select("recipe", "marks", "group_size", F.col("best.doc_id").alias("keep_id"),
                           F.col("best.row").alias("keep_row")), "copy-groups")
    return (narrow.join(groups, ["recipe", "marks"], "left")
            .select("row", "doc_id", "text_sha256",
                    F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept")))


def exact_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                 digest_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(chunked(docs, text=text, doc_id=doc_id, digest_bits=digest_bits), "chunks")
    return _decided(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    # the input is written once; its chunks are made from there and not written beside it
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                             F.monotonically_increasing_id().alias("row"),
                             F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("input")), "dedup-input")
    with scratch(docs.sparkSession):
        cut = chunked(rows, carry=["row"])
        gone = stage(_decided(cut).where(~F.col("kept")).select("row"), "dropped", keep=True)
    return (rows.join(gone, "row", "left_anti")
            .select(*[(F.col("text") if c == text else F.col(f"input.`{c}`")).alias(c) for c in docs.columns]))
