"""Headered CSV source and sink for raw sales rows.

Columns are read as STRING. Spark binds the columns of all parts by position, so
every part's header is checked against the first one's (``enforceSchema`` off): parts
with another order or other names raise instead of swapping columns. ``read_sales_parts`` reads such parts: it groups them by
header, scans each layout on its own and unites them by name. Typing happens in ``operators.cleaning.cast_sales``, where a
malformed value becomes null instead of failing the job.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUIRED_COLUMNS = ("store_nbr", "family", "city", "date", "sales",
                    "transactions", "onpromotion")


def read_sales_csv(spark: SparkSession, path: str, *,
                   required: tuple[str, ...] = REQUIRED_COLUMNS) -> DataFrame:
    """Read one file or a folder of CSV parts. Extra columns are kept."""
    df = (spark.read.option("header", "true").option("inferSchema", "false")
          .option("mode", "PERMISSIVE").option("enforceSchema", "false").csv(path))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"sales CSV at {path} lacks columns: {', '.join(missing)}")
    return df


def part_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Part files of ``path`` (a file, a folder or a glob) by their header; empty files have none.

    Only the first line of each file is read, through Hadoop's FileSystem API (compressed parts included).
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files = []
    for found in fs.globStatus(pattern) or []:
        inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        files += [f.getPath() for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"]
    if not files:
        raise FileNotFoundError(f"no sales CSV at {path}")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(files, key=lambda f: f.toString()):
        stream, codec = fs.open(file), codecs.getCodec(file)
        try:
            raw = codec.createInputStream(stream) if codec else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw, "UTF-8")).readLine()
        finally:
            stream.close()
        if line and line.strip():
            header = tuple(next(csv.reader([line.lstrip("\ufeff")])))
            layouts.setdefault(header, []).append(file.toString())
    return layouts


def read_sales_parts(spark: SparkSession, path: str, *, required: tuple[str, ...] = REQUIRED_COLUMNS
                     ) -> tuple[DataFrame, DataFrame]:
    """Rows of parts whose headers may differ, and the lines that don't fit their header.

    The first frame holds the ``required`` columns and any further one that some part has (null in the others), one
    scan for each distinct header. The second, ``file, line, first`` (its first field), holds every line with more or fewer fields than
    its part's header, so that nothing is dropped unseen: count it, or write it beside the rows.
    """
    frames, malformed = [], []
    for header, files in part_headers(spark, path).items():
        missing = [c for c in required if c not in header]
        if missing:
            raise ValueError(f"sales CSV {files[0]} lacks columns: {', '.join(missing)}")
        bad = "_line"
        while bad in header:
            bad = "_" + bad
        schema = StructType([StructField(c, StringType()) for c in (*header, bad)])
        # all fields of a line are parsed whatever is selected: a pruned scan would not see that a line doesn't fit
        rows = (spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("columnPruning", "false")
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(files))
        # always true; reads a column of the file along, as Spark refuses scans of the corrupt lines alone
        read = F.coalesce(F.length(F.col(f"`{header[0]}`")) >= 0, F.lit(True))
        frames.append(rows.where(F.col(bad).isNull() & read).drop(bad))
        malformed.append(rows.where(F.col(bad).isNotNull() & read)
                         .select(F.col("_metadata.file_path").alias("file"), F.col(bad).alias("line"), F.col(f"`{header[0]}`").alias("first")))
    if not frames:
        raise ValueError(f"sales CSV at {path} has no header")
    rows, lines = frames[0], malformed[0]
    for more in frames[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    for more in malformed[1:]:
        lines = lines.unionByName(more)
    others = [c for c in rows.columns if c not in required]
    return rows.select(*required, *[F.col(f"`{c}`") for c in others]), lines


def write_sales_csv(df: DataFrame, path: str) -> str:
    """Write raw rows as headered CSV parts (nulls as empty fields)."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path
