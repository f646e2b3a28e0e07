"""Report tables written by the executors (one folder per report), never via the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_reports(tables: dict[str, DataFrame], out_dir: str, *, fmt: str = "parquet",
                  parallel: int = 4) -> dict[str, str]:
    """Write each report to ``out_dir/<name>``; returns name -> path.

    Reports are independent jobs, submitted from up to ``parallel`` driver
    threads so that small ones do not wait for each other.
    """
    def one(name: str, df: DataFrame) -> tuple[str, str]:
        path = f"{out_dir.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(path)
        return name, path

    if parallel <= 1 or len(tables) <= 1:
        return dict(one(n, df) for n, df in tables.items())
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return dict(f.result() for f in [pool.submit(one, n, df) for n, df in tables.items()])


def read_reports(spark: SparkSession, paths: dict[str, str], *, fmt: str = "parquet",
                 schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """The written tables; ``schemas`` gives the types of a format that does not store them."""
    out = {}
    for name, path in paths.items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true")
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        out[name] = reader.load(path)
    return out


def report_manifest(spark: SparkSession, paths: dict[str, str], *, fmt: str = "parquet") -> DataFrame:
    """(report, rows) read back from the written folders."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows")
              for name, df in read_reports(spark, paths, fmt=fmt).items()]
    return reduce(DataFrame.unionByName, frames)
