"""Command line: run the whole report job on a sales CSV.

    python -m tillsight --csv data/sales.csv --out out/run-1
    spark-submit --conf spark.checkpoint.dir=hdfs:///tmp/ckpt -m tillsight ...   (or a wrapper script)

Uses the session the launcher configures (``getOrCreate``); only when no
master is configured does it fall back to ``local[*]``. Prints one JSON line
with the written paths.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession

from tillsight.plans import ReportParams, run_report
from tillsight.session import DEFAULT_CONF
from tillsight.sources import read_sales_csv


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tillsight", description=__doc__.splitlines()[0])
    ap.add_argument("--csv", required=True, help="sales CSV file or folder (header row)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    for f in dataclasses.fields(ReportParams):
        if f.name == "promo_cuts":
            ap.add_argument("--promo-cuts", type=float, nargs=3, default=None)
            continue
        kind = type(f.default) if f.default is not None else str
        if f.name == "edge_min_weight":
            kind = str
        ap.add_argument("--" + f.name.replace("_", "-"), type=kind, default=None)
    ap.add_argument("--parallel", type=int, default=4, help="concurrent branches")
    return ap


def main(argv: list[str] | None = None) -> dict:
    args = _parser().parse_args(argv)
    builder = SparkSession.builder.appName("tillsight")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    overrides = {}
    for f in dataclasses.fields(ReportParams):
        v = getattr(args, f.name, None)
        if v is None:
            continue
        if f.name == "edge_min_weight" and v != "mean":
            v = float(v)
        if f.name == "promo_cuts":
            v = tuple(v)
        overrides[f.name] = v
    params = ReportParams(**overrides)
    paths = run_report(spark, read_sales_csv(spark, args.csv), args.out, params, parallel=args.parallel)
    print(json.dumps(paths))
    return paths


if __name__ == "__main__":
    main()
