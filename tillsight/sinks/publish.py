"""Publication of a set of outputs: all of it, or the set before.

A run writes into a folder of its own (``<root>/sets/<id>``). Its manifest (names, relative paths, format)
comes last: written aside under a hidden name, then renamed to ``<root>/manifests/<time>-<id>.json``, one small
file that is there or not. Readers follow the newest manifest, so a run that fails, or is still writing,
changes nothing for them, and the tables they see all come from one run.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tillsight.session import delete_path
from tillsight.sinks.tables import read_reports


class NotPublished(LookupError):
    """No set has been published under this folder."""


class OutputSet:
    """The outputs of one run, unseen until ``publish``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.id = uuid.uuid4().hex[:12]
        self.folder = f"{self.root}/sets/{self.id}"

    def publish(self, paths: dict[str, str], *, fmt: str = "parquet", keep: int = 2) -> None:
        """Make ``paths`` (name -> path inside ``folder``) the set that readers see.

        The ``keep`` newest sets stay (readers may still be in the one before); older published ones are deleted,
        each manifest before its tables.
        """
        outside = [p for p in paths.values() if not p.startswith(self.folder + "/")]
        if outside:
            raise ValueError(f"not inside the set's folder {self.folder}: {outside}")
        body = {"id": self.id, "format": fmt,
                "tables": {name: p[len(self.root) + 1:] for name, p in sorted(paths.items())}}
        name = f"{time.time_ns():020d}-{self.id}.json"
        fs, path = _filesystem(self.spark, self.root)
        aside, final = path(f"{self.root}/manifests/.{name}"), path(f"{self.root}/manifests/{name}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        if not fs.rename(aside, final):
            raise OSError(f"could not publish {final.toString()}")
        for old in _manifests(self.spark, self.root)[:-max(1, keep)]:
            delete_path(self.spark, f"{self.root}/manifests/{old}")
            delete_path(self.spark, f"{self.root}/sets/{_id_of(old)}")

    def discard(self) -> None:
        """Delete what this run has written (it was never published)."""
        delete_path(self.spark, self.folder)


def published(spark: SparkSession, root: str) -> tuple[dict[str, str], str]:
    """(name -> path, format) of the newest published set; ``NotPublished`` where there is none."""
    root = root.rstrip("/")
    names = _manifests(spark, root)
    if not names:
        raise NotPublished(root)
    body = json.loads(spark.read.text(f"{root}/manifests/{names[-1]}", wholetext=True).first()[0])
    return {name: f"{root}/{p}" for name, p in body["tables"].items()}, body["format"]


def read_published(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables (all without names) of the newest published set, from one manifest."""
    paths, fmt = published(spark, root)
    return read_reports(spark, {n: paths[n] for n in names or paths if n != "model"}, fmt=fmt)


def drop_unpublished(spark: SparkSession, root: str, *, older_than_s: float) -> list[str]:
    """Delete folders of sets without a manifest, left by drivers that died; returns their ids.

    A running job's folder looks the same, so only those not modified for ``older_than_s`` seconds go.
    """
    root = root.rstrip("/")
    fs, path = _filesystem(spark, root)
    if not fs.exists(path(f"{root}/sets")):
        return []
    before = (time.time() - older_than_s) * 1000
    known = {_id_of(n) for n in _manifests(spark, root)}
    gone = [f.getPath().getName() for f in fs.listStatus(path(f"{root}/sets"))
            if f.getPath().getName() not in known and f.getModificationTime() < before]
    for name in gone:
        delete_path(spark, f"{root}/sets/{name}")
    return gone


def _id_of(manifest: str) -> str:
    return manifest.removesuffix(".json").split("-")[1]


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """File names of the manifests, oldest first (at most the few that ``publish`` keeps)."""
    fs, path = _filesystem(spark, root)
    folder = path(f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))


def _filesystem(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
