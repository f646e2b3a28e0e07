"""Session helpers.

``build_session`` is what tests and ``bench.py`` use; a cluster job gets its
session from the launcher and only needs ``checkpoint_dir`` / ``staging_path``,
which read the shared folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # concurrent report branches share the executors instead of queueing the
    # forecast's long chain of tiny jobs behind large report tasks (measured:
    # whole job 27 s instead of 30 s at sf0.1)
    "spark.scheduler.mode": "FAIR",
    # delete reliable checkpoint files once their DataFrame is unreachable
    # (the graph loops write one per step)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "tillsight",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session, set on the context if it is not yet.

    Taken from the running context or ``spark.checkpoint.dir``. Where neither names one, a folder in
    the warehouse (``spark.sql.warehouse.dir``) is used: like the tables there it is seen by the driver
    and all executors. Never a machine-local temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        warnings.warn(f"spark.checkpoint.dir is not set: checkpoints and staged tables go to {configured}, "
                      "which the driver and all executors must share", RuntimeWarning, stacklevel=2)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint; the folder is set first, so any entry point may call it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/tillsight-staging/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete ``path`` through Hadoop's FileSystem API (any shared store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))
