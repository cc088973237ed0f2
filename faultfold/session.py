"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "faultfold", cpus: str | int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Longer generated methods are not compiled by the JVM and run many times slower.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Checkpoints go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FAULTFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a laptop) is a temporary folder
    made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="faultfold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def _work_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/faultfold/{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one run of this application; see :func:`sweep`."""
    return f"{_work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete what this application has written under :func:`work_dir`.

    For whoever has used up its results: a result is read from there only when an action asks for it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
