"""Session settings and cluster-aware helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillsift", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for.

    Only options that do not depend on the size of the cluster are set here; memory, cores and
    ``spark.sql.shuffle.partitions`` belong to whoever submits the job (AQE coalesces from there).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the cluster names; a fresh one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None or named.rstrip("/") not in current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        current = tempfile.mkdtemp(prefix="quillsift-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def settled(df: DataFrame) -> DataFrame:
    """Compute a bounded intermediate once and read it back from reliable storage afterwards.

    For results several later steps need: the work before is not repeated, a lost executor does not
    bring it back, and the plan that follows starts small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started beside it."""
    context = spark.sparkContext
    if getattr(context, "_quillsift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quillsift-"), "quillsift.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("quillsift", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._quillsift_shipped = True
