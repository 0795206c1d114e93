"""A session with the settings that the plans assume."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

_local: list[str] = []


def build(name: str = "tamis", master: str | None = None, **conf: str) -> SparkSession:
    """UTC time zone, adaptive execution with skew joins, Arrow transfer; conf adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    } | conf
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    reach(spark)
    return spark


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the session was started in.

    On a cluster whose executors don't see that path, send the package along with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a local master gets a temporary
    one, which goes when the process ends; a cluster, whose executors wouldn't see it, gets an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tamis-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]
