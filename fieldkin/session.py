"""Session settings for local runs.

A cluster brings its own session; nothing in the package depends on these.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, app: str = "fieldkin") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_directory(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one temporary folder, as its checkpoint
    folder; a cluster has to name one, since a folder of one machine would not
    survive its loss.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldkin-"))
    return context.getCheckpointDir()


def keep(data: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back, cutting its lineage.

    For results that several queries start from, such as value counts: they are
    then computed once, and lost executors do not cost them.
    """
    spark = data.sparkSession
    path = f"{shared_directory(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    data.write.parquet(path)
    return spark.read.schema(data.schema).parquet(path)
