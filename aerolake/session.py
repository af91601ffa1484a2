"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# One task never has to order more rows of one key than this; see operators/ordered.py.
ROWS_PER_TASK_CONF = "aerolake.maxRowsPerTask"
DEFAULT_ROWS_PER_TASK = 5_000_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Building long column expressions is several times faster without per-call stack capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "aerolake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(DEFAULT_ROWS_PER_TASK)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names, or a folder of our own in local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="aerolake-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder, in a folder for each value of ``by``, and continue from there.

    The table outlives any executor, is computed once, and tells the planner its true size, so
    that joins with it are broadcast only when it is small. Columns not used later are not read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession, *packages: str) -> None:
    """Give the executors' Python workers this package (and others beside it), once per application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    for package in ("aerolake", *packages):
        mark = f"{context.applicationId}/{package}"
        if mark in _SHIPPED:
            continue
        archive = os.path.join(tempfile.mkdtemp(prefix="aerolake-code-"), f"{package}.zip")
        with zipfile.ZipFile(archive, "w") as bundle:
            for source in sorted((root / package).rglob("*.py")):
                bundle.write(source, source.relative_to(root))
        context.addPyFile(archive)
        _SHIPPED.add(mark)
