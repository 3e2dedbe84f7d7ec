"""Stage tables: what a stage made, written once and read by all that follow.

A table under ``<folder>/<stage>/run=<run>`` can be read again by a later run,
so any stage can be repeated alone; the newest run is the one of the greatest
name (run names sort by time).
"""

from __future__ import annotations

import functools
import tempfile
import uuid
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder(application: str) -> str:
    """A local session's own folder, one for each application."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.  Only a local
    session without one gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def new_run() -> str:
    """A run's name: the time, and a part that keeps two runs of one instant apart."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:6]


class Stages:
    """The stage tables of one run."""

    def __init__(self, spark: SparkSession, folder: str | None = None, run: str | None = None) -> None:
        self.spark, self.run = spark, run or new_run()
        self.folder = (folder or f"{shared_folder(spark)}/stages").rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}/run={self.run}"

    def keep(self, stage: str, df: DataFrame) -> DataFrame:
        """``df``, written down: what made it runs once, however many read it."""
        df.write.mode("errorifexists").parquet(self.path(stage))
        return self.spark.read.schema(df.schema).parquet(self.path(stage))


def log_stage(df: DataFrame, folder: str, stage: str, run: str | None = None) -> str | None:
    """Write ``df`` as a JSON log of a stage; its path, or None with a warning
    where it cannot be written (a log that fails stops no run)."""
    path = f"{folder.rstrip('/')}/{stage}/run={run or new_run()}"
    try:
        df.write.mode("errorifexists").json(path)
    except Exception as e:  # storage errors are of any type
        warnings.warn(f"stage log {path}: {e}", stacklevel=2)
        return None
    return path


def latest(spark: SparkSession, folder: str, stage: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """The newest run of a stage, without its ``run`` column."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, run string")
    every = reader.format(kind).option("basePath", f"{folder}/{stage}").load(f"{folder}/{stage}")
    newest = every.agg(F.max(F.col("run").cast("string")).alias("run")).first()["run"]
    return every.where(F.col("run").cast("string") == newest).drop("run")
