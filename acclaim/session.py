"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "acclaim", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume; every one may be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # text work is heavy per byte: keep small shuffles spread out, and read text in small splits
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.files.maxPartitionBytes": "32m",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests, a laptop) and none is named, a temporary
    folder is chosen and remembered for the rest of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    chosen = spark.conf.get("acclaim.scratch.dir", None)
    if not chosen:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        chosen = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("acclaim.scratch.dir", chosen)
    return chosen


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Several consumers then read the columns they need instead of recomputing the text
    work, and lost executors cost no lineage.  The table lies in the shared folder.
    """
    path = f"{scratch_folder(df.sparkSession)}/acclaim/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
