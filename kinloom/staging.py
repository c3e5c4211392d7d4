"""Writing a step's result to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves a session that
    is this machine alone; on a cluster it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the cluster shares")
        base = getattr(spark.sparkContext, "_kinloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.sparkContext._kinloom_dir = base
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: later readers don't compute it anew and a lost executor
    costs no more than its running tasks."""
    path = work_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
