"""Tables and state in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}  # by application, for local sessions that name no folder


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where it is unset, in one of the application's own in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS[app] = _LOCAL_ROOTS.get(app) or tempfile.mkdtemp(prefix="tidewater-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of a loop, survives lost executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
