"""Where iterations cut their lineage: a table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read again, so that lost executors cost nothing before it.

    Only a session whose tasks share the driver's disk gets a folder of its own where none is named.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            folder = at.get()
        elif context.master.split("[")[0] == "local":
            context.setCheckpointDir(folder := tempfile.mkdtemp(prefix="driftline-"))
        else:
            raise ValueError("spark.checkpoint.dir names no folder; it must be one that the driver and all executors share")
    path = f"{folder.rstrip('/')}/driftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
