"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of keys that a task gets at most, on average: numbers of partitions follow the rows, whatever the session sets.
ROWS_A_TASK = 1 << 20
#: Used only where the session names no shared folder and all runs in one process (tests, local runs).
LOCAL_SHARED = "/tmp/checkpoints/rillflow"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever folder they start in."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or of its context; an error where a cluster names none."""
    key, context = "spark.checkpoint.dir", spark.sparkContext
    if found := spark.conf.get(key, None) or context.getConf().get(key):
        return found.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return LOCAL_SHARED
    raise ValueError(f"set {key} to a folder that all executors share")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once, written to a new table in the shared folder and read back."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(rows: DataFrame) -> int:
    """Into how many partitions rows of a table go; their number is read from the files' footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def spread(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """df in n partitions by the hash of columns. Sizes of shuffled keys say little (runs of them shrink a hundredfold), so AQE is not to merge these."""
    return df.repartition(n, *columns)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
