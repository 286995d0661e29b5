"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the session's checkpoint folder; a new temporary one only in local mode, where all tasks see it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`written`, and how many rows that wrote, observed while it did."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def clear(spark: SparkSession) -> int:
    """Removes the tables that this process has written, once no DataFrame needs them; returns how many."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
