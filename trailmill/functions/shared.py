"""Tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a folder of our own only where none is set and Spark runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):  # executors elsewhere wouldn't see the folder
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-trailmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, outlives executors."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`df` as a written table and its number of rows, seen as it is written."""
    count = Observation()
    out = written(df.observe(count, F.count(F.lit(1)).alias("n")), name)
    return out, count.get["n"]
