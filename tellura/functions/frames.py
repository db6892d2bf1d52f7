"""Helpers on DataFrames: small tables, literals, and tables written to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("site", "meas", "chan")
SAMPLES = "site string, meas string, level int, chan string, sample long, value double"
#: Rows of a driver-made table up to which it is broadcast.
BROADCAST_ROWS = 100_000

_own: dict[str, str] = {}


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` of ``n_rows`` rows, broadcast if that is few."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def double_array(values: object) -> Column:
    """An array literal of doubles."""
    return F.lit(np.asarray(values, np.float64))


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="tellura-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
