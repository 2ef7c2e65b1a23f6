"""Tables of a data folder, and the session settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; everything else is the cluster's to set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding as floor(x * 10^d + 0.5) / 10^d, which differs from ``round`` below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time stamp with or without zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the folder ``spark.checkpoint.dir`` and read again: worked out once, and not lost with an executor.

    Where no folder is named, a temporary one serves if the master is local (tests); a cluster must name one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-weftline-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
