"""Rows that are written once and read many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from the folder of spark.checkpoint.dir, which all executors share; the plan behind them is cut.

    Only a local session may leave the folder unset.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote; nothing happens if it is not there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
