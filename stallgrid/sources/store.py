"""Tables of all shops, stored so that reads of some shops and some days open these folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that shops are dealt to, however many there are.
PARTS = 16


def _part(c: str = "shop_id"):
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def write_store(df: DataFrame, path: str, time: str | None = None, mode: str = "overwrite") -> None:
    """``df`` cut by a hash of its shop and, with ``time``, by the day of that column; sorted by shop inside."""
    rows = df.withColumn("part", _part())
    keys = ["part"]
    if time is not None:
        rows, keys = rows.withColumn("day", F.to_date(time)), ["day", "part"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "shop_id").write.mode(mode).partitionBy(*keys).parquet(path)


def read_store(spark: SparkSession, path: str, shops: list[str] | None = None, since: str | None = None, until: str | None = None, time: str = "ts") -> DataFrame:
    """Rows of some shops, and of the times from ``since`` to ``until``, both included; each is optional."""
    rows = spark.read.parquet(path)
    if shops is not None:
        parts = [r[0] for r in spark.createDataFrame([(s,) for s in sorted(set(shops))], "shop_id string").select(_part()).distinct().collect()] if shops else []  # bounded: at most PARTS rows
        rows = rows.where(F.col("part").isin(parts) & F.col("shop_id").isin(list(shops)))
    for bound, after in ((since, True), (until, False)):
        if bound is not None:
            at, day = F.lit(bound).cast("timestamp"), F.to_date(F.lit(bound))
            rows = rows.where((F.col(time) >= at) & (F.col("day") >= day) if after else (F.col(time) <= at) & (F.col("day") <= day))
    return rows.drop("part", "day")
