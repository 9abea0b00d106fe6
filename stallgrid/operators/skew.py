"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_by_share(rows: DataFrame, table: DataFrame, keys: list[str], share: int = 200, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each value of ``keys``.

    Values of the keys that more than one in ``share`` of the rows have are fewer than ``share``: their rows of
    ``table`` alone are broadcast, and the rows that have them stay where they are. All others meet by a shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    large = counts.join(F.broadcast(total), F.col("_n") * share > F.col("_total"), "inner").select(*keys)
    large = F.broadcast(large.withColumn("_large", F.lit(True)))
    marked = rows.join(large, keys, "left")
    hot = marked.where("_large").drop("_large").join(F.broadcast(table.join(large.drop("_large"), keys, "left_semi")), keys, how)
    cold = marked.where("_large IS NULL").drop("_large").join(table, keys, how)
    return hot.unionByName(cold)


def first_rows(rows: DataFrame, k: int, keys: list[str], *order: Column, spread: str, lanes: int = 32) -> DataFrame:
    """The first ``k`` rows of each key: first those of each of ``lanes`` shares of the key's rows, then those of all."""
    lane = F.pmod(F.xxhash64(spread), F.lit(lanes))
    n = F.row_number().over(W.partitionBy(*keys, "_lane").orderBy(*order))
    some = rows.withColumn("_lane", lane).withColumn("_n", n).where(F.col("_n") <= k).drop("_lane")
    return some.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
