"""Reports from daily partial sums that late events are merged into.

What the reports need of a day is kept in three tables: a shop's funnel by experiment arm, its terms, and its clicked
products. They hold sums and counts only, so partials of batches add up. A batch brings searches, and searches that
changed since an earlier batch counted them (a click or an order that came later) as they were before and as they are
now: the former are taken off, the latter added, on whatever day they were. Each batch writes its partials under its
number, so that a repeated batch replaces itself; the days of a report are read and added. ``compact_partials`` adds
all batches up into one.

Reports are those of operators.analytics for windows of whole days: ``as_of`` is a midnight, and the window ends
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallgrid.operators import analytics as A
from stallgrid.operators.scratch import remove, written

#: Table -> its key behind (shop_id, day).
TABLES = {"funnel": "bucket", "terms": "term", "products": "product_id"}
_LOG = "number int, base boolean"


def _days(searches: DataFrame, sign: int) -> dict[str, DataFrame]:
    """The partials of some searches, as they add (sign 1) to the tables or are taken off (-1)."""
    rows = searches.withColumn("day", F.to_date("ts"))
    found = F.col("results_count") > 0
    n = lambda c: F.sum(F.when(c, sign).otherwise(0)).cast("bigint")
    term = F.trim("term") != ""
    funnel = rows.groupBy("shop_id", "day", "bucket").agg(
        n(F.lit(True)).alias("searches"), n(F.col("clicked")).alias("clicks"), n(F.col("converted")).alias("conversions"), n(F.col("purchased")).alias("purchases"),
        F.sum(F.when(F.col("purchased"), F.col("revenue") * sign).otherwise(0.0)).alias("revenue"), n(F.col("results_count") == 0).alias("zero_results"),
    )
    terms = rows.where(term).groupBy("shop_id", "day", "term").agg(
        n(F.lit(True)).alias("searches"), n(F.col("clicked")).alias("clicks"), (F.sum("results_count") * sign).cast("bigint").alias("results"), n(F.col("results_count").isNotNull()).alias("counted"),
        n(F.col("results_count") == 0).alias("zero"), n(found).alias("found"), n(found & F.col("clicked")).alias("found_clicks"),
    )
    products = rows.where(F.col("clicked") & F.col("product_id").isNotNull()).groupBy("shop_id", "day", "product_id").agg(n(F.lit(True)).alias("clicks"))
    return {"funnel": funnel, "terms": terms, "products": products}


def _added(df: DataFrame, table: str) -> DataFrame:
    keys = ["shop_id", "day", TABLES[table]]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in (*keys, "number")])


def write_partials(folder: str, number: int, now: DataFrame, before: DataFrame | None = None) -> None:
    """Batch ``number``: searches as they are now, and those of them that were counted, as they were.

    Both are read by every table, so they are written once.
    """
    columns = ("shop_id", "ts", "bucket", "term", "results_count", "clicked", "converted", "purchased", "revenue", "product_id")
    parts = _days(written(now.select(*columns)), 1)
    off = _days(written(before.select(*columns)), -1) if before is not None else {}
    for table, df in parts.items():
        rows = _added(df.unionByName(off[table]), table) if table in off else df
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{table}/number={number}")
    _log(now.sparkSession, folder, number, number == 0)


def _log(spark: SparkSession, folder: str, number: int, base: bool) -> None:
    spark.createDataFrame([(number, base)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/number={number}")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    lines = spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/log").orderBy("number").collect()  # bounded: a line a batch since the last compaction
    return [x.number for x in lines if x.number >= max(y.number for y in lines if y.base)]


def read_partials(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table, its batches added up; a filter on ``day`` reads the folders of these days only."""
    paths = [f"{folder}/{table}/number={n}" for n in _batches(spark, folder)]
    return _added(spark.read.option("basePath", f"{folder}/{table}").parquet(*paths), table)


def compact_partials(spark: SparkSession, folder: str, number: int) -> None:
    """All batches as one, which is ``number``; the others are removed."""
    old = _batches(spark, folder)
    for table in TABLES:
        read_partials(spark, folder, table).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{table}/number={number}")
    _log(spark, folder, number, True)
    for n in old:
        for table in (*TABLES, "log"):
            remove(spark, f"{folder}/{table}/number={n}")


class Reports:
    """The reports of a folder of partials at one midnight."""

    def __init__(self, spark: SparkSession, folder: str, as_of: str):
        if not as_of.endswith("00:00:00") and len(as_of) > 10:
            raise ValueError("partials are of whole days: as_of must be a midnight")
        self.spark, self.folder, self.end = spark, folder, F.to_date(F.lit(as_of))

    def _table(self, table: str, days: int) -> DataFrame:
        return read_partials(self.spark, self.folder, table).where((F.col("day") < self.end) & (F.col("day") >= F.date_sub(self.end, days)))

    def _sums(self, df: DataFrame, keys: list[str]) -> DataFrame:
        known = [c for c in df.columns if c not in ("shop_id", "day", "period", *TABLES.values())]
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in known])

    def funnel_totals(self, days: int = 30) -> DataFrame:
        period = F.when(F.col("day") >= F.date_sub(self.end, days), "current").otherwise("previous")
        sums = self._sums(self._table("funnel", 2 * days).withColumn("period", period), ["shop_id", "period"])
        return sums.where("searches > 0").withColumn("revenue", F.round("revenue", 4)).select("shop_id", "period", "searches", "clicks", "conversions", "purchases", "revenue", "zero_results")

    def period_delta(self, days: int = 30) -> DataFrame:
        return A.period_delta(self.funnel_totals(days))

    def _terms(self, days: int) -> DataFrame:
        return self._sums(self._table("terms", days), ["shop_id", "term"]).where("searches > 0")

    def _top(self, df: DataFrame, k: int, first: Column, *columns: str) -> DataFrame:
        return A._top(df, k, first, F.asc("term")).select("shop_id", "term", *columns, "rank")

    def top_terms(self, days: int = 30, k: int = 25) -> DataFrame:
        t = self._terms(days).withColumns({"avg_results": F.round(F.col("results") / F.nullif("counted", F.lit(0)), 4), "ctr": A.rate(F.col("clicks"), F.col("searches"))})
        return self._top(t, k, F.desc("searches"), "searches", "avg_results", "clicks", "ctr")

    def zero_terms(self, days: int = 30, k: int = 25) -> DataFrame:
        return self._top(self._terms(days).where("zero > 0").withColumn("searches", F.col("zero")), k, F.desc("searches"), "searches")

    def no_click_terms(self, days: int = 30, k: int = 25, least: int = 3) -> DataFrame:
        return self._top(self._terms(days).where((F.col("found") >= least) & (F.col("found_clicks") == 0)).withColumn("searches", F.col("found")), k, F.desc("searches"), "searches")

    def top_clicked(self, products: DataFrame, days: int = 30, k: int = 15) -> DataFrame:
        sums = self._sums(self._table("products", days), ["shop_id", "product_id"]).where("clicks > 0")
        top = A._top(sums, k, F.desc("clicks"), F.asc("product_id"))
        titles = products.select("shop_id", "product_id", "title")
        return top.join(titles, ["shop_id", "product_id"], "left").withColumn("title", F.coalesce("title", F.lit("(removed product)")))

    def daily_series(self, days: int = 30) -> DataFrame:
        """Every day of the window; days without a search are 0."""
        by_day = self._sums(self._table("funnel", days), ["shop_id", "day"]).select("shop_id", "day", "searches", "clicks")
        shops = read_partials(self.spark, self.folder, "funnel").select("shop_id").distinct()
        calendar = shops.select("shop_id", F.explode(F.sequence(F.date_sub(self.end, days), F.date_sub(self.end, 1))).alias("day"))
        return calendar.join(by_day, ["shop_id", "day"], "left").na.fill(0, ["searches", "clicks"])

    def ab_arms(self, days: int = 30, least: int = 20) -> DataFrame:
        arms = self._sums(self._table("funnel", days).where(F.coalesce(F.trim("bucket"), F.lit("")) != ""), ["shop_id", "bucket"]).where("searches > 0").withColumn("revenue", F.round("revenue", 4))
        return A.arm_winners(arms.select("shop_id", "bucket", "searches", "clicks", "conversions", "purchases", "revenue", "zero_results"), least)

    def activity(self, days: int = 7, k: int = 10) -> DataFrame:
        return A.with_shares(self._top(self._terms(max(1, min(days, 31))), k, F.desc("searches"), "searches"))

    def plan_window(self, days: DataFrame) -> DataFrame:
        """shop_id, days, searches, clicks: each shop's totals over the days that its plan gives it (``analytics.clamp_days``)."""
        rows = read_partials(self.spark, self.folder, "funnel").where(F.col("day") < self.end).join(days, "shop_id")
        rows = rows.where(F.col("day") >= F.date_sub(self.end, F.col("days")))
        return rows.groupBy("shop_id", "days").agg(F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"))
