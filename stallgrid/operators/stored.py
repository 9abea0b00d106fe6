"""A stored index: postings, titles, title grams, SKUs and facet values in files that requests read in part.

Each table is cut by ``part`` (a hash of the shop) and ``bucket`` (a hash of the word), a fixed number of folders
whatever the number of shops, and sorted by shop and word inside, so that a join with requests reads the folders of
their shops and words only (partition pruning at run time) and skips row groups in these.

A batch of changes becomes a segment: the rows of the changed products, and the list of products that it touched.
What an older segment has of a touched product no longer counts. Grams belong to distinct titles; a segment adds those
of titles that are new. ``compact_index`` writes all that counts as one segment and removes the older ones. A
segment is written under its number, so a batch that is repeated replaces itself; it counts once its line in the log
is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallgrid.operators.index import BUCKETS, PARTS, Index, build_postings, facet_values, placed, product_titles, sku_postings, title_grams, title_stretches
from stallgrid.operators.scratch import remove, written
from stallgrid.operators.search import eligible

#: Table -> the column that its buckets are made of.
KEYS = {"postings": "token", "titles": "folded_title", "stretches": "gram", "grams": "gram", "skus": "sku_lower", "facets": "source"}
_OF_PRODUCTS = ("postings", "titles", "skus", "facets")
#: Touched products that are broadcast to the tables that they are taken out of; more go by a shuffle.
SMALL = 500_000
_LOG = "number int, base boolean, touched bigint"


def _segments(spark: SparkSession, folder: str) -> list:
    """The log's lines from the last whole index on, one a segment."""
    lines = spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/log").orderBy("number").collect()  # bounded: a line a batch since the last compaction
    first = max(i for i, x in enumerate(lines) if x.base)
    return lines[first:]


def _write(df: DataFrame, folder: str, table: str, number: int) -> None:
    # Rebalanced: a part and bucket with many rows is cut into several files.
    rows = placed(df, KEYS[table]).hint("rebalance", "part", "bucket").sortWithinPartitions("part", "bucket", "shop_id", KEYS[table])
    rows.write.mode("overwrite").partitionBy("part", "bucket").parquet(f"{folder}/{table}/number={number}")


def _log(spark: SparkSession, folder: str, number: int, base: bool, touched: int) -> None:
    spark.createDataFrame([(number, base, touched)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/number={number}")


def write_index(products: DataFrame, folder: str, stems: DataFrame | None = None, number: int = 0) -> None:
    """The whole index of ``products`` as the first segment; every table is made of them, so they are written once."""
    shown = written(eligible(products))
    titles = product_titles(shown)
    made = {"postings": build_postings(shown, stems), "titles": titles, "stretches": title_stretches(titles), "grams": title_grams(titles), "skus": sku_postings(shown), "facets": facet_values(shown)}
    for table, df in made.items():
        _write(df, folder, table, number)
    _log(products.sparkSession, folder, number, True, 0)


def _stored(spark: SparkSession, folder: str, table: str, numbers: list[int]) -> DataFrame:
    """All rows of a table's segments; a segment without rows of a table has no folder that counts."""
    rows = spark.read.option("basePath", f"{folder}/{table}").parquet(*[f"{folder}/{table}/number={n}" for n in numbers])
    return rows


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the index as its segments leave them, with the columns part and bucket."""
    lines = _segments(spark, folder)
    numbers = [x.number for x in lines]
    out = {table: _stored(spark, folder, table, numbers) for table in KEYS}
    later = [x for x in lines if not x.base]
    if later:
        touched = spark.read.option("basePath", f"{folder}/touched").parquet(*[f"{folder}/touched/number={x.number}" for x in later])
        last = touched.groupBy("shop_id", "product_id").agg(F.max("number").alias("_last"))
        last = F.broadcast(last) if sum(x.touched for x in later) <= SMALL else last
        for table in _OF_PRODUCTS:
            out[table] = out[table].join(last, ["shop_id", "product_id"], "left").where("_last IS NULL OR number = _last").drop("_last")
    return {table: df.drop("number") for table, df in out.items()}


def stored_index(spark: SparkSession, folder: str) -> Index:
    t = read_index(spark, folder)
    return Index(t["postings"], t["titles"], t["stretches"], t["grams"], t["skus"])


def update_index(folder: str, number: int, changes: DataFrame, deletes: DataFrame | None = None, stems: DataFrame | None = None) -> None:
    """A batch as segment ``number``: whole rows of changed products, and shop_id, product_id of deleted ones.

    A product that is changed into one that may not be shown leaves the index. Deletes go before changes of the same
    batch.
    """
    spark = changes.sparkSession
    changes = written(changes)
    shown = eligible(changes)
    touched = changes.select("shop_id", "product_id")
    if deletes is not None:
        touched = touched.unionByName(deletes.select("shop_id", "product_id"))
        shown = shown.join(deletes.select("shop_id", "product_id"), ["shop_id", "product_id"], "left_anti")
    titles = product_titles(shown)
    numbers = [x.number for x in _segments(spark, folder) if x.number < number]
    had = _stored(spark, folder, "titles", numbers).select("part", "bucket", "shop_id", "folded_title").distinct()
    fresh = placed(titles, KEYS["titles"]).join(had, ["part", "bucket", "shop_id", "folded_title"], "left_anti").drop("part", "bucket")
    made = {"postings": build_postings(shown, stems), "titles": titles, "stretches": title_stretches(fresh), "grams": title_grams(fresh), "skus": sku_postings(shown), "facets": facet_values(shown)}
    for table, df in made.items():
        _write(df, folder, table, number)
    touched.distinct().write.mode("overwrite").parquet(f"{folder}/touched/number={number}")
    _log(spark, folder, number, False, spark.read.parquet(f"{folder}/touched/number={number}").count())


def compact_index(spark: SparkSession, folder: str, number: int) -> None:
    """All that counts as the whole index ``number``; the segments before it are removed."""
    old = _segments(spark, folder)
    tables = {t: df.drop("part", "bucket") for t, df in read_index(spark, folder).items()}
    live = tables["titles"].select("shop_id", "folded_title").distinct()
    for table in KEYS:
        df = tables[table]
        _write(df.join(live, ["shop_id", "folded_title"], "left_semi") if table in ("stretches", "grams") else df, folder, table, number)
    _log(spark, folder, number, True, 0)
    for x in old:
        for table in (*KEYS, "touched", "log"):
            remove(spark, f"{folder}/{table}/number={x.number}")
