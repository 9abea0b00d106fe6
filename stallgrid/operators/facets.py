"""Facet counts that leave out their own selection, for all requests in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.functions.text import normalize_query
from stallgrid.operators.index import facet_pairs

# Facets of a shop that has configured none (source, label, display, position, enabled).
DEFAULT_FACETS = (
    ("price", "Price", "range", 0, True), ("productType", "Product type", "checkbox", 1, True), ("vendor", "Brand", "checkbox", 2, True),
    ("option:Color", "Color", "swatch", 3, True), ("option:Size", "Size", "list", 4, True), ("tag", "Tag", "checkbox", 5, False),
    ("availability", "Availability", "checkbox", 6, False), ("collection", "Collection", "checkbox", 7, False),
)


def counts_for(source: Column) -> Column:
    """A row counts for a facet if it fails no predicate but that facet's own."""
    return (F.size("failed") == 0) | ((F.size("failed") == 1) & (F.col("failed")[0] == source))


def value_facets(rows: DataFrame, top: int = 50) -> DataFrame:
    """query_id, source, value, count, position of every facet value of every request.

    Rows that fail two predicates count nowhere and are dropped before anything is exploded; one failing one
    predicate is exploded for that source only.
    """
    live = rows.where(F.size("failed") <= 1)
    pairs = F.filter(facet_pairs(rows), lambda p: (F.size("failed") == 0) | (F.col("failed")[0] == p["source"]))
    counted = live.select("query_id", F.explode(pairs).alias("x")).groupBy("query_id", "x.source", "x.value").agg(F.count("*").alias("count"))
    first = F.when(F.col("source") == "availability", F.when(F.col("value") == "in_stock", 1).otherwise(0)).otherwise(F.col("count"))
    return counted.withColumn("position", F.row_number().over(W.partitionBy("query_id", "source").orderBy(F.desc(first), "value"))).where(F.col("position") <= top)


def price_facet(rows: DataFrame) -> DataFrame:
    """query_id, min, max of the price range, not narrowed by the request's own bounds."""
    return rows.where(counts_for(F.lit("price"))).groupBy("query_id").agg(F.min("price_min").alias("min"), F.max("price_max").alias("max")).where("min IS NOT NULL")


def labelled(facets: DataFrame, queries: DataFrame, config: DataFrame | None = None, collections: DataFrame | None = None, swatches: DataFrame | None = None) -> DataFrame:
    """Facets of the enabled sources with labels, in their configured order; collections show titles, values swatches."""
    spark = facets.sparkSession
    defaults = spark.createDataFrame(DEFAULT_FACETS, "source string, label string, display_as string, facet_no int, enabled boolean")
    shops = queries.select("query_id", "shop_id")
    if config is None:
        conf = shops.select("shop_id").distinct().join(F.broadcast(defaults))
    else:
        own = config.select("shop_id", "source", "label", "display_as", "facet_no", "enabled")
        conf = own.unionByName(shops.select("shop_id").distinct().join(own, "shop_id", "left_anti").join(F.broadcast(defaults)))
    out = facets.join(shops, "query_id").join(conf.where("enabled"), ["shop_id", "source"]).withColumn("value_label", F.col("value"))
    if collections is not None:
        titles = collections.select("shop_id", F.col("handle").alias("value"), F.col("title").alias("_title"))
        out = out.join(titles, ["shop_id", "value"], "left").withColumn("value_label", F.when(F.col("source") == "collection", F.coalesce("_title", "value")).otherwise(F.col("value"))).drop("_title")
    if swatches is not None:
        out = out.withColumn("_low", F.lower("value")).join(swatches.select("shop_id", F.lower("name").alias("_low"), "swatch"), ["shop_id", "_low"], "left").drop("_low")
    return out


def facet_signature(queries: DataFrame) -> DataFrame:
    """``queries`` with a signature of all that facets depend on: requests that differ in page or sort share one."""
    filters = F.array_sort(F.transform(F.map_entries(F.coalesce("filters", F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(e["key"], F.array_sort(e["value"]))))
    return queries.withColumn("signature", F.sha2(F.to_json(F.struct("shop_id", normalize_query(F.col("term")).alias("t"), filters.alias("f"), "price_min", "price_max", "collection", "include_unavailable", "bucket", "typo_tolerance")), 256))


def distinct_signatures(queries: DataFrame) -> DataFrame:
    """One request per signature, under the signature as its query_id; facets of these are joined back by it."""
    return facet_signature(queries).dropDuplicates(["signature"]).withColumn("query_id", F.col("signature"))
