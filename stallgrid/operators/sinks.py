"""Sinks: CSV reports that spreadsheets cannot take for formulas, and the structured product feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallgrid.functions.text import csv_safe


def safe_cells(df: DataFrame) -> DataFrame:
    return df.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """One file with one header; every cell quoted, quotes doubled, lines ended by CR LF.

    For reports, which people open: their rows are bounded by the top-k of what they list.
    """
    safe_cells(df).coalesce(1).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def analytics_sections(top: DataFrame, zero: DataFrame, unclicked: DataFrame) -> DataFrame:
    """The three term lists as one table: section, shop_id, rank, term, searches."""
    part = lambda name, df: df.select(F.lit(name).alias("section"), "shop_id", F.col("rank").cast("int").alias("rank"), "term", "searches")
    return part("top", top).unionByName(part("zero results", zero)).unionByName(part("no clicks", unclicked))


def feed_records(hits: DataFrame, shops: DataFrame) -> DataFrame:
    """One JSON record per hit, typed as a product with an offer; positions run on over pages."""
    rows = hits.join(shops.select("shop_id", "domain", "currency_code"), "shop_id", "left")
    offer = F.struct(F.lit("Offer").alias("@type"), F.format_string("%.2f", "price_min").alias("price"), F.col("currency_code").alias("priceCurrency"), F.concat(F.lit("https://schema.org/"), F.when(F.col("available"), "InStock").otherwise("OutOfStock")).alias("availability"))
    item = F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), F.concat(F.lit("https://"), "domain", F.lit("/products/"), "product_id").alias("url"), F.struct(F.lit("Brand").alias("@type"), F.col("vendor").alias("name")).alias("brand"), offer.alias("offers"))
    return rows.select("query_id", "rank", F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("rank").alias("position"), item.alias("item"))).alias("record"))
