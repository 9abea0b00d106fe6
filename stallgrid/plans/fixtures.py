"""Catalog, variants, facet values and actions as views over the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; without it only a local session has one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.local.dir', '/tmp')}/stallgrid-shared"


class Tables:
    """The tables of one folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def products(self) -> DataFrame:
        """One row per part; tags, collections, options and metafields as arrays and maps."""
        part, k = self.read("part"), F.col("p_partkey")
        sales = self.read("lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("popularity"), F.max("l_shipdate").alias("published_at"))
        docs = self.read("documents").select("doc_id", F.col("text").alias("description"), "lang")
        first = F.split_part("p_name", F.lit(" "), F.lit(1))
        second = F.split_part("p_name", F.lit(" "), F.lit(2))
        colour = F.when(first.isin("red", "blue", "green"), F.array(first))
        options = F.map_filter(F.create_map(F.lit("Size"), F.array(F.col("p_size").cast("string")), F.lit("Color"), colour), lambda n, v: v.isNotNull())
        material = F.when(k % 2 == 0, F.create_map(F.lit("material"), F.concat(F.lit("m"), (k % 6).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
        return (
            part.join(sales, k == F.col("l_partkey"), "left")
            .join(docs, k == F.col("doc_id"), "left")
            .select(
                F.concat(F.lit("shop"), (k % 4).cast("string")).alias("shop_id"), k.cast("string").alias("product_id"), F.col("p_name").alias("title"),
                F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_type"), F.when(k % 29 == 0, "DRAFT").otherwise("ACTIVE").alias("status"),
                (k % 31 != 0).alias("published_online"), (k % 7 != 0).alias("available"), F.col("p_retailprice").alias("price_min"),
                (F.col("p_retailprice") + (k % 3) * 10.0).alias("price_max"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), "published_at",
                F.coalesce("description", F.lit("")).alias("description"), F.coalesce("lang", F.lit("simple")).alias("lang"),
                F.array(first, second).alias("tags"), F.array(F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string"))).alias("collections"),
                options.alias("options"), material.alias("metafields"), F.array(F.concat(F.lit("SKU"), k.cast("string"))).alias("skus"),
            )
        )

    def variants(self) -> DataFrame:
        l = self.read("lineitem")  # noqa: E741
        return l.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)) == 1).alias("available")).select(
            F.concat(F.lit("shop"), (F.col("l_partkey") % 4).cast("string")).alias("shop_id"), F.col("l_partkey").cast("string").alias("product_id"),
            F.concat_ws("-", "l_partkey", "l_suppkey").alias("variant_id"), F.concat(F.lit("SKU"), F.concat_ws("-", "l_partkey", "l_suppkey")).alias("sku"), "price", "available",
        )

    def actions(self) -> DataFrame:
        """Searches, clicks, carts and purchases; times in UTC."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.when(F.col("event_type").isin("view", "error"), "search").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "add_to_cart").otherwise("purchase")
        term = F.element_at(F.array(*map(F.lit, ("red widget", "hot bolt", "small ring", "blue plat"))), (k % 4 + 1).cast("int"))
        return self.read("events").select(
            "event_id", F.concat(F.lit("shop"), (F.col("user_id") % 4).cast("string")).alias("shop_id"), F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("session_token"),
            F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(F.col("event_type") == "error", 0).otherwise(1 + (k % 20).cast("int")).alias("results_count"),
            term.alias("term"), k.cast("string").alias("product_id"), F.concat(F.lit("o"), (F.col("event_id") - F.col("event_id") % 2).cast("string")).alias("order_id"), F.col("value").alias("revenue"),
        )


#: The same views for DuckDB, to stand in front of an oracle query.
_V = {
    "v_products": """v_products AS (
  SELECT 'shop' || (p_partkey % 4) AS shop_id, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, p_brand AS vendor, p_type AS product_type,
         CASE WHEN p_partkey % 29 = 0 THEN 'DRAFT' ELSE 'ACTIVE' END AS status, p_partkey % 31 <> 0 AS published_online, p_partkey % 7 <> 0 AS available,
         p_retailprice AS price_min, p_retailprice + (p_partkey % 3) * 10.0::DOUBLE AS price_max, CAST(coalesce(l.n, 0) AS DOUBLE) AS popularity, l.last_ship AS published_at,
         coalesce(d.text, '') AS description, coalesce(d.lang, 'simple') AS lang, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS tags,
         'c' || (p_size % 5) AS collection, CAST(p_size AS VARCHAR) AS opt_size, CASE WHEN split_part(p_name, ' ', 1) IN ('red','blue','green') THEN split_part(p_name, ' ', 1) END AS opt_color,
         CASE WHEN p_partkey % 2 = 0 THEN 'm' || (p_partkey % 6) END AS material, 'SKU' || p_partkey AS sku
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p_partkey
  LEFT JOIN documents d ON d.doc_id = p_partkey)""",
    "v_variants": """v_variants AS (
  SELECT 'shop' || (l_partkey % 4) AS shop_id, CAST(l_partkey AS VARCHAR) AS product_id, l_partkey || '-' || l_suppkey AS variant_id, 'SKU' || l_partkey || '-' || l_suppkey AS sku,
         min(l_extendedprice / l_quantity) AS price, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 AS available FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "v_actions": """v_actions AS (
  SELECT event_id, 'shop' || (user_id % 4) AS shop_id, 'st' || user_id AS session_token, ts,
         CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'search' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'add_to_cart' ELSE 'purchase' END AS kind,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(k % 20 AS INT) END AS results_count,
         CASE CAST(k % 4 AS INT) WHEN 0 THEN 'red widget' WHEN 1 THEN 'hot bolt' WHEN 2 THEN 'small ring' ELSE 'blue plat' END AS term,
         CAST(k AS VARCHAR) AS product_id, 'o' || (event_id - event_id % 2) AS order_id, value AS revenue
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` (beginning with further CTEs or SELECT) behind the named views."""
    body = sql.strip()
    views = ",\n".join(_V[n] for n in names)
    return f"WITH {views}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
