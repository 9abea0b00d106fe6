"""Catalog sources: flat export lines, change payloads, and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallgrid.functions.text import gid_id, strip_html

MONEY = "struct<amount:string,currencyCode:string>"
EXPORT_LINE = (
    "id string, handle string, title string, descriptionHtml string, vendor string, productType string, tags array<string>, status string, publishedAt string, "
    f"priceRangeV2 struct<minVariantPrice:{MONEY},maxVariantPrice:{MONEY}>, sku string, price string, availableForSale boolean, "
    "selectedOptions array<struct<name:string,value:string>>, namespace string, key string, value string, type string, __parentId string"
)
PAYLOAD = (
    "id string, handle string, title string, body_html string, vendor string, product_type string, tags string, status string, published_at string, updated_at string, "
    "options array<struct<name:string>>, images array<struct<src:string,alt:string>>, variants array<struct<id:string,title:string,sku:string,price:string,"
    "option1:string,option2:string,option3:string,inventory_quantity:int,inventory_management:string,inventory_policy:string>>"
)
# Metafield types whose values can be filtered by.
METAFIELD_TYPES = (
    "single_line_text_field", "multi_line_text_field", "number_integer", "number_decimal", "boolean", "color", "rating", "dimension", "weight", "volume",
)
MAX_METAFIELDS, MAX_VALUE, MAX_SKUS, MAX_VARIANT_TEXT = 50, 200, 200, 2000
OPTIONS = "map<string,array<string>>"


def read_export(spark: SparkSession, path: str, shop_id: str) -> DataFrame:
    """Lines of one shop's export file; see ``parse_export``."""
    return parse_export(spark.read.text(path).select(F.lit(shop_id).alias("shop_id"), "value"))


#: Shops whose files a task holds open at once; lines of more shops are sorted by shop first.
OPEN_FILES = 256


def write_export(lines: DataFrame, folder: str) -> None:
    """Lines (shop_id, value) as text files in a folder for each shop.

    A task keeps a file open for each of its shops, so that its lines are written as they come and not sorted by shop.
    """
    conf, name = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_FILES)
    try:
        lines.write.partitionBy("shop_id").text(folder)
    finally:
        conf.set(name, before)


def parse_export(lines: DataFrame) -> DataFrame:
    """shop_id, kind (product, variant, metafield, collection), parent, and the line's fields.

    Lines that are no JSON object, and lines of no known kind, are skipped. Order does not matter.
    """
    # As rows of a generator, so that a line is parsed once: filters on fields would be pushed below a plain projection, each with a parse of its own.
    x = lines.select("shop_id", F.inline(F.array(F.from_json("value", EXPORT_LINE))))
    parent = F.col("__parentId").isNotNull()
    kind = (
        F.when(parent & F.col("id").contains("/ProductVariant/"), "variant").when(parent & (F.col("id").contains("/Metafield/") | F.col("key").isNotNull()), "metafield")
        .when(parent & (F.col("id").contains("/Collection/") | F.col("handle").isNotNull()), "collection").when(~parent & F.col("id").contains("/Product/"), "product")
    )
    return x.withColumns({"kind": kind, "parent": F.coalesce("__parentId", "id")}).where("kind IS NOT NULL").drop("__parentId")


def regroup_export(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products with their children, rejected children without a product): one shuffle by parent for each.

    Rejected children are counted only, so their lines travel as partial counts and no list of them is built.
    """
    kind = lambda k, c: F.collect_list(F.when(F.col("kind") == k, c))
    g = lines.groupBy("shop_id", "parent").agg(
        F.max_by(F.struct("id", "handle", "title", "descriptionHtml", "vendor", "productType", "tags", "status", "priceRangeV2"), F.when(F.col("kind") == "product", F.col("id"))).alias("p"),
        F.sort_array(kind("variant", F.struct(F.col("id").alias("id"), "title", "sku", "price", F.col("availableForSale").alias("available"), "selectedOptions"))).alias("variants"),
        F.sort_array(kind("metafield", F.struct("key", "namespace", "value", "type"))).alias("metafields"),
        F.sort_array(F.array_distinct(kind("collection", F.col("handle")))).alias("collections"),
    )
    n = lambda k: F.count(F.when(F.col("kind") == k, True))
    # Equal handles count once: handles are counted by themselves first.
    handle = F.when(F.col("kind") == "collection", F.col("handle"))
    per = lines.groupBy("shop_id", "parent", handle.alias("_handle")).agg(n("product").alias("_products"), n("variant").alias("variants"), n("metafield").alias("metafields"))
    counts = per.groupBy("shop_id", "parent").agg(F.sum("_products").alias("_products"), *[F.sum(c).cast("int").alias(c) for c in ("variants", "metafields")], F.count("_handle").cast("int").alias("collections"))
    return g.where("p IS NOT NULL"), counts.where("_products = 0").drop("_products")


def options_from_variants(variants: Column) -> Column:
    """Option name -> its sorted distinct values; blanks and the default title are left out."""
    pairs = F.filter(F.flatten(F.transform(variants, lambda v: F.coalesce(v["selectedOptions"], F.array().cast("array<struct<name:string,value:string>>")))), lambda o: (F.trim(o["name"]) != "") & (F.trim(o["value"]) != "") & (F.lower(o["value"]) != "default title"))
    names = F.array_distinct(F.transform(pairs, lambda o: o["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda o: o["name"] == n), lambda o: o["value"]))))))


def variant_skus(variants: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(variants, lambda v: F.trim(v["sku"])), lambda s: s != "")), 1, MAX_SKUS)


def variant_text(variants: Column) -> Column:
    titles = F.array_distinct(F.filter(F.transform(variants, lambda v: F.trim(v["title"])), lambda t: (t != "") & (F.lower(t) != "default title")))
    return F.left(F.array_join(titles, " "), F.lit(MAX_VARIANT_TEXT))


def flatten_metafields(m: Column) -> Column:
    """namespace.key and bare key -> value; of equal qualified keys the last stays, of equal bare keys the first.

    A named type must be on the list; a metafield without a type is kept. Long lists and values are cut.
    """
    typed = lambda x: (F.coalesce(x["type"], F.lit("")) == "") | x["type"].isin(*METAFIELD_TYPES)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    good = F.slice(F.filter(m, lambda x: typed(x) & filled(x["value"]) & filled(x["key"])), 1, MAX_METAFIELDS)
    entry = lambda k, x: F.struct(k.alias("k"), F.left(x["value"], F.lit(MAX_VALUE)).alias("v"))
    whole = F.transform(good, lambda x: entry(F.concat_ws(".", F.coalesce(x["namespace"], F.lit("custom")), x["key"]), x))
    bare = F.transform(good, lambda x: entry(x["key"], x))
    every = F.concat(F.reverse(whole), bare)
    keys = F.array_distinct(F.transform(every, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(every, lambda e: e["k"] == k)[0]["v"])))


def normalize_export(groups: DataFrame) -> DataFrame:
    """Product rows from regrouped export lines."""
    amount = lambda which, alt: F.coalesce(F.try_to_number(F.col(f"p.priceRangeV2.{which}.amount"), F.lit("999999999999.999999")).cast("double"), alt)
    prices = F.filter(F.transform("variants", lambda v: v["price"].try_cast("double")), lambda x: x >= 0)
    return groups.select(
        "shop_id", gid_id(F.col("p.id")).alias("product_id"), F.col("p.handle").alias("handle"), F.coalesce("p.title", F.lit("")).alias("title"), strip_html(F.col("p.descriptionHtml")).alias("description"),
        F.col("p.vendor").alias("vendor"), F.col("p.productType").alias("product_type"), F.coalesce(F.array_compact("p.tags"), F.array().cast("array<string>")).alias("tags"),
        F.upper(F.coalesce("p.status", F.lit("ACTIVE"))).alias("status"), F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))).alias("available"), F.lit(True).alias("published_online"),
        amount("minVariantPrice", F.array_min(prices)).alias("price_min"), amount("maxVariantPrice", F.array_max(prices)).alias("price_max"), F.col("p.priceRangeV2.minVariantPrice.currencyCode").alias("currency_code"),
        options_from_variants(F.col("variants")).alias("options"), "collections", flatten_metafields(F.col("metafields")).alias("metafields"), variant_skus(F.col("variants")).alias("skus"), variant_text(F.col("variants")).alias("variant_text"),
        F.transform("variants", lambda v: F.struct(gid_id(v["id"]).alias("variant_id"), v["title"].alias("title"), v["sku"].alias("sku"), v["price"].try_cast("double").alias("price"), v["available"].alias("available"))).alias("variants"),
    )


def normalize_payload(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Product rows from change payloads (shop_id, value: JSON), with columns to ``keep``; payloads without an id are dropped."""
    x = rows.select("shop_id", *keep, F.from_json("value", PAYLOAD).alias("x"), F.get_json_object("value", "$.tags").alias("raw_tags")).where("x.id IS NOT NULL").select("shop_id", *keep, "raw_tags", "x.*")
    as_list = F.from_json("raw_tags", "array<string>")
    tags = F.when(F.ltrim("raw_tags").startswith("["), as_list).otherwise(F.split(F.coalesce("raw_tags", F.lit("")), ","))
    empty = F.array().cast("array<struct<name:string,value:string>>")
    names = F.transform(F.coalesce("options", F.array().cast("array<struct<name:string>>")), lambda o: o["name"])
    vs = F.coalesce("variants", F.array().cast(PAYLOAD.split("variants ")[1]))
    sold = lambda v: (v["inventory_policy"] == "continue") | (v["inventory_quantity"] > 0) | v["inventory_management"].isNull()
    pairs = lambda v: F.filter(F.zip_with(names, F.array(v["option1"], v["option2"], v["option3"]), lambda n, o: F.struct(n.alias("name"), o.alias("value"))), lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    x = x.withColumn("vs", F.transform(vs, lambda v: F.struct(v["id"].alias("id"), v["title"].alias("title"), v["sku"].alias("sku"), v["price"].alias("price"), F.coalesce(sold(v), F.lit(False)).alias("available"), F.coalesce(pairs(v), empty).alias("selectedOptions"))))
    prices = F.filter(F.transform("vs", lambda v: v["price"].try_cast("double")), lambda p: p >= 0)
    return x.select(
        "shop_id", *keep, gid_id(F.col("id")).alias("product_id"), "handle", F.coalesce("title", F.lit("")).alias("title"), strip_html(F.col("body_html")).alias("description"), "vendor", "product_type",
        F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "").alias("tags"), F.upper(F.coalesce("status", F.lit("ACTIVE"))).alias("status"),
        F.exists("vs", lambda v: v["available"]).alias("available"), F.col("published_at").isNotNull().alias("published_online"), F.array_min(prices).alias("price_min"), F.array_max(prices).alias("price_max"),
        options_from_variants(F.col("vs")).alias("options"), variant_skus(F.col("vs")).alias("skus"), variant_text(F.col("vs")).alias("variant_text"),
        F.to_timestamp("published_at").alias("published_at"), F.to_timestamp("updated_at").alias("updated_at"),
        F.transform("vs", lambda v: F.struct(gid_id(v["id"]).alias("variant_id"), v["title"].alias("title"), v["sku"].alias("sku"), v["price"].try_cast("double").alias("price"), v["available"].alias("available"))).alias("variants"),
    )


# Sorts that a request may name.
SORTS = ("relevance", "price_asc", "price_desc", "title_asc", "title_desc", "newest", "bestselling")


def parse_query_log(rows: DataFrame, url: str = "url") -> DataFrame:
    """Typed requests from logged URLs: term, page, per_page, sort, filters, price bounds; bad values fall back."""
    query = F.split(F.coalesce(F.expr(f"try_parse_url(`{url}`, 'QUERY')"), F.lit("")), "&")
    text = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(F.filter(query, lambda p: p != ""), lambda p: F.struct(text(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), text(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")))
    rows = rows.withColumn("_pairs", pairs)
    one = lambda name: F.get(F.filter("_pairs", lambda p: p["k"] == name), F.lit(0))["v"]
    whole = lambda name, low, high, default: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(one(name).try_cast("int"), F.lit(default))))
    chosen = F.filter("_pairs", lambda p: p["k"].startswith("f.") & (F.length(p["k"]) > 2) & (p["v"] != ""))
    sources = F.slice(F.array_distinct(F.transform(chosen, lambda p: F.substr(p["k"], F.lit(3)))), 1, 20)
    filters = F.map_from_entries(F.transform(sources, lambda s: F.struct(s, F.slice(F.transform(F.filter(chosen, lambda p: F.substr(p["k"], F.lit(3)) == s), lambda p: F.left(p["v"], F.lit(200))), 1, 30))))
    sort = F.when(one("sort").isin(*SORTS), one("sort")).otherwise("relevance")
    return rows.withColumns({
        "term": F.left(F.trim(F.coalesce(one("q"), one("term"), F.lit(""))), F.lit(200)), "page": whole("page", 1, 200, 1), "per_page": whole("perPage", 1, 48, 24), "sort": sort,
        "filters": filters, "price_min": one("minPrice").try_cast("double"), "price_max": one("maxPrice").try_cast("double"),
    }).drop("_pairs")


def new_searches(requests: DataFrame) -> DataFrame:
    """Requests that begin a search: first page, default sort, no price, no filters."""
    return requests.where((F.col("page") == 1) & (F.col("sort") == "relevance") & F.col("price_min").isNull() & F.col("price_max").isNull() & (F.size("filters") == 0))
