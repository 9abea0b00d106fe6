"""Registered queries of ingest, merging, plans and sinks, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallgrid.functions import text as T
from stallgrid.operators import analytics as A
from stallgrid.operators import index as X
from stallgrid.operators import merge as M
from stallgrid.operators import search as S
from stallgrid.operators import sinks
from stallgrid.plans.analytics_queries import _SEARCHES, searches
from stallgrid.plans.catalog_queries import _cat, browse_rows
from stallgrid.plans.fixtures import AS_OF, Tables, shared_folder, with_views
from stallgrid.sources import catalog as C
from stallgrid.sources.store import read_store, write_store


#: Types of the products' second metafield, one after another: those that can be filtered by, one that has no type, and others.
SPEC_TYPES = (
    "single_line_text_field", "multi_line_text_field", "number_integer", "number_decimal", "boolean", "color", "rating", "dimension", "weight", "volume",
    None, "date", "url", "json", "list.single_line_text_field",
)


def export_lines(spark, d):
    """The given catalog written as export lines: products, then children that point at them."""
    t = Tables(spark, d)
    p, v = t.products(), t.variants()
    gid = lambda kind, c: F.concat(F.lit(f"gid://store/{kind}/"), c)
    money = lambda c: F.struct(F.format_string("%.2f", c).alias("amount"), F.lit("EUR").alias("currencyCode"))
    parent = gid("Product", F.col("product_id")).alias("__parentId")
    lines = [
        p.select("shop_id", F.to_json(F.struct(gid("Product", F.col("product_id")).alias("id"), "title", F.col("vendor"), F.col("product_type").alias("productType"), "tags", "status", F.struct(money(F.col("price_min")).alias("minVariantPrice"), money(F.col("price_max")).alias("maxVariantPrice")).alias("priceRangeV2"))).alias("value")),
        v.select("shop_id", F.to_json(F.struct(gid("ProductVariant", F.col("variant_id")).alias("id"), F.lit("Default Title").alias("title"), "sku", F.format_string("%.2f", "price").alias("price"), F.col("available").alias("availableForSale"), F.array(F.struct(F.lit("Supplier").alias("name"), F.split_part("variant_id", F.lit("-"), F.lit(2)).alias("value"))).alias("selectedOptions"), parent)).alias("value")),
        p.select("shop_id", F.to_json(F.struct(gid("Collection", F.col("collections")[0]).alias("id"), F.col("collections")[0].alias("handle"), parent)).alias("value")),
        p.where(F.size("metafields") > 0).select("shop_id", F.to_json(F.struct(F.lit("custom").alias("namespace"), F.lit("material").alias("key"), F.element_at("metafields", "material").alias("value"), F.lit("single_line_text_field").alias("type"), parent)).alias("value")),
        p.select("shop_id", F.to_json(F.struct(F.lit("spec").alias("key"), F.concat(F.lit("v"), "product_id").alias("value"), F.element_at(F.array(*map(F.lit, SPEC_TYPES)), (F.col("product_id").cast("int") % len(SPEC_TYPES) + 1)).alias("type"), parent)).alias("value")),
        p.where("product_id % 100 = 0").select("shop_id", F.lit('{"id": "gid://store/Product/').alias("value")),
    ]
    return M.union(*lines)


def _roundtrip(spark, d):
    groups, _ = C.regroup_export(C.parse_export(export_lines(spark, d)))
    x = C.normalize_export(groups)
    return x.select("shop_id", "product_id", "title", "vendor", "status", "available", F.round("price_min", 2).alias("price_min"), F.round("price_max", 2).alias("price_max"), F.array_join("collections", ",").alias("collections"), F.element_at("metafields", "custom.material").alias("material"), F.element_at("metafields", "custom.spec").alias("spec"), F.size("skus").cast("bigint").alias("n_skus"), F.size(F.element_at("options", "Supplier")).cast("bigint").alias("n_options"))


def _export_files(spark, d):
    """Each shop's export written as a file of lines, and read back from it."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    C.write_export(export_lines(spark, d), folder)
    parts = [C.read_export(spark, f"{folder}/shop_id=shop{i}", f"shop{i}") for i in range(4)]
    return M.union(*parts).groupBy("shop_id", "kind").agg(F.count("*").alias("lines"))


def _rejects(spark, d):
    lines = C.parse_export(export_lines(spark, d)).where("kind <> 'product' OR id NOT LIKE '%7'")
    return C.regroup_export(lines)[1].select("shop_id", T.gid_id(F.col("parent")).alias("product_id"), F.col("variants").cast("bigint").alias("variants"))


def payloads(spark, d):
    """A change payload for every fifth product: new title, tags as a list or as text, one variant."""
    p = Tables(spark, d).products().where("product_id % 5 = 0")
    k = F.col("product_id").cast("int")
    variant = F.struct(F.col("product_id").alias("id"), F.lit("One").alias("title"), F.col("skus")[0].alias("sku"), F.format_string("%.2f", F.col("price_min") + 1).alias("price"), F.lit("L").alias("option1"), (k % 3).alias("inventory_quantity"), F.lit("store").alias("inventory_management"), F.lit("deny").alias("inventory_policy"))
    body = lambda tags: F.to_json(F.struct(k.alias("id"), F.concat("title", F.lit(" new")).alias("title"), F.lit("<p>a &amp; b</p>").alias("body_html"), F.col("vendor"), "product_type", tags.alias("tags"), F.lower("status").alias("status"), F.when(k % 35 != 0, "2024-01-30T00:00:00Z").alias("published_at"), F.lit("2024-01-30T00:00:00Z").alias("updated_at"), F.array(F.struct(F.lit("Size").alias("name"))).alias("options"), F.array(variant).alias("variants")))
    return p.select("shop_id", F.when(k % 2 == 0, body(F.array_join("tags", ", "))).otherwise(body(F.lit(None).cast("string"))).alias("value"))


def _payload_merge(spark, d):
    current = Tables(spark, d).products().withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp"))
    out = M.apply_changes(current, C.normalize_payload(payloads(spark, d)), AS_OF)
    return out.select("shop_id", "product_id", "title", "available", F.round("price_min", 2).alias("price_min"), "description", F.array_join("tags", ",").alias("tags"), F.array_join("collections", ",").alias("collections"), "popularity", F.date_format("indexed_at", "yyyy-MM-dd").alias("indexed"))


def _membership(spark, d):
    p = Tables(spark, d).products()
    members = p.where("product_id % 10 = 0").select("shop_id", "product_id", F.lit("c1").alias("handle")).unionByName(p.where("product_id % 15 = 0").select("shop_id", "product_id", F.lit("c9").alias("handle")))
    listings = p.select("shop_id").distinct().select("shop_id", F.explode(F.array(F.struct(F.lit("c1").alias("handle"), F.lit(True).alias("complete")), F.struct(F.lit("c9").alias("handle"), F.lit(False).alias("complete")))).alias("x")).select("shop_id", "x.*")
    return M.reconcile_membership(p, members, listings).select("product_id", F.array_join(F.sort_array("collections"), ",").alias("collections"))


def _shops(spark, d):
    return Tables(spark, d).products().select("shop_id").distinct()


def _remove_collections(spark, d):
    p = Tables(spark, d).products()
    c = p.select("shop_id", F.explode("collections").alias("handle")).distinct()
    out, left = M.remove_collections(p, c, c.where("handle = 'c2' OR shop_id = 'shop3' AND handle = 'c1'"))
    return out.groupBy("shop_id").agg(F.sum(F.size("collections")).alias("memberships")).join(left.groupBy("shop_id").agg(F.count("*").alias("collections")), "shop_id")


def _caps(spark, d):
    return M.cap_catalog(*_capped(spark, d)).select("shop_id", "product_id")


def _capped(spark, d):
    """The catalog in shops of very different sizes, one of each plan, one of none and one of an unknown one."""
    n = F.col("product_id").cast("int")
    shop = F.when(n % 3 == 0, "pro").when(n % 3 == 1, "free").when(n % 6 == 2, "growth").when(n % 12 == 5, "none").otherwise("odd")
    p = Tables(spark, d).products().withColumns({"shop_id": shop, "load_seq": -n})
    plans = p.select("shop_id").distinct().where("shop_id <> 'none'").withColumn("plan", F.when(F.col("shop_id") == "odd", "enterprise").otherwise(F.col("shop_id")))
    return p, plans


def _sweep(spark, d):
    p = Tables(spark, d).products().withColumn("indexed_at", F.when((F.col("product_id") % 3 == 0) & (F.col("shop_id") != "shop2"), F.lit("2024-01-30")).otherwise("2024-01-01").cast("timestamp"))
    return M.sweep_stale(p, "2024-01-15").select("product_id")


def _snapshot(spark, d):
    c = Tables(spark, d).products().select("shop_id", F.explode("collections").alias("handle")).distinct().withColumn("title", F.lit("old"))
    snap = c.where("shop_id <> 'shop1' AND handle <> 'c4'").withColumn("title", F.lit("new"))
    return M.sync_snapshot(c, snap, ["shop_id", "handle"])


def _purge(spark, d):
    t = Tables(spark, d)
    gone = M.purge_shops({"products": t.products(), "actions": t.actions()}, t.products().where("shop_id = 'shop2'"))
    return M.union(*[x.groupBy("shop_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(k)) for k, x in gone.items()])


def _plans(spark, d):
    """Every ten customers are a shop, each with a subscription named after its market segment and key."""
    c = Tables(spark, d).read("customer")
    key = F.concat(F.lit("s"), F.floor(F.col("c_custkey") / 10).cast("string"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", "Pro (Annual)").when(F.col("c_mktsegment") == "MACHINERY", "Growth plan - monthly").when(F.col("c_mktsegment") == "HOUSEHOLD", "Legacy deal").when(F.col("c_custkey") % 7 == 0, "  Custom  ").otherwise("Free Plan")
    subs = c.select(key.alias("shop_id"), name.alias("name"), F.when(F.col("c_custkey") % 3 == 0, "ACTIVE").otherwise("CANCELLED").alias("status"))
    shops = subs.select("shop_id").distinct()
    n = F.substr("shop_id", F.lit(2)).cast("int")
    return M.resolve_plans(subs, shops.withColumn("plan_override", F.when(n % 20 == 0, "growth").when(n % 20 == 1, "enterprise")))


def _languages(spark, d):
    shops = _shops(spark, d).withColumn("search_language", F.when(F.col("shop_id") == "shop1", "French").when(F.col("shop_id") == "shop2", "klingon"))
    return M.restamp_language(Tables(spark, d).products().withColumn("ts_config", F.lit("x")), shops).select("product_id", "ts_config")


def _asked(url="url"):
    """A URL with a query part, whether or not it had one."""
    plain = F.regexp_replace(url, "#.*$", "")
    return F.when(plain.contains("?"), plain).otherwise(F.concat(plain, F.lit("?z=1")))


def _query_log(spark, d):
    """The given pages' URLs as a request log, with filters and a price bound added."""
    p = Tables(spark, d).read("pages")
    url = F.concat(_asked(), F.lit("&q=red+widget%20"), F.col("page_id").cast("string"), F.lit("&f.vendor=A%26B&f.vendor=C&f.tag=x&perPage="), (F.col("page_id") % 100).cast("string"), F.lit("&minPrice=abc&maxPrice="), (F.col("page_id") % 7).cast("string"), F.lit("&sort=bad"))
    q = C.parse_query_log(p.select("page_id", url.alias("url")))
    return q.select("page_id", "term", "page", "per_page", "sort", F.array_join(F.element_at("filters", "vendor"), "|").alias("vendor"), F.array_join(F.map_keys("filters"), "|").alias("sources"), "price_min", "price_max")


def _new_searches(spark, d):
    q = C.parse_query_log(Tables(spark, d).read("pages").select("page_id", F.concat(_asked(), F.lit("&q=a"), F.when(F.col("page_id") % 4 == 0, "&f.tag=x").otherwise("")).alias("url")))
    return C.new_searches(q).select("page_id")


def _csv(spark, d):
    s = searches(spark, d).withColumn("term", F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "ok", "@"))), (F.col("search_id") % 4 + 1).cast("int")), "term"))
    rows = sinks.analytics_sections(A.top_terms(s, AS_OF), A.zero_terms(s, AS_OF), A.no_click_terms(s, AS_OF))
    return sinks.safe_cells(rows)


def _feed(spark, d):
    shops = _shops(spark, d).select("shop_id", F.concat("shop_id", F.lit(".example")).alias("domain"), F.lit("EUR").alias("currency_code"))
    x = sinks.feed_records(S.page(S.ranked(browse_rows(spark, d))), shops)
    return x.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.get_json_object("record", "$.item.name").alias("name"), F.get_json_object("record", "$.item.offers.price").alias("price"), F.get_json_object("record", "$.item.offers.availability").alias("availability"))


def _highlight(spark, d):
    return Tables(spark, d).read("documents").select("doc_id", F.sha2(T.highlight(F.coalesce("text", F.lit("")), "the of"), 256).alias("h"))


def _store(spark, d):
    """Two shops' actions of eight days, read from a store of all of them."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    write_store(Tables(spark, d).actions(), path, "ts")
    rows = read_store(spark, path, ["shop1", "shop2"], "2024-01-08 06:00:00", "2024-01-16 18:00:00")
    return rows.groupBy("shop_id", "kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _letters(texts):
    """In place of a provider: the length of a text and its number of e."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


def _embed(spark, d):
    p = Tables(spark, d).products().withColumn("content_hash", F.when(F.col("product_id") % 3 == 0, F.sha2(X.embedding_text(), 256)))
    return X.embed(p, _letters).select("product_id", F.col("embedding")[0].cast("int").alias("chars"), F.col("embedding")[1].cast("int").alias("es"))


QUERIES = {
    "store_scan": _store,
    "embedded": _embed,
    "export_roundtrip": _roundtrip,
    "export_files": _export_files,
    "export_rejects": _rejects,
    "payload_merge": _payload_merge,
    "html_clean": lambda s, d: Tables(s, d).read("pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("h")),
    "membership_delta": _membership,
    "remove_collections": _remove_collections,
    "catalog_cap": _caps,
    "catalog_cap_report": lambda s, d: M.cap_report(*_capped(s, d)).na.fill(-1, ["product_limit"]),
    "sweep": _sweep,
    "mirror_snapshot": _snapshot,
    "tenant_purge": _purge,
    "plan_resolution": _plans,
    "language_restamp": _languages,
    "attribute_discovery": lambda s, d: M.discover_attributes(Tables(s, d).products()).select("shop_id", "kind", F.array_join("names", ",").alias("names")),
    "query_log": _query_log,
    "new_searches": _new_searches,
    "csv_sections": _csv,
    "feed_export": _feed,
    "highlight": _highlight,
}

_STRIP = r"""SELECT page_id, sha256(substr(trim(regexp_replace(
  regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&[a-zA-Z][a-zA-Z0-9]*;', ' ', 'g'), 'AMPMARK', '&', 'g'),
  '\s+', ' ', 'g')), 1, 5000)) AS h FROM (
  SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&amp;', 'AMPMARK') AS t FROM pages)"""

_CAPPED = """s AS (SELECT product_id, CAST(product_id AS INT) AS i, CASE WHEN i % 3 = 0 THEN 'pro' WHEN i % 3 = 1 THEN 'free' WHEN i % 6 = 2 THEN 'growth' WHEN i % 12 = 5 THEN 'none' ELSE 'odd' END AS shop_id FROM v_products),
k AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY i DESC) AS n, CASE shop_id WHEN 'growth' THEN 5000 WHEN 'pro' THEN 1e9 ELSE 100 END AS most FROM s)
"""

ORACLE_SQL = {
    "store_scan": with_views("SELECT shop_id, kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM v_actions WHERE shop_id IN ('shop1', 'shop2') AND ts >= TIMESTAMP '2024-01-08 06:00:00' AND ts <= TIMESTAMP '2024-01-16 18:00:00' GROUP BY ALL", "v_actions"),
    "embedded": with_views("SELECT product_id, CAST(length(t) AS INT) AS chars, CAST(length(t) - length(replace(t, 'e', '')) AS INT) AS es FROM (SELECT product_id, substr(concat_ws('. ', nullif(trim(title), ''), nullif(trim(product_type), ''), nullif(trim(vendor), ''), nullif(trim(array_to_string(tags, ', ')), ''), nullif(trim(substr(description, 1, 1000)), '')), 1, 4000) AS t FROM v_products WHERE CAST(product_id AS INT) % 3 <> 0)", "v_products"),
    "export_files": with_views("SELECT shop_id, 'product' AS kind, count(*) AS lines FROM v_products GROUP BY 1 UNION ALL SELECT shop_id, 'collection', count(*) FROM v_products GROUP BY 1 UNION ALL SELECT shop_id, 'metafield', count(*) + count(material) FROM v_products GROUP BY 1 UNION ALL SELECT shop_id, 'variant', count(*) FROM v_variants GROUP BY 1", "v_products", "v_variants"),
    "export_roundtrip": with_views("""w AS (SELECT shop_id, product_id, bool_or(available) AS a, count(DISTINCT sku) AS n FROM v_variants GROUP BY ALL)
SELECT p.shop_id, p.product_id, p.title, p.vendor, p.status, coalesce(w.a, false) AS available, round(p.price_min, 2) AS price_min, round(p.price_max, 2) AS price_max, p.collection AS collections, p.material, CASE WHEN CAST(p.product_id AS INT) % 15 <= 10 THEN 'v' || p.product_id END AS spec, least(200, coalesce(w.n, 0)) AS n_skus, w.n AS n_options FROM v_products p LEFT JOIN w ON w.shop_id = p.shop_id AND w.product_id = p.product_id""", "v_products", "v_variants"),
    "export_rejects": with_views("SELECT p.shop_id, p.product_id, count(v.variant_id) AS variants FROM v_products p LEFT JOIN v_variants v ON v.shop_id = p.shop_id AND v.product_id = p.product_id WHERE p.product_id LIKE '%7' GROUP BY ALL", "v_products", "v_variants"),
    "payload_merge": with_views("""SELECT shop_id, product_id, CASE WHEN k % 5 = 0 THEN title || ' new' ELSE title END AS title, CASE WHEN k % 5 = 0 THEN k % 3 > 0 ELSE available END AS available,
 round(CASE WHEN k % 5 = 0 THEN price_min + 1 ELSE price_min END, 2) AS price_min, CASE WHEN k % 5 = 0 THEN 'a & b' ELSE description END AS description, CASE WHEN k % 5 = 0 AND k % 2 <> 0 THEN '' ELSE array_to_string(tags, ',') END AS tags, collection AS collections, popularity,
 CASE WHEN k % 5 = 0 THEN '2024-01-31' ELSE '2024-01-01' END AS indexed FROM (SELECT *, CAST(product_id AS INT) AS k FROM v_products) WHERE NOT (k % 35 = 0) AND NOT (k % 5 = 0 AND status <> 'ACTIVE')""", "v_products"),
    "html_clean": _STRIP,
    "membership_delta": with_views("SELECT product_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN collection = 'c1' AND k % 10 <> 0 THEN [] ELSE [collection] END, list_concat(CASE WHEN k % 10 = 0 THEN ['c1'] ELSE [] END, CASE WHEN k % 15 = 0 THEN ['c9'] ELSE [] END)))), ',') AS collections FROM (SELECT *, CAST(product_id AS INT) AS k FROM v_products)", "v_products"),
    "remove_collections": with_views("SELECT shop_id, count(*) FILTER (ok) AS memberships, count(DISTINCT collection) FILTER (ok) AS collections FROM (SELECT *, NOT (collection = 'c2' OR shop_id = 'shop3' AND collection = 'c1') AS ok FROM v_products) GROUP BY 1", "v_products"),
    "catalog_cap": with_views(_CAPPED + "SELECT shop_id, product_id FROM k WHERE n <= most", "v_products"),
    "catalog_cap_report": with_views(_CAPPED + "SELECT shop_id, CAST(CASE WHEN min(most) < 1e9 THEN min(most) ELSE -1 END AS INT) AS product_limit, count(*) FILTER (n <= most) AS loaded, count(*) FILTER (n > most) AS cut, count(*) FILTER (n > most) > 0 AS truncated FROM k GROUP BY 1", "v_products"),
    "sweep": with_views("SELECT product_id FROM v_products WHERE CAST(product_id AS INT) % 3 = 0 OR shop_id = 'shop2'", "v_products"),
    "mirror_snapshot": with_views("SELECT DISTINCT shop_id, collection AS handle, CASE WHEN shop_id = 'shop1' THEN 'old' ELSE 'new' END AS title FROM v_products WHERE shop_id = 'shop1' OR collection <> 'c4'", "v_products"),
    "tenant_purge": with_views("SELECT shop_id, count(*) AS n, 'products' AS \"table\" FROM v_products WHERE shop_id <> 'shop2' GROUP BY 1 UNION ALL SELECT shop_id, count(*), 'actions' FROM v_actions WHERE shop_id <> 'shop2' GROUP BY 1", "v_products", "v_actions"),
    "plan_resolution": """WITH s AS (SELECT CAST(floor(c_custkey / 10) AS INT) AS k, CASE WHEN c_custkey % 3 <> 0 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 1 WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END AS tier FROM customer)
SELECT 's' || k AS shop_id, CASE WHEN k % 20 = 0 THEN 'growth' ELSE ['free', 'growth', 'pro', 'custom'][max(tier) + 1] END AS plan FROM s GROUP BY k""",
    "language_restamp": with_views("SELECT product_id, CASE WHEN shop_id = 'shop1' THEN 'french' ELSE 'simple' END AS ts_config FROM v_products", "v_products"),
    "attribute_discovery": with_views("SELECT shop_id, 'option' AS kind, CASE WHEN count(opt_color) > 0 THEN 'Color,Size' ELSE 'Size' END AS names FROM v_products GROUP BY 1 UNION ALL SELECT shop_id, 'metafield', 'material' FROM v_products WHERE material IS NOT NULL GROUP BY 1", "v_products"),
    "query_log": "SELECT page_id, 'red widget ' || page_id AS term, greatest(1, least(200, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT), 1))) AS page, CAST(greatest(1, least(48, page_id % 100)) AS INT) AS per_page, 'relevance' AS sort, 'A&B|C' AS vendor, 'vendor|tag' AS sources, CAST(NULL AS DOUBLE) AS price_min, CAST(page_id % 7 AS DOUBLE) AS price_max FROM pages",
    "new_searches": "SELECT page_id FROM pages WHERE page_id % 4 <> 0 AND greatest(1, least(200, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INT), 1))) = 1",
    "csv_sections": with_views(_SEARCHES + f""", z AS (SELECT shop_id, ['=', '+', 'ok', '@'][search_id % 4 + 1] || term AS term, results_count, clicked FROM searches WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}'),
u AS (SELECT 'top' AS section, shop_id, term, count(*) AS searches FROM z GROUP BY ALL UNION ALL SELECT 'zero results', shop_id, term, count(*) FROM z WHERE results_count = 0 GROUP BY ALL UNION ALL SELECT 'no clicks', shop_id, term, count(*) FROM z WHERE results_count > 0 GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (clicked) = 0)
SELECT section, shop_id, CAST(row_number() OVER (PARTITION BY section, shop_id ORDER BY searches DESC, term) AS VARCHAR) AS rank, CASE WHEN term[1] IN ('=', '+', '@') THEN '''' || term ELSE term END AS term, CAST(searches AS VARCHAR) AS searches FROM u QUALIFY row_number() OVER (PARTITION BY section, shop_id ORDER BY searches DESC, term) <= 25""", "v_actions"),
    "feed_export": _cat(" SELECT query_id, rank, title AS name, printf('%.2f', price_min) AS price, 'https://schema.org/' || CASE WHEN available THEN 'InStock' ELSE 'OutOfStock' END AS availability FROM ranked WHERE rank > (page - 1) * per_page AND rank <= page * per_page"),
    "highlight": r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)(the|of)', '<mark>\1</mark>', 'g')) AS h FROM documents",
}
