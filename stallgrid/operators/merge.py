"""Keeping the catalog: merges, deletes, sweeps, snapshots, membership, plans. Versions are new tables, never updates in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["shop_id", "product_id"]
#: Columns that a webhook change does not carry: kept on rows that exist.
BULK_ONLY = ("collections", "metafields", "currency_code", "ts_config")
NEVER_WRITTEN = ("popularity", "decayed_at")


def latest_changes(changes: DataFrame, key: list[str] = KEY, by: str = "updated_at") -> DataFrame:
    """The newest change of each key."""
    order = [F.desc_nulls_last(by)] if by in changes.columns else []
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order, F.xxhash64(*[c for c in changes.columns if not dict(changes.dtypes)[c].startswith("map")])))
    return changes.withColumn("_n", n).where("_n = 1").drop("_n")


def merge_products(current: DataFrame, changes: DataFrame, source: str, as_of: str) -> DataFrame:
    """``current`` with ``changes`` applied: 'bulk' writes all columns, 'webhook' keeps BULK_ONLY on rows that exist.

    Popularity is never written. Rows that are written get indexed_at and lose their content_hash when the text
    for embeddings changed is found later (the hash itself decides, so it is kept here).
    """
    new = latest_changes(changes)
    cur, chg = current.alias("c"), new.withColumn("_new", F.lit(True)).alias("n")
    rows = cur.withColumn("_old", F.lit(True)).alias("c").join(chg, KEY, "full_outer")
    out = [*map(F.col, KEY)]
    for name in current.columns:
        if name in (*KEY, "indexed_at"):
            continue
        old, fresh = F.col(f"c.{name}"), F.col(f"n.{name}") if name in new.columns else None
        if fresh is None or name in NEVER_WRITTEN:
            out.append(old.alias(name))
        elif source == "webhook" and name in BULK_ONLY:
            out.append(F.when(F.col("_old"), old).otherwise(fresh).alias(name))
        else:
            out.append(F.when(F.col("_new"), fresh).otherwise(old).alias(name))
    was = F.col("c.indexed_at") if "indexed_at" in current.columns else F.lit(None).cast("timestamp")
    out.append(F.when(F.col("_new"), F.lit(as_of).cast("timestamp")).otherwise(was).alias("indexed_at"))
    return rows.select(*out)


def replace_variants(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Variants of every touched product are replaced as a whole."""
    return current.join(changes.select(*KEY).distinct(), KEY, "left_anti").unionByName(changes, allowMissingColumns=True)


def apply_changes(current: DataFrame, changes: DataFrame, as_of: str, deletes: DataFrame | None = None) -> DataFrame:
    """Routes changes: unpublished or inactive products and explicit deletes go, the rest is merged."""
    last = latest_changes(changes)
    gone = last.where(~F.col("published_online") | (F.col("status") != "ACTIVE")).select(*KEY)
    if deletes is not None:
        gone = gone.unionByName(deletes.select(*KEY))
    live = last.where(F.col("published_online") & (F.col("status") == "ACTIVE"))
    return merge_products(current, live, "webhook", as_of).join(gone.distinct(), KEY, "left_anti")


def sweep_stale(products: DataFrame, run_started_at: str, allow_empty: bool = False) -> DataFrame:
    """Rows written by the run; a shop of which nothing was written keeps its rows unless ``allow_empty``."""
    kept = products.where(F.col("indexed_at") >= F.lit(run_started_at).cast("timestamp"))
    if allow_empty:
        return kept
    return kept.unionByName(products.join(kept.select("shop_id").distinct(), "shop_id", "left_anti").select(*kept.columns))


def discover_attributes(products: DataFrame, cap: int = 100) -> DataFrame:
    """shop_id, kind (option, metafield), names: the sorted distinct keys, at most ``cap``."""
    keys = lambda kind, c: products.select("shop_id", F.lit(kind).alias("kind"), F.explode(F.map_keys(c)).alias("name"))
    every = keys("option", "options").unionByName(keys("metafield", "metafields")).distinct()
    n = F.row_number().over(W.partitionBy("shop_id", "kind").orderBy("name"))
    return every.withColumn("n", n).where(F.col("n") <= cap).groupBy("shop_id", "kind").agg(F.sort_array(F.collect_list("name")).alias("names"))


def _numbered(products: DataFrame, plans: DataFrame, order: str) -> DataFrame:
    limits = plans.select("shop_id", plan_value(F.col("plan"), PLAN_PRODUCTS).alias("_limit"), F.lit(True).alias("_known"))
    n = F.row_number().over(W.partitionBy("shop_id").orderBy(F.col(order), "product_id"))
    rows = products.withColumn("_n", n).join(limits, "shop_id", "left")
    return rows.withColumn("_limit", F.when(F.col("_known"), F.col("_limit")).otherwise(PLAN_PRODUCTS["free"])).drop("_known")


def cap_catalog(products: DataFrame, plans: DataFrame, order: str = "load_seq") -> DataFrame:
    """The products of each shop that its plan (shop_id, plan) includes, in load order; a shop without a plan is free."""
    return _numbered(products, plans, order).where("_limit IS NULL OR _n <= _limit").drop("_n", "_limit")


def cap_report(products: DataFrame, plans: DataFrame, order: str = "load_seq") -> DataFrame:
    """shop_id, product_limit, loaded, cut, truncated: what the cap of ``cap_catalog`` leaves and takes, one row a shop."""
    kept = F.col("_limit").isNull() | (F.col("_n") <= F.col("_limit"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    g = _numbered(products, plans, order).groupBy("shop_id").agg(F.first("_limit").alias("product_limit"), count(kept).alias("loaded"), count(~kept).alias("cut"))
    return g.withColumn("truncated", F.col("cut") > 0)


def sync_snapshot(current: DataFrame, snapshot: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot's rows for shops that sent one; shops with an empty snapshot keep what they had."""
    return snapshot.unionByName(current.join(snapshot.select("shop_id").distinct(), "shop_id", "left_anti").select(*snapshot.columns))


def reconcile_membership(products: DataFrame, members: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds handles to members that lack them; removes a handle from others only where its listing is complete.

    members: shop_id, product_id, handle. listings: shop_id, handle, complete. All collections in one pass.
    """
    mine = members.groupBy(*KEY).agg(F.array_sort(F.collect_set("handle")).alias("_in"))
    full = listings.where("complete").groupBy("shop_id").agg(F.collect_set("handle").alias("_full"))
    none = F.array().cast("array<string>")
    rows = products.join(mine, KEY, "left").join(full, "shop_id", "left")
    inn, whole = F.coalesce("_in", none), F.coalesce("_full", none)
    left = F.array_except("collections", F.array_except(whole, inn))
    return rows.withColumn("collections", F.concat(left, F.array_except(inn, left))).drop("_in", "_full").select(*products.columns)


def remove_collections(products: DataFrame, collections: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products without the removed handles, the collections that stay). gone: shop_id, handle."""
    drop = gone.groupBy("shop_id").agg(F.collect_set("handle").alias("_gone"))
    p = products.join(drop, "shop_id", "left").withColumn("collections", F.when(F.col("_gone").isNull(), F.col("collections")).otherwise(F.array_except("collections", F.col("_gone")))).drop("_gone")
    return p.select(*products.columns), collections.join(gone.select("shop_id", "handle"), ["shop_id", "handle"], "left_anti")


def restamp_language(products: DataFrame, shops: DataFrame) -> DataFrame:
    from stallgrid.functions.text import ts_config

    lang = shops.select("shop_id", ts_config(F.col("search_language")).alias("_lang"))
    return products.join(lang, "shop_id", "left").withColumn("ts_config", F.coalesce("_lang", F.lit("simple"))).drop("_lang")


def purge_shops(tables: dict[str, DataFrame], shop_ids: DataFrame) -> dict[str, DataFrame]:
    ids = shop_ids.select("shop_id").distinct()
    return {name: t.join(ids, "shop_id", "left_anti") for name, t in tables.items()}


# Plan tiers, lowest first; products and days of reports that each includes (none: no limit).
TIERS = ("free", "growth", "pro", "custom")
PLAN_PRODUCTS = {"free": 100, "growth": 5_000, "pro": None, "custom": None}
PLAN_DAYS = {"free": 7, "growth": 30, "pro": 90, "custom": 365}


def plan_value(plan: Column, table: dict[str, int | None]) -> Column:
    """The plan's entry of a table; a name that is no plan counts as free."""
    known = F.when(plan.isin(*TIERS), plan).otherwise("free")
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("int"))])[known]


def resolve_plans(subscriptions: DataFrame, shops: DataFrame) -> DataFrame:
    """shop_id, plan: the highest tier among active subscriptions, by name; a name of no tier counts as the lowest paid one.

    An override wins if it is the name of a tier. Names are compared by their letters and digits, and may go on
    behind the tier ("Pro (Annual)").
    """
    name = F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]", "")
    tier = F.when(F.col("status") != "ACTIVE", 0)
    for i in reversed(range(len(TIERS))):
        tier = tier.when(name.startswith(TIERS[i]), i)
    best = subscriptions.groupBy("shop_id").agg(F.max(tier.otherwise(TIERS.index("growth"))).alias("tier"))
    rows = shops.select("shop_id", "plan_override").join(best, "shop_id", "left")
    override = F.when(F.col("plan_override").isin(*TIERS), F.col("plan_override"))
    return rows.select("shop_id", F.coalesce(override, F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce("tier", F.lit(0)) + 1)).alias("plan"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
