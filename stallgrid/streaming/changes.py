"""The stream of catalog changes: products and collections that are made, changed and deleted, kept as batches of events.

A batch writes its own events and nothing else, under its number, so a repeated batch replaces itself and what is
written grows with the changes. The catalog behind any number of batches is worked out when it is read: of each
product the last event by its time counts, whatever batch it came in. ``compact_changes`` writes that state as the new
base; deleted products stay in it as a mark with their time, so that an older event that comes late changes nothing.

Rules. A change to a product that exists keeps what changes do not carry (collections, metafields, currency, language
configuration, popularity); one to a product that was deleted, unpublished or inactive before starts it anew. A
collection's event lists members: a complete list removes its handle from all other products, a deleted collection is
a complete list of none. A list reaches the products that exist at its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.operators.merge import BULK_ONLY, KEY, NEVER_WRITTEN
from stallgrid.operators.scratch import remove
from stallgrid.sources.catalog import normalize_payload

_LOG = "number int, base boolean"
_COLLECTION = "shop_id string, collection_id string, handle string, title string, product_count bigint, at timestamp, gone boolean, complete boolean, members array<string>"
_BODY = "id string, handle string, title string, products_count bigint, members array<string>, complete boolean"
_TABLES = ("products", "collections")


def start_changes(products: DataFrame, collections: DataFrame, folder: str) -> None:
    """The catalog to begin with. collections: shop_id, collection_id, handle, title, product_count."""
    marks = {"_gone": F.lit(False), "_version": F.lit(None).cast("timestamp"), "_birth": F.lit(None).cast("timestamp")}
    products.withColumns(marks).write.mode("overwrite").parquet(f"{folder}/base/products/number=0")
    collections.withColumns({"_gone": F.lit(False), "_version": F.lit(None).cast("timestamp")}).write.mode("overwrite").parquet(f"{folder}/base/collections/number=0")
    _log(products.sparkSession, folder, 0, True)


def _log(spark: SparkSession, folder: str, number: int, base: bool) -> None:
    spark.createDataFrame([(number, base)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/number={number}")


def parse_events(raw: DataFrame) -> dict[str, DataFrame]:
    """Events by table, from envelopes (topic, shop_id, at, value: JSON); topics that are not known are left out.

    An event's time is the payload's updated_at where it has one, else ``at``.
    """
    of = lambda topic: raw.where(F.col("topic") == topic)
    gid = F.regexp_extract(F.get_json_object("value", "$.id"), r"(\d+)$", 1)
    ups = normalize_payload(of("products/upsert"), keep=("at",)).withColumn("at", F.coalesce("updated_at", "at"))
    ups = ups.withColumn("gone", ~F.col("published_online") | (F.col("status") != "ACTIVE"))
    dels = of("products/delete").select("shop_id", gid.alias("product_id"), "at", F.lit(True).alias("gone")).where("product_id <> ''")
    body = lambda topic: of(topic).select("shop_id", "at", F.from_json("value", _BODY).alias("x")).where("x.id IS NOT NULL").select("shop_id", "at", "x.*")
    cu = body("collections/upsert").select("shop_id", F.col("id").alias("collection_id"), "handle", F.coalesce("title", "handle").alias("title"), F.coalesce("products_count", F.lit(0)).alias("product_count"), "at", F.lit(False).alias("gone"), F.coalesce("complete", F.lit(False)).alias("complete"), "members")
    cd = body("collections/delete").select("shop_id", F.col("id").alias("collection_id"), F.lit(None).cast("string").alias("handle"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("product_count"), "at", F.lit(True).alias("gone"), F.lit(True).alias("complete"), F.array().cast("array<string>").alias("members"))
    return {"products": ups.unionByName(dels, allowMissingColumns=True), "collections": cu.unionByName(cd)}


def append_changes(folder: str, number: int, events: dict[str, DataFrame]) -> None:
    """The events of batch ``number`` (1 and up)."""
    for table in _TABLES:
        events[table].write.mode("overwrite").parquet(f"{folder}/events/{table}/number={number}")
    _log(events["products"].sparkSession, folder, number, False)


def change_stream(raw: DataFrame, folder: str) -> object:
    """A running query that appends every batch of envelopes; a batch's number is one more than the stream's."""
    return (
        raw.writeStream.foreachBatch(lambda batch, n: append_changes(folder, n + 1, parse_events(batch)))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def _state(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    lines = spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/log").orderBy("number").collect()  # bounded: a line a batch since the last compaction
    base = max(x.number for x in lines if x.base)
    return base, [x.number for x in lines if x.number > base]


def _base(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/base/{table}/number={_state(spark, folder)[0]}")


def _events(spark: SparkSession, folder: str, table: str, keys: list[str]) -> DataFrame | None:
    """Events behind the base that are newer than what the base has of their key, with ``ord``, their order."""
    numbers = _state(spark, folder)[1]
    if not numbers:
        return None
    rows = spark.read.option("basePath", f"{folder}/events/{table}").option("mergeSchema", "true").parquet(*[f"{folder}/events/{table}/number={n}" for n in numbers])
    known = _base(spark, folder, table).select(*keys, "_version")
    rows = rows.join(known, keys, "left").where("_version IS NULL OR at > _version").drop("_version")
    return rows.withColumn("ord", F.struct("at", "number"))


def _collections(spark: SparkSession, folder: str) -> DataFrame:
    base = _base(spark, folder, "collections")
    events = _events(spark, folder, "collections", ["shop_id", "collection_id"])
    if events is None:
        return base
    keys = ["shop_id", "collection_id"]
    last = events.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ord")))).where("_n = 1")
    rows = base.withColumn("_old", F.lit(True)).alias("b").join(last.select(*keys, "handle", "title", "product_count", "at", "gone").alias("e"), keys, "full_outer")
    pick = lambda c: F.when(F.col("e.at").isNull() | F.col("e.gone"), F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    return rows.select(*keys, *map(pick, ("handle", "title", "product_count")), F.coalesce("e.gone", "b._gone").alias("_gone"), F.coalesce("e.at", "b._version").alias("_version"))


def _membership(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(shop_id, lists: handles with a complete list and its time; shop_id, product_id, joined: handles it was listed under, and when)."""
    keys = ["shop_id", "collection_id"]
    events = _events(spark, folder, "collections", keys)
    if events is None:
        return None
    own = _collections(spark, folder).select(*keys, F.col("handle").alias("_handle")).where("_handle <> ''")
    events = events.join(own, keys).withColumn("_full", F.max(F.when(F.col("complete"), F.col("ord"))).over(W.partitionBy(*keys)))
    lists = events.where("_full IS NOT NULL").groupBy("shop_id").agg(F.collect_set(F.struct(F.col("_handle").alias("handle"), F.col("_full.at").alias("at"))).alias("lists"))
    counts = events.where(F.col("_full").isNull() | (F.col("ord") >= F.col("_full")))
    joined = counts.select("shop_id", F.explode("members").alias("product_id"), F.col("_handle").alias("handle"), "at").groupBy("shop_id", "product_id", "handle").agg(F.max("at").alias("at"))
    return lists, joined.groupBy("shop_id", "product_id").agg(F.collect_list(F.struct("handle", "at")).alias("joined"))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    """All products with their marks: _gone, _version (the last event's time), _birth (since when a product exists; null: always)."""
    base = _base(spark, folder, "products")
    columns = [c for c in base.columns if c not in (*KEY, "_gone", "_version", "_birth")]
    events = _events(spark, folder, "products", KEY)
    rows = base
    if events is not None:
        key = W.partitionBy(*KEY)
        events = events.withColumn("_reset", F.max(F.when(F.col("gone"), F.col("ord"))).over(key))
        live = ~F.col("gone") & (F.col("_reset").isNull() | (F.col("ord") > F.col("_reset")))
        events = events.withColumn("_born", F.min(F.when(live, F.col("at"))).over(key)).withColumn("_n", F.row_number().over(key.orderBy(F.desc("ord")))).where("_n = 1")
        both = base.withColumn("_old", ~F.col("_gone")).alias("b").join(events.alias("e"), KEY, "full_outer")
        same, fresh = F.coalesce("b._old", F.lit(False)) & F.col("e._reset").isNull(), F.col("e.at").isNotNull() & ~F.col("e.gone")

        def pick(c: str) -> Column:
            old = F.col(f"b.{c}")
            if c == "indexed_at":
                return F.when(fresh, F.col("e.at")).otherwise(old).alias(c)
            new = F.col(f"e.{c}") if c in events.columns else F.lit(None).cast(base.schema[c].dataType)
            if c in NEVER_WRITTEN or c not in events.columns or c in BULK_ONLY:
                new = F.when(same, old).otherwise(F.lit(None) if c in NEVER_WRITTEN else new)
            return F.when(fresh, new).otherwise(old).cast(base.schema[c].dataType).alias(c)

        birth = F.when(fresh & ~same, F.col("e._born")).otherwise(F.col("b._birth"))
        rows = both.select(*KEY, *map(pick, columns), F.coalesce("e.gone", "b._gone").alias("_gone"), F.coalesce("e.at", "b._version").alias("_version"), birth.alias("_birth"))
    listed = _membership(spark, folder)
    if listed is None or "collections" not in columns:
        return rows
    rows = rows.join(listed[0], "shop_id", "left").join(listed[1], KEY, "left")
    there = lambda at: F.col("_birth").isNull() | (at >= F.col("_birth"))
    none = F.array().cast("array<struct<handle:string,at:timestamp>>")
    kept = F.filter(F.coalesce("collections", F.array().cast("array<string>")), lambda h: ~F.exists(F.coalesce("lists", none), lambda x: (x["handle"] == h) & there(x["at"])))
    added = F.transform(F.filter(F.coalesce("joined", none), lambda x: there(x["at"])), lambda x: x["handle"])
    return rows.withColumn("collections", F.array_union(kept, F.array_sort(added))).drop("lists", "joined")


def current_products(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).where("NOT _gone").drop("_gone", "_version", "_birth")


def current_collections(spark: SparkSession, folder: str) -> DataFrame:
    return _collections(spark, folder).where("NOT _gone").drop("_gone", "_version")


def compact_changes(spark: SparkSession, folder: str, number: int) -> None:
    """The state behind all batches as base ``number``; what it was made of is removed."""
    base, numbers = _state(spark, folder)
    _resolved(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/products/number={number}")
    _collections(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/collections/number={number}")
    _log(spark, folder, number, True)
    for table in _TABLES:
        remove(spark, f"{folder}/base/{table}/number={base}")
        for n in numbers:
            remove(spark, f"{folder}/events/{table}/number={n}")
    for n in (base, *numbers):
        remove(spark, f"{folder}/log/number={n}")
