"""Registered streaming queries: the given events as a file stream, run to its end, with the batch jobs' SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallgrid.operators.events import POPULARITY
from stallgrid.plans.analytics_queries import _CLICK, CAPPED
from stallgrid.plans.analytics_queries import ORACLE_SQL as BATCH
from stallgrid.plans.fixtures import AS_OF, Tables, shared_folder, with_views
from stallgrid.plans.ingest_queries import payloads
from stallgrid.streaming import changes as CH
from stallgrid.streaming import events as ST


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


class _Streams(Tables):
    def read(self, name: str):
        # A glob: the table may be one file, and a plain path of a file stream must be a folder.
        return self.spark.readStream.schema(self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema).parquet(f"{self.folder}/{name}[.]parquet")


def _actions(spark, d):
    return _Streams(spark, d).actions()


def _closed(spark, d):
    """The actions, and one search of a shop of its own long after them: it carries the watermark past the last action."""
    a, folder = _actions(spark, d), _folder(spark)
    last = Tables(spark, d).actions().agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").withColumn("ts", F.col("ts") + F.make_interval(years=F.lit(1)))
    end = {"event_id": F.lit(-1), "shop_id": F.lit("~"), "session_token": F.lit("~"), "kind": F.lit("search"), "ts": F.col("ts")}
    last.select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in a.schema]).write.parquet(f"{folder}/end")
    return a.unionByName(spark.readStream.schema(a.schema).parquet(f"{folder}/end"))


def _popularity(spark, d):
    folder = _folder(spark)
    ST.popularity_stream(_closed(spark, d), folder, POPULARITY)
    return ST.popularity_totals(spark, folder, POPULARITY)


def _dedup(spark, d):
    """Searches of which a fifth has no token, as in the batch job."""
    s = _closed(spark, d).where("kind = 'search'").withColumn("session_token", F.when(F.col("event_id") % 5 != 0, F.col("session_token")))
    return ST.finished(ST.collapse_repeats_stream(s, 6 * 3600), _folder(spark)).select("event_id").where("event_id >= 0")


def _changes(spark, d):
    """The catalog after a stream of changes: a new title for a third of the products, and a fifth of those leave."""
    folder, n = _folder(spark), F.col("product_id").cast("int")
    p = Tables(spark, d).products().withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(AS_OF).cast("timestamp"))
    p.where(n % 3 == 0).withColumns({"title": F.concat("title", F.lit(" new")), "published_online": n % 5 != 0, "status": F.lit("ACTIVE")}).write.parquet(f"{folder}/in")
    ST.catalog_stream(spark.readStream.schema(p.schema).parquet(f"{folder}/in"), p, f"{folder}/out", AS_OF).awaitTermination()
    return ST.catalog_version(spark, f"{folder}/out").select("shop_id", "product_id", "title")


def _topics(spark, d):
    """The catalog behind all four topics: changed and deleted products, a collection with a complete list of members, and a deleted one."""
    folder, p = _folder(spark), Tables(spark, d).products()
    n, json = F.col("product_id").cast("int"), lambda *c: F.to_json(F.struct(*c))
    event = lambda df, topic, hours, value: df.select(F.lit(topic).alias("topic"), "shop_id", (F.lit(AS_OF).cast("timestamp") + F.make_interval(hours=F.lit(hours))).alias("at"), value.alias("value"))
    shops = p.where(n % 10 == 0).groupBy("shop_id").agg(F.sort_array(F.collect_list("product_id")).alias("members"))
    raw = event(payloads(spark, d), "products/upsert", 0, F.col("value")).unionByName(event(p.where(n % 7 == 1), "products/delete", 1, json(n.alias("id"))))
    raw = raw.unionByName(event(shops, "collections/upsert", 2, json(F.lit("c1").alias("id"), F.lit("c1").alias("handle"), F.lit("One").alias("title"), "members", F.lit(True).alias("complete"))))
    raw.unionByName(event(p.select("shop_id").distinct(), "collections/delete", 3, json(F.lit("c2").alias("id")))).write.parquet(f"{folder}/in")
    own = p.select("shop_id", F.explode("collections").alias("collection_id")).groupBy("shop_id", "collection_id").agg(F.count("*").alias("product_count"))
    CH.start_changes(p, own.withColumns({"handle": F.col("collection_id"), "title": F.col("collection_id")}), f"{folder}/out")
    CH.change_stream(spark.readStream.schema(raw.schema).parquet(f"{folder}/in"), f"{folder}/out").awaitTermination()
    found = CH.current_products(spark, f"{folder}/out").select("shop_id", F.col("product_id").alias("id"), "title", F.array_join("collections", ",").alias("collections"), "popularity")
    return found.unionByName(CH.current_collections(spark, f"{folder}/out").select("shop_id", F.col("collection_id").alias("id"), "title", F.col("handle").alias("collections"), F.lit(0.0).alias("popularity")))


QUERIES = {
    "change_topics": _topics,
    "change_stream": _changes,
    "stream_daily_activity": lambda s, d: ST.finished(ST.daily_activity_stream(_actions(s, d).where("kind = 'search'")), _folder(s), "complete").withColumn("day", F.col("day").cast("string")),
    "stream_dedup": _dedup,
    "stream_click_attribution": lambda s, d: ST.finished(ST.attribute_stream(_closed(s, d), "click", 24, same_term=True), _folder(s)).where("search_id IS NOT NULL").select("event_id", "search_id"),
    "stream_synthetic": lambda s, d: ST.finished(ST.attribute_stream(_closed(s, d), "click", 2, same_term=True), _folder(s)).where("search_id IS NULL").select("event_id"),
    "stream_event_cap": lambda s, d: ST.finished(ST.cap_events_stream(_closed(s, d), 3, 5 * 24 * 3600), _folder(s)).select("event_id").where("event_id >= 0"),
    "stream_orders": lambda s, d: ST.finished(ST.unique_orders_stream(_actions(s, d).where("kind = 'purchase'"), "40 days"), _folder(s)).select("shop_id", "order_id"),
    "stream_popularity": _popularity,
}

ORACLE_SQL = {
    "change_topics": with_views("""p AS (SELECT *, CAST(product_id AS INT) AS k, bool_or(CAST(product_id AS INT) % 10 = 0) OVER (PARTITION BY shop_id) AS listed FROM v_products)
SELECT shop_id, product_id AS id, CASE WHEN k % 5 = 0 THEN title || ' new' ELSE title END AS title, CASE WHEN k % 10 = 0 THEN CASE WHEN collection IN ('c1', 'c2') THEN 'c1' ELSE collection || ',c1' END WHEN collection = 'c2' OR (listed AND collection = 'c1') THEN '' ELSE collection END AS collections, popularity
FROM p WHERE k % 35 <> 0 AND NOT (k % 5 = 0 AND status <> 'ACTIVE') AND k % 7 <> 1
UNION ALL SELECT DISTINCT shop_id, collection, collection, collection, 0.0 FROM p WHERE collection <> 'c2' AND NOT (listed AND collection = 'c1') UNION ALL SELECT DISTINCT shop_id, 'c1', 'One', 'c1', 0.0 FROM p WHERE listed""", "v_products"),
    "change_stream": with_views("SELECT shop_id, product_id, title || CASE WHEN CAST(product_id AS INT) % 3 = 0 THEN ' new' ELSE '' END AS title FROM v_products WHERE CAST(product_id AS INT) % 15 <> 0", "v_products"),
    "stream_event_cap": with_views(CAPPED + "SELECT event_id FROM w WHERE n <= 3", "v_actions").replace("WITH ", "WITH RECURSIVE ", 1),
    "stream_daily_activity": with_views("SELECT shop_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS searches FROM v_actions WHERE kind = 'search' GROUP BY ALL", "v_actions"),
    "stream_click_attribution": with_views(_CLICK.format(kind="click", term="AND s.term = a.term", h=24), "v_actions"),
    "stream_synthetic": with_views("SELECT event_id FROM v_actions a WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM v_actions s WHERE s.kind = 'search' AND s.shop_id = a.shop_id AND s.session_token = a.session_token AND s.term = a.term AND s.ts <= a.ts AND s.ts >= a.ts - INTERVAL 2 HOUR)", "v_actions"),
    "stream_orders": with_views("SELECT DISTINCT shop_id, order_id FROM v_actions WHERE kind = 'purchase'", "v_actions"),
    "stream_popularity": BATCH["popularity"],
    "stream_dedup": BATCH["search_dedup"],
}
