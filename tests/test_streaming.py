"""Streams over several small files give what the batch jobs give over all rows."""

import datetime
import time

from pyspark.sql import functions as F

from stallgrid.operators import events as E
from stallgrid.operators import merge as M
from stallgrid.plans.fixtures import AS_OF, Tables
from stallgrid.streaming import events as ST


def shuffled(spark, sf, folder):
    """The actions in four files in no order of time, a fifth of them without a token, orders repeated, and a last event that ends them."""
    a = Tables(spark, sf).actions().withColumn("session_token", F.when(F.col("event_id") % 5 != 0, F.col("session_token"))).withColumn("order_id", F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("o"), F.expr("event_id % 40"))))
    end = a.agg((F.max("ts") + F.make_interval(years=F.lit(1))).alias("ts")).select(*[{"event_id": F.lit(-1), "shop_id": F.lit("~"), "session_token": F.lit("~"), "kind": F.lit("search"), "ts": F.col("ts")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in a.schema])
    for part in range(4):
        a.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read by their time
    end.coalesce(1).write.mode("append").parquet(folder)
    return a, spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_streams_equal_batch_on_shuffled_files(spark, sf, tmp_path):
    a, s = shuffled(spark, sf, str(tmp_path / "in"))
    wide = "40 days"  # files hold events of the whole month
    run = lambda stream, name: ST.finished(stream, str(tmp_path / name)).where("event_id >= 0")
    kept = run(ST.collapse_repeats_stream(s.where("kind = 'search'"), 6 * 3600, wide), "dedup")
    assert ids(kept.select("event_id")) == ids(E.collapse_repeats(a.where("kind = 'search'"), 6 * 3600).select("event_id"))
    capped = run(ST.cap_events_stream(s, 2, 5 * 24 * 3600, wide), "cap")
    assert ids(capped.select("event_id")) == ids(E.cap_events(a, 2, 5 * 24 * 3600).select("event_id"))
    carts = run(ST.attribute_stream(s, "add_to_cart", 24, late=wide), "cart")
    assert ids(carts.where("search_id IS NOT NULL").select("event_id", "search_id")) == ids(E.attribute(a, "add_to_cart", 24).select("event_id", "search_id"))
    folder = str(tmp_path / "popular")
    ST.popularity_stream(s, folder, E.POPULARITY, hours=48, late=wide)
    assert ids(ST.popularity_totals(spark, folder, E.POPULARITY)) == ids(E.popularity_increments(a, 48).select("shop_id", "product_id", "increment"))
    # A second run finds nothing new, and nothing is counted twice.
    ST.popularity_stream(s, folder, E.POPULARITY, hours=48, late=wide)
    assert ids(ST.popularity_totals(spark, folder, E.POPULARITY)) == ids(E.popularity_increments(a, 48).select("shop_id", "product_id", "increment"))


def test_repeats_without_a_token(spark):
    """A search without a token repeats what was kept, not what was itself left out as a repeat."""
    rows = [(1, "a", 0), (2, "a", 50), (3, None, 100), (4, None, 120), (5, "b", 130), (6, None, 185), (7, None, 191)]
    s = spark.createDataFrame([(e, "s", t, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at), "x") for e, t, at in rows], "event_id bigint, shop_id string, session_token string, ts timestamp, term string")
    assert sorted(r.event_id for r in E.collapse_repeats(s).collect()) == [1, 3, 5, 7]


def test_orders_of_which_only_the_second_beacon_has_a_search(spark):
    at = lambda h: datetime.datetime(2024, 1, 5, h)
    rows = [(1, "st", at(9), "search", None), (2, "other", at(8), "purchase", "o1"), (3, "st", at(10), "purchase", "o1"), (4, "st", at(11), "purchase", "o1"), (5, "st", at(12), "purchase", None), (6, "st", at(13), "purchase", None)]
    a = spark.createDataFrame([(*r, "s", "t", "p", 1.0, 1) for r in rows], "event_id bigint, session_token string, ts timestamp, kind string, order_id string, shop_id string, term string, product_id string, revenue double, results_count int")
    assert sorted(r.event_id for r in E.attributed_orders(a).collect()) == [3, 5, 6]
    assert E.popularity_increments(a).collect()[0].increment == 75.0


def test_attribution_out_of_order(spark, tmp_path):
    """Searches and clicks in any order over several batches belong together as they do in one batch."""
    at = lambda h, m: datetime.datetime(2024, 1, 5, h, m)
    rows = [
        [(1, at(8, 0), "search"), (2, at(9, 30), "search"), (3, at(9, 0), "click")],
        [(4, at(8, 50), "search"), (5, at(9, 40), "click"), (6, at(8, 10), "click"), (7, at(7, 0), "click")],
        [(8, at(9, 35), "search"), (9, at(12, 0), "click")],
        [(10, datetime.datetime(2024, 3, 1), "search")],
    ]
    schema = "event_id bigint, ts timestamp, kind string"
    every = None
    for part in rows:
        df = spark.createDataFrame(part, schema).select("event_id", F.lit("s").alias("shop_id"), F.when(F.col("event_id") == 10, "other").otherwise("st").alias("session_token"), "ts", "kind", F.lit(1).alias("results_count"), F.lit("t").alias("term"), F.lit("p").alias("product_id"), F.lit("o").alias("order_id"), F.lit(0.0).alias("revenue"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        every = df if every is None else every.unionByName(df)
        time.sleep(1.1)  # files are read by their time
    s = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ids(ST.finished(ST.attribute_stream(s, "click", 2, late="3 hours"), str(tmp_path / "out")).where("search_id IS NOT NULL").select("event_id", "search_id"))
    assert got == ids(E.attribute(every, "click", 2).select("event_id", "search_id")) == [(3, 4), (5, 8), (6, 1)]


def test_catalog_stream_writes_versions(spark, sf, tmp_path):
    p = Tables(spark, sf).products().withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(AS_OF).cast("timestamp"))
    p.where("product_id < 5").withColumn("title", F.lit("new")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    ST.catalog_stream(s, p, str(tmp_path / "out"), AS_OF).awaitTermination()
    out = ST.catalog_version(spark, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "batch=0").glob("_bucket=*"))) <= p.where("product_id < 5").count()  # the others were not rewritten
    want = M.apply_changes(p, p.where("product_id < 5").withColumn("title", F.lit("new")), AS_OF)
    assert ids(out.select("product_id", "title")) == ids(want.select("product_id", "title"))


def test_sessions_share_states(spark, tmp_path, monkeypatch):
    """Many sessions are few states, and each is judged by its own events, also in a bucket with others and over batches."""
    monkeypatch.setattr(ST, "SESSION_BUCKETS", 4)
    kinds = "event_id bigint, shop_id string, session_token string, ts string, kind string, term string, product_id string, order_id string"
    for n in range(2):
        day = f"2024-01-0{n + 1}"
        rows = [(1000 * n + 10 * i + j, "s", f"t{i}", f"{day} 00:{10 * j:02d}:{i:02d}", what, f"w{i % 2}", None, None) for i in range(40) for j, what in enumerate(("search", "click", "click"))]
        spark.createDataFrame(rows, kinds).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9999, "~", "~", "2025-01-01 00:00:00", "search", "", None, None)], kinds).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made in (("clicks", ST.attribute_stream(stream(), "click", 1, same_term=True)), ("caps", ST.cap_events_stream(stream(), 2, 3600))):
        q = made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 5
        got = spark.read.schema(made.schema).parquet(str(tmp_path / name)).where("event_id < 9999").collect()
        if name == "clicks":
            assert {r.event_id: r.search_id for r in got} == {1000 * n + 10 * i + j: 1000 * n + 10 * i for n in range(2) for i in range(40) for j in (1, 2)}
        else:
            assert sorted(r.event_id for r in got) == sorted(1000 * n + 10 * i + j for n in range(2) for i in range(40) for j in (0, 1))
