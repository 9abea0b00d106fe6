"""The stream of catalog changes against a simulation that takes the events one by one in the order of their times."""

import datetime
import json
import random
import time

from pyspark.sql import functions as F

from stallgrid.streaming import changes as CH

PRODUCT = "shop_id string, product_id string, title string, status string, published_online boolean, tags array<string>, collections array<string>, metafields map<string,string>, popularity double, indexed_at timestamp"
COLLECTION = "shop_id string, collection_id string, handle string, title string, product_count bigint"
ENVELOPE = "topic string, shop_id string, at timestamp, value string"
T0 = datetime.datetime(2024, 1, 1)


def simulate(products, collections, events):
    p, c = {r[:2]: {"title": r[2], "tags": r[5], "collections": list(r[6]), "popularity": r[8]} for r in products}, {r[:2]: [r[2], r[3]] for r in collections}
    for topic, shop, _, value in sorted(events, key=lambda e: e[2]):
        x = json.loads(value)
        k = (shop, str(x["id"]))
        if topic == "products/delete" or (topic == "products/upsert" and (x["status"] != "active" or not x["published_at"])):
            p.pop(k, None)
        elif topic == "products/upsert":
            old = p.get(k, {"collections": [], "popularity": None})
            p[k] = {**old, "title": x["title"], "tags": x["tags"].split(",") if x["tags"] else []}
        elif topic == "collections/upsert":
            c[k] = [x["handle"], x["title"]]
            for (s, i), row in p.items():
                if s == shop and i in x["members"]:
                    row["collections"] = [*[h for h in row["collections"] if h != x["handle"]], x["handle"]]
                elif s == shop and x["complete"]:
                    row["collections"] = [h for h in row["collections"] if h != x["handle"]]
        elif topic == "collections/delete" and k in c:
            handle = c.pop(k)[0]
            for (s, _i), row in p.items():
                if s == shop:
                    row["collections"] = [h for h in row["collections"] if h != handle]
    return {k: (v["title"], tuple(v["tags"]), frozenset(v["collections"]), v["popularity"]) for k, v in p.items()}, {k: tuple(v) for k, v in c.items()}


def state(spark, folder):
    p = {(r.shop_id, r.product_id): (r.title, tuple(r.tags), frozenset(r.collections or []), r.popularity) for r in CH.current_products(spark, folder).collect()}
    c = {(r.shop_id, r.collection_id): (r.handle, r.title) for r in CH.current_collections(spark, folder).collect()}
    return p, c


def random_events(rng, n, begin):
    out, times = [], rng.sample(range(begin, begin + 10 * n), n)
    for t in times:
        shop, at = rng.choice("ab"), T0 + datetime.timedelta(minutes=t)
        kind = rng.choice(["products/upsert"] * 4 + ["products/delete", "collections/upsert", "collections/upsert", "collections/delete", "other/topic"])
        if kind == "products/upsert":
            x = {"id": rng.randrange(8), "title": f"t{t}", "tags": rng.choice(["", "x,y"]), "status": rng.choice(["active"] * 4 + ["draft"]), "published_at": rng.choice(["2024-01-01T00:00:00Z"] * 4 + [None]), "updated_at": at.isoformat() + "Z"}
            at += datetime.timedelta(days=3)  # it came late; its own time counts
        elif kind.startswith("collections"):
            i = rng.randrange(3)
            x = {"id": i, "handle": f"c{i}", "title": f"C{t}", "members": [str(m) for m in rng.sample(range(8), 3)], "complete": rng.random() < 0.5}
        else:
            x = {"id": rng.randrange(8)}
        out.append((kind, shop, at, json.dumps(x)))
    return out


def own_time(e):
    at = json.loads(e[3]).get("updated_at")
    return (*e[:2], datetime.datetime.fromisoformat(at[:-1]) if at else e[2], e[3])


def test_random_changes_equal_a_simulation(spark, tmp_path):
    rng = random.Random(12)
    products = [(s, str(i), f"old{i}", "ACTIVE", True, ["t"], [f"c{i % 3}"], {}, float(i), T0) for s in "ab" for i in range(5)]
    collections = [(s, str(i), f"c{i}", "old", 1) for s in "ab" for i in range(3)]
    folder = str(tmp_path / "catalog")
    CH.start_changes(spark.createDataFrame(products, PRODUCT), spark.createDataFrame(collections, COLLECTION), folder)
    every = random_events(rng, 45, 1)
    rng.shuffle(every)  # batches are in no order of time
    for number in (1, 2, 3):
        batch = spark.createDataFrame(every[(number - 1) * 15 : number * 15], ENVELOPE)
        for _ in range(2):  # a repeated batch replaces itself
            CH.append_changes(folder, number, CH.parse_events(batch))
        want = simulate(products, collections, map(own_time, every[: number * 15]))
        assert state(spark, folder) == want
    CH.compact_changes(spark, folder, 4)
    assert state(spark, folder) == want
    later = random_events(rng, 10, 5000)
    CH.append_changes(folder, 5, CH.parse_events(spark.createDataFrame(later + [("products/upsert", "a", T0, json.dumps({"id": 1, "title": "too old", "tags": "", "status": "active", "published_at": "2024-01-01T00:00:00Z", "updated_at": "2023-01-01T00:00:00Z"}))], ENVELOPE)))
    late = state(spark, folder)
    assert late == simulate(products, collections, map(own_time, every + later))


def test_stream_of_all_topics_writes_what_changed(spark, tmp_path):
    products = [("a", str(i), f"old{i}", "ACTIVE", True, ["t"], ["c0"], {}, 1.0, T0) for i in range(500)]
    folder = str(tmp_path / "catalog")
    CH.start_changes(spark.createDataFrame(products, PRODUCT), spark.createDataFrame([("a", "0", "c0", "old", 500)], COLLECTION), folder)
    live = {"tags": "", "status": "active", "published_at": "2024-01-01T00:00:00Z"}
    files = [
        [("products/upsert", "a", T0, json.dumps(live | {"id": 1, "title": "newer", "updated_at": "2024-02-02T00:00:00Z"})), ("collections/delete", "a", T0, json.dumps({"id": 0}))],
        [("products/upsert", "a", T0, json.dumps(live | {"id": 1, "title": "older", "updated_at": "2024-02-01T00:00:00Z"})), ("products/delete", "a", T0, json.dumps({"id": "gid://x/Product/2"}))],
    ]
    for rows in files:
        spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    raw = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    CH.change_stream(raw, folder).awaitTermination()
    p = {r.product_id: r for r in CH.current_products(spark, folder).collect()}
    assert len(p) == 499 and "2" not in p and p["1"].title == "newer" and not p["5"].collections and CH.current_collections(spark, folder).count() == 0
    size = lambda d: sum(f.stat().st_size for f in d.rglob("*.parquet"))
    rows = lambda t: spark.read.parquet(f"{folder}/events/{t}").count()
    assert rows("products") == 3 and rows("collections") == 1 and size(tmp_path / "catalog" / "events") > 0
    assert spark.read.parquet(f"{folder}/base/products").where(F.col("number") > 0).count() == 0  # the base was not rewritten
