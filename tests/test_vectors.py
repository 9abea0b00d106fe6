"""Blocked vector search and the neighbour index against brute force, on odd rows and large groups of copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallgrid.operators import recommend as R
from stallgrid.operators import vectors as V
from stallgrid.operators.skew import first_rows, join_by_share

SCHEMA = "shop_id string, product_id string, embedding array<double>, candidate boolean"


def nearest(rows, anchor, k, within=None):
    shop, own, v, _ = anchor
    a = np.array(v) / (np.linalg.norm(v) or 1)
    out = []
    for s, p, w, shown in rows:
        if s == shop and p != own and shown:
            d = 1 - float(a @ (np.array(w) / (np.linalg.norm(w) or 1)))
            if within is None or d < within:
                out.append((round(d, 6), p))
    return [p for _, p in sorted(out)[:k]]


def catalog(n=400, seed=1):
    """Two shops; a third of the first one has one vector, and a quarter of all products cannot be shown."""
    rng = random.Random(seed)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = []
    for i in range(n):
        v = same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]
        rows.append(("a" if i % 5 else "b", f"p{i:04d}", v, i % 4 != 3))
    return rows


def test_all_neighbours_are_exact_within_two_blocks(spark):
    rows = catalog()
    odd = [("a", "null", None, True), ("a", "nan", [float("nan")] * 8, True), ("a", "short", [1.0], True), ("c", "alone", [1.0] * 8, True), ("a", "hole", [1.0] * 7 + [None], True)]
    got = {}
    for r in V.neighbours(spark.createDataFrame(rows + odd, SCHEMA), 6).orderBy("anchor_id", "rank").collect():
        got.setdefault(r.anchor_id, []).append(r.product_id)
    assert got == {r[1]: nearest(rows, r, 6) for r in rows}
    assert V.neighbours(spark.createDataFrame([], SCHEMA), 6).count() == 0


def test_recall_of_small_blocks(spark):
    """Blocks far smaller than the shop: three blocks of 64 of 3,000 vectors a table, in clusters as vectors of products are."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.35 * rng.standard_normal((3000, 16))
    rows = [("a", f"p{i}", v.tolist(), True) for i, v in enumerate(x)]
    found = {}
    for r in V.neighbours(spark.createDataFrame(rows, SCHEMA), 12, tables=12, block=64).collect():
        found.setdefault(r.anchor_id, set()).add(r.product_id)
    asked = rows[::50]
    assert np.mean([len(found[r[1]] & set(nearest(rows, r, 12))) / 12 for r in asked]) >= 0.9


def test_blocked_matches_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "PACKED", 17)
    rows = catalog(150)
    v = spark.createDataFrame(rows, SCHEMA)
    q = v.where("product_id LIKE '%1'").select(F.col("product_id").alias("query_id"), "shop_id", F.col("embedding").alias("query_vec"))
    q = q.unionByName(spark.createDataFrame([("x", "a", None), ("y", "none", [1.0] * 8), ("z", "a", [1.0])], q.schema))
    got = {}
    for r in V.blocked_matches(q, v, 0.9, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    every = [(*r[:3], True) for r in rows]
    want = {r[1]: nearest([*every, (r[0], "self", r[2], True)], (r[0], "self2", r[2], True), 6, 0.9) for r in rows if r[1].endswith("1")}
    assert got == {k: [p for p in v if p != "self"][:5] for k, v in want.items()}


def test_scope_of_a_request(spark):
    v = spark.createDataFrame([("a", "1", [1.0, 0.0], ["x"]), ("a", "2", [1.0, 0.1], ["y"]), ("a", "3", [1.0, 0.2], None)], "shop_id string, product_id string, embedding array<double>, collections array<string>")
    q = spark.createDataFrame([("q1", "a", [1.0, 0.0], "y"), ("q2", "a", [1.0, 0.0], None)], "query_id string, shop_id string, query_vec array<double>, collection string")
    got = sorted((r.query_id, r.product_id) for r in V.blocked_matches(q, v).collect())
    assert got == [("q1", "2"), ("q2", "1"), ("q2", "2"), ("q2", "3")]


def test_rail_falls_back_to_attributes(spark):
    p = spark.createDataFrame(
        [("s", str(i), "ACTIVE" if i != 4 else "DRAFT", True, i != 5, float(i), "type", "vendor", ["t"], ["c1"] if i % 2 else ["c2"]) for i in range(1, 8)] + [("lone", "9", "ACTIVE", True, True, 1.0, "type", "v2", [], [])],
        "shop_id string, product_id string, status string, published_online boolean, available boolean, popularity double, product_type string, vendor string, tags array<string>, collections array<string>",
    )
    v = spark.createDataFrame([("s", "1", [1.0, 0.0]), ("s", "2", [0.9, 0.1]), ("s", "5", [1.0, 0.0]), ("lone", "9", [1.0, 1.0]), ("s", "gone", [1.0, 1.0])], "shop_id string, product_id string, embedding array<double>")
    got = {}
    for r in R.related(p, v, 3).orderBy("anchor_id", "rank").collect():
        got.setdefault(r.anchor_id, (r.by, []))[1].append(r.product_id)
    # Sold out (5) and unpublished (4) products are anchors and are never shown.
    assert got["1"] == ("vectors", ["2"]) and got["2"] == ("vectors", ["1"]) and got["5"] == ("vectors", ["1", "2"])
    assert got["4"] == ("attributes", ["6", "2", "7"]) and got["3"] == ("attributes", ["7", "1", "6"]) and "9" not in got
    scoped = {(r.anchor_id, r.product_id, r.by) for r in R.related(p, v, 3, collection="c2").collect()}
    assert {x[1] for x in scoped} == {"2", "6"} and ("1", "2", "vectors") in scoped and ("2", "6", "attributes") in scoped


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_share(spark, how):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 300}", i) for i in range(600)] + [("none", 1)], "k string, i int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(300)], "k string, v int")
    assert sorted(map(tuple, join_by_share(rows, table, ["k"], 10, how).select("k", "i", "v").collect()), key=repr) == sorted(map(tuple, rows.join(table, "k", how).select("k", "i", "v").collect()), key=repr)
    first = first_rows(rows, 3, ["k"], F.asc("i"), spread="i", lanes=4)
    assert sorted(r.i for r in first.where("k = 'hot'").collect()) == [0, 1, 2]


def likened(a, b):
    """Weights of what two products share: collection 3, type 2, vendor 1, tag 1; empty and missing keys are no keys."""
    both = lambda x, y: bool((set(x or []) & set(y or [])) - {None, ""})
    return 3 * both(a[8], b[8]) + 2 * both([a[5]], [b[5]]) + both([a[6]], [b[6]]) + both(a[7], b[7])


RAIL_SCHEMA = "shop_id string, product_id string, status string, published_online boolean, available boolean, product_type string, vendor string, tags array<string>, collections array<string>, popularity double"


def test_related_attributes_meet_once_a_profile(spark):
    """Equal keys are one profile, in any order; anchors of it differ by leaving themselves out only."""
    rng = random.Random(3)
    keys = [("t1", "v1", ["x", "y"], ["c"]), ("t1", "v1", ["y", "x"], ["c"]), ("t2", None, None, ["c", "d"]), (None, "", [], []), ("", "v2", ["x", None, "x", ""], None), ("t2", "v3", ["z"], []), ("t9", "v9", ["w"], ["e"])]

    def catalog(n):
        own = [keys[rng.randrange(6)] if i else keys[6] for i in range(n)]
        return [(f"s{i % 2}", f"p{i}", "DRAFT" if i % 11 == 0 else "ACTIVE", True, i % 5 != 0, *own[i], float(rng.randrange(4))) for i in range(n)]

    rows = catalog(160)
    want = {}
    for a in rows:
        near = sorted((-likened(a, b), -b[9], b[1]) for b in rows if a[0] == b[0] and a[1] != b[1] and b[2] == "ACTIVE" and b[4] and likened(a, b))
        want |= {(a[1], n): (x[2], -x[0]) for n, x in enumerate(near[:4], 1)}
    got = R.related_attributes(spark.createDataFrame(rows, RAIL_SCHEMA), 4).collect()
    assert {(r.anchor_id, r["rank"]): (r.product_id, r.score) for r in got} == want and len(got) == len(want)

    def shuffled(n):
        store = spark.sparkContext._jsc.sc().statusStore()
        frame, before = spark.createDataFrame(catalog(n), RAIL_SCHEMA), store.executorSummary("driver").totalShuffleWrite()
        R.related_attributes(frame, 4).write.format("noop").mode("overwrite").save()
        return store.executorSummary("driver").totalShuffleWrite() - before

    # A product adds its own rows, and none for each combination of its keys.
    few, many = shuffled(2000), shuffled(8000)
    assert (many - few) / 6000 < 100


def test_rail_in_a_collection_works_products_out_once(spark):
    """Rows are those of every pair; the products behind them are made for one job that writes them, which reads its last stage twice."""
    rng = random.Random(5)
    rows = [("s", f"p{i:03d}", "ACTIVE", True, i % 5 != 0, f"t{rng.randrange(3)}", f"v{rng.randrange(4)}", [f"x{rng.randrange(5)}"], [f"c{rng.randrange(3)}"], float(rng.randrange(6))) for i in range(120)]
    vectors = [("s", r[1], [rng.gauss(0, 1) for _ in range(8)], r[4] and r[8] == ["c1"]) for r in rows[:40]]
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    p = spark.createDataFrame(rows, RAIL_SCHEMA).withColumn("product_id", counted("product_id"))
    got = {}
    for r in R.related(p, spark.createDataFrame(vectors, SCHEMA).drop("candidate"), 4, collection="c1").orderBy("anchor_id", "rank").collect():
        got.setdefault(r.anchor_id, []).append(r.product_id)
    want = {a[1]: nearest(vectors, a, 4) for a in vectors}
    for a in rows[40:]:
        want[a[1]] = [x[2] for x in sorted((-likened(a, b), -b[9], b[1]) for b in rows if a[1] != b[1] and b[4] and b[8] == ["c1"] and likened(a, b))[:4]]
    assert got == {k: v for k, v in want.items() if v}
    assert made.value <= 2 * len(rows)


def test_rails_and_neighbours_read_their_inputs_once(spark):
    """Vectors, anchors and comparisons of blocks are made for one job each, however many branches read them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    rows = catalog()
    found = V.neighbours(spark.createDataFrame(rows, SCHEMA).withColumn("product_id", counted("product_id")), 3)
    got = {}
    for r in found.orderBy("anchor_id", "rank").collect():
        got.setdefault(r.anchor_id, []).append(r.product_id)
    assert got == {r[1]: nearest(rows, r, 3) for r in rows}
    assert made.value <= len(rows)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()

    before = made.value
    p = [("s", f"p{i}", "ACTIVE", True, True, f"t{i % 3}", "v", [], [], float(i)) for i in range(100)]
    asked = [("s", f"a{i}", None, None, None, f"t{i % 4}", None, None, [None, ""], None) for i in range(50)]
    alike = R.related_attributes(spark.createDataFrame(p, RAIL_SCHEMA), 2, anchors=spark.createDataFrame(asked, RAIL_SCHEMA).withColumn("product_id", counted("product_id")))
    assert sorted((r.anchor_id, r["rank"], r.product_id) for r in alike.collect()) == sorted((f"a{i}", n, f"p{99 - (0, 2, 1)[i % 4] - 3 * (n - 1)}") for i in range(50) if i % 4 < 3 for n in (1, 2))
    assert made.value - before <= len(asked)
