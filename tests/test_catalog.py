import datetime
import json
import re

from pyspark.sql import functions as F

from stallgrid.functions import text as T
from stallgrid.operators import analytics as A
from stallgrid.operators import events as E
from stallgrid.operators import facets as FA
from stallgrid.operators import index as X
from stallgrid.operators import merge as M
from stallgrid.operators import prepare as P
from stallgrid.operators import recommend as R
from stallgrid.operators import search as S
from stallgrid.operators import sinks
from stallgrid.plans.fixtures import Tables
from stallgrid.plans.requests import _r, requests
from stallgrid.sources import catalog as C
from stallgrid.sources.store import read_store, write_store


def lines(spark, rows):
    return spark.createDataFrame([("s", json.dumps(r) if not isinstance(r, str) else r) for r in rows], "shop_id string, value string")


def test_export_is_order_free_and_skips_junk(spark):
    rows = [
        {"id": "gid://x/ProductVariant/11", "title": "Red", "sku": "A1", "price": "5", "availableForSale": True, "selectedOptions": [{"name": "Color", "value": "Red"}], "__parentId": "gid://x/Product/1"},
        {"id": "gid://x/Product/1", "title": "Hat", "tags": ["a"], "status": "ACTIVE"},
        {"namespace": "custom", "key": "m", "value": "wool", "type": "single_line_text_field", "__parentId": "gid://x/Product/1"},
        {"id": "gid://x/Collection/3", "handle": "sale", "__parentId": "gid://x/Product/1"},
        "junk", '{"id": "gid://x/Pro', {"id": "gid://x/ProductVariant/12", "sku": "Z", "__parentId": "gid://x/Product/9"},
    ]
    for order in (rows, rows[::-1]):
        groups, rejects = C.regroup_export(C.parse_export(lines(spark, order)))
        p = C.normalize_export(groups).collect()
        assert len(p) == 1 and p[0].product_id == "1" and p[0].available and p[0].skus == ["A1"] and p[0].collections == ["sale"]
        assert p[0].options == {"Color": ["Red"]} and p[0].metafields == {"custom.m": "wool", "m": "wool"} and p[0].price_min == 5.0
        assert [r.parent for r in rejects.collect()] == ["gid://x/Product/9"]


def test_payload(spark):
    rows = [
        {"id": 7, "title": "T", "tags": "a, b,", "status": "active", "published_at": None, "options": [{"name": "Size"}], "variants": [{"id": 1, "price": "0", "option1": "M", "inventory_management": "x", "inventory_quantity": 0, "inventory_policy": "deny"}]},
        {"id": 8, "title": "U", "tags": ["c"], "published_at": "2024-01-01T00:00:00Z", "variants": [{"id": 2, "price": "bad", "inventory_policy": "continue"}]},
        {"title": "no id"},
    ]
    p = {r.product_id: r for r in C.normalize_payload(lines(spark, rows)).collect()}
    assert set(p) == {"7", "8"}
    assert p["7"].tags == ["a", "b"] and not p["7"].published_online and not p["7"].available and p["7"].price_min == 0.0 and p["7"].status == "ACTIVE"
    assert p["8"].tags == ["c"] and p["8"].available and p["8"].price_min is None


def test_merge_masks(spark):
    cur = spark.createDataFrame([("s", "1", "old", ["c"], 5.0)], "shop_id string, product_id string, title string, collections array<string>, popularity double").withColumn("indexed_at", F.lit(None).cast("timestamp"))
    chg = spark.createDataFrame([("s", "1", "new", ["x"], 9.0), ("s", "2", "add", ["y"], 9.0)], "shop_id string, product_id string, title string, collections array<string>, popularity double")
    rows = {r.product_id: r for r in M.merge_products(cur, chg, "webhook", "2024-01-31").collect()}
    assert rows["1"].title == "new" and rows["1"].collections == ["c"] and rows["1"].popularity == 5.0
    assert rows["2"].collections == ["y"] and rows["2"].popularity is None
    assert {r.product_id: r.collections for r in M.merge_products(cur, chg, "bulk", "2024-01-31").collect()}["1"] == ["x"]


def test_sweep_keeps_shops_without_a_load(spark):
    p = spark.createDataFrame([("a", "1", "2024-01-01"), ("a", "2", "2024-01-20"), ("b", "3", "2024-01-01")], "shop_id string, product_id string, t string").withColumn("indexed_at", F.col("t").cast("timestamp"))
    assert {r.product_id for r in M.sweep_stale(p, "2024-01-10").collect()} == {"2", "3"}
    assert {r.product_id for r in M.sweep_stale(p, "2024-01-10", allow_empty=True).collect()} == {"2"}


def test_conditions_are_defensive(spark):
    raw = '[{"field":"tag","op":"eq","value":"x","action":"boost","weight":99},{"field":"tag","op":"eq","value":"x","action":"bury","weight":0},{"field":"tag","op":"zz","value":"x","action":"boost"},{"op":"eq"}]'
    got = spark.createDataFrame([(raw,)], "c string").select(P.parse_conditions(F.col("c")).alias("c")).first().c
    assert [(c.action, c.weight) for c in got] == [("boost", 20.0), ("bury", 5.0)]


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "s", "Red Tee"), (2, "s", "t-shirt"), (3, "s", "steel")], "query_id int, shop_id string, term string")
    syn = spark.createDataFrame([("s", "r1", "multiway", None, ["tee", "tshirt"]), ("s", "r2", "oneway", "red tee", ["crimson top"])], "shop_id string, rule_id string, type string, input string, terms array<string>")
    got = {}
    for r in P.expand_synonyms(q, syn).orderBy("query_id", "group_no").collect():
        got.setdefault(r.query_id, []).append(r.phrase)
    assert got == {1: ["red tee", "tee", "tshirt", "crimson top"], 2: ["t-shirt"], 3: ["steel"]}


def test_pages_join_to_the_full_ranking(spark, sf):
    p = Tables(spark, sf).products()
    one = [_r(1, "price_asc", per_page=48)] + [_r(1 + 4 * n, "price_asc", page=n, per_page=5) for n in range(1, 5)]
    q = requests(spark, one)
    hits = S.page(S.ranked(S.evaluated(q, p, S.candidates(q, p)))).orderBy("query_id", "rank").collect()
    full = [r.product_id for r in hits if r.query_id == 1]
    assert [r.product_id for r in hits if r.query_id != 1] == full[:20] and len(set(full)) == len(full)


def test_facet_one_pass_equals_one_query_each(spark, sf):
    p = Tables(spark, sf).products()
    f = {"vendor": ["Brand#1", "Brand#2"], "productType": ["ECONOMY"]}
    q = requests(spark, [_r(1, filters=f), _r(5, filters={"productType": f["productType"]}), _r(9, filters={"vendor": f["vendor"]})])
    rows = S.evaluated(q, p, S.candidates(q, p))
    got = {(r.query_id, r.source, r.value): r["count"] for r in FA.value_facets(rows).collect()}
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, "vendor")} == {k[2]: v for k, v in got.items() if k[:2] == (5, "vendor")}
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, "productType")} == {k[2]: v for k, v in got.items() if k[:2] == (9, "productType")}


def test_cover_density_against_brute_force(spark):
    import random

    random.seed(1)
    words = ["a", "b", "c", "x", "y"]
    docs = [(str(i), " ".join(random.choice(words) for _ in range(random.randint(1, 25)))) for i in range(60)]
    posts = [("s", w, i, "title", random.choice("ABC"), n + 1) for i, t in docs for n, w in enumerate(t.split())]
    postings = spark.createDataFrame(posts, "shop_id string, token string, product_id string, field string, weight string, pos int")
    terms = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "query_id int, group_no int, token string")
    q = spark.createDataFrame([(1, "s")], "query_id int, shop_id string")
    got = {r.product_id: r.text_rank for r in S.cover_density(terms, q, postings).collect()}
    w = {"A": 1.0, "B": 0.4, "C": 0.2}
    for i, _ in docs:
        e = sorted((p[5], p[1], w[p[4]]) for p in posts if p[2] == i and p[1] in "abc")
        total, last = 0.0, -1
        for k in range(len(e)):
            starts = [s for s in range(k + 1) if {"a", "b"} <= {x[1] for x in e[s : k + 1]} or "c" in {x[1] for x in e[s : k + 1]}]
            if starts and e[max(starts)][0] > last:
                cover = e[max(starts) : k + 1]
                last = cover[0][0]
                noise = cover[-1][0] - cover[0][0] - (len(cover) - 1)
                total += len(cover) / sum(1 / x[2] for x in cover) / (1 + noise)
        assert abs(got.get(i, 0.0) - total) < 1e-9, i


def test_repeat_collapse_fold(spark):
    times = [0, 50, 61, 100, 121, 122, 300]
    rows = spark.createDataFrame([(i, "s", "t", "w", t) for i, t in enumerate(times)], "event_id bigint, shop_id string, session_token string, term string, sec int").withColumn("ts", F.timestamp_seconds("sec"))
    assert sorted(times[r.event_id] for r in E.collapse_repeats(rows).collect()) == [0, 61, 122, 300]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=x", 'a"b'), ("y", None)], "a string, b string").repartition(3)
    sinks.write_csv(df, str(tmp_path / "out"))
    parts = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    assert len(parts) == 1
    head, *lines = parts[0].removesuffix(b"\r\n").split(b"\r\n")
    assert head == b'"a","b"' and sorted(lines) == [b'"\'=x","a""b"', b'"y",""']


def test_plans(spark):
    subs = spark.createDataFrame([("a", "Starter", "ACTIVE"), ("a", "growth plus", "ACTIVE"), ("b", "??", "ACTIVE"), ("c", "custom", "CANCELLED"), ("d", "starter", "ACTIVE")], "shop_id string, name string, status string")
    shops = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "custom"), ("e", None)], "shop_id string, plan_override string")
    assert {r.shop_id: r.plan for r in M.resolve_plans(subs, shops).collect()} == {"a": "growth", "b": "growth", "c": "free", "d": "custom", "e": "free"}


def test_plan_names_as_dashboards_spell_them(spark):
    want = {
        "Pro Plan": "pro", "PRO": "pro", "Pro (Annual)": "pro", "Growth plan - monthly": "growth", "  Custom  ": "custom", "Free": "free", "Free Plan": "free",
        "Enterprise Annual": "growth", "": "growth", "!!!": "growth", "free": "free", "growth": "growth", "pro": "pro", "custom": "custom",
    }
    subs = spark.createDataFrame([(n, n, "ACTIVE") for n in want] + [("gone", "Custom", "CANCELLED"), ("two", "Free", "ACTIVE"), ("two", "Odd", "ACTIVE")], "shop_id string, name string, status string")
    shops = subs.select("shop_id").distinct().unionByName(spark.createDataFrame([("bare",)], "shop_id string")).withColumn("plan_override", F.lit(None).cast("string"))
    got = {r.shop_id: r.plan for r in M.resolve_plans(subs, shops).collect()}
    assert got == want | {"gone": "free", "two": "growth", "bare": "free"}
    override = shops.where("shop_id = 'PRO'").withColumn("plan_override", F.explode(F.array(*map(F.lit, ("custom", "enterprise")))))
    assert sorted(r.plan for r in M.resolve_plans(subs, override).collect()) == ["custom", "pro"]


def test_plan_limits_and_days(spark):
    assert M.PLAN_PRODUCTS == {"free": 100, "growth": 5_000, "pro": None, "custom": None} and M.PLAN_DAYS == {"free": 7, "growth": 30, "pro": 90, "custom": 365}
    shops = spark.createDataFrame([("a", "growth", None), ("b", "pro", None), ("c", None, "custom"), ("d", "starter", "none"), ("e", None, None)], "shop_id string, plan_name string, plan_override string")
    days = lambda n: {r.shop_id: r.days for r in A.clamp_days(shops, n).collect()}
    assert days(1000) == days(0) == {"a": 30, "b": 90, "c": 365, "d": 7, "e": 7} and days(20) == {"a": 20, "b": 20, "c": 20, "d": 7, "e": 7}


def test_languages_one_by_one(spark):
    names = "simple english french german spanish italian portuguese dutch danish swedish norwegian finnish russian turkish hungarian".split()
    rows = spark.createDataFrame([(n.title() + " ",) for n in names] + [("romanian",), (None,)], "l string")
    assert [r[0] for r in rows.select(T.ts_config(F.col("l"))).collect()] == [*names, "simple", "simple"]


def test_metafields_by_type(spark):
    m = [("a", "n", "1", "weight"), ("b", "n", "2", "volume"), ("c", "n", "3", "dimension"), ("d", "n", "4", "date"), ("e", "n", "5", "url"), ("f", None, "6", None), ("g", "n", "", "color"), (None, "n", "8", "color"), ("a", "o", "9", "rating"), ("a", "n", "10", "color"), ("h", "n", "x" * 300, "boolean")]
    df = spark.createDataFrame([(m,)], "m array<struct<key:string,namespace:string,value:string,type:string>>")
    got = df.select(C.flatten_metafields(F.col("m"))).collect()[0][0]
    assert got == {"n.a": "10", "a": "1", "n.b": "2", "b": "2", "n.c": "3", "c": "3", "custom.f": "6", "f": "6", "o.a": "9", "n.h": "x" * 200, "h": "x" * 200}


def test_null_safe_conditions(spark):
    p = spark.createDataFrame([("1", {"m": "a"}), ("2", {"m": "b"}), ("3", {})], "product_id string, metafields map<string,string>")
    hide = lambda op: P.parse_conditions(F.lit(json.dumps([{"field": "metafield:m", "op": op, "value": "a", "action": "hide"}])))
    rows = p.withColumns({"tags": F.array(F.lit("t")), "vendor": F.lit("v"), "product_type": F.lit("t"), "collections": F.array(F.lit("c")), "available": F.lit(True), "options": F.create_map(F.lit("o"), F.array(F.lit("x")))})
    left = lambda op, safe: [r.product_id for r in rows.where(S.not_hidden(hide(op), safe)).orderBy("product_id").collect()]
    assert left("eq", False) == ["2"] and left("eq", True) == ["2", "3"] and left("neq", False) == ["1"] and left("neq", True) == ["1"]


def test_lenient_synonyms(spark):
    q = spark.createDataFrame([(1, "s", "red T-Shirt"), (2, "s", "t shirt"), (3, "s", "shirt t")], "query_id int, shop_id string, term string")
    syn = spark.createDataFrame([("s", "r1", "oneway", "t-shirt", ["tee"])], "shop_id string, rule_id string, type string, input string, terms array<string>")
    added = lambda **k: sorted(r.query_id for r in P.expand_synonyms(q, syn, **k).where("phrase = 'tee'").collect())
    assert added() == [] and added(lenient=True) == [1, 2]


def test_revenue_of_two_orders(spark):
    at = lambda h: datetime.datetime(2024, 1, 5, h)
    rows = [(1, at(9), "search", None, 0.0), (2, at(10), "purchase", "o9", 5.0), (3, at(11), "purchase", "o1", 7.0), (4, at(12), "purchase", "o9", 5.0)]
    a = spark.createDataFrame([(*r, "s", "st", "t", "p", 1) for r in rows], "event_id bigint, ts timestamp, kind string, order_id string, revenue double, shop_id string, session_token string, term string, product_id string, results_count int")
    one = lambda **k: E.attributed_searches(a, **k).collect()[0]
    assert (one().revenue, one().order_id) == (12.0, "o9") and (one(overwrite=True).revenue, one(overwrite=True).order_id) == (7.0, "o1")


def test_store_reads_its_folders(spark, sf, tmp_path):
    write_store(Tables(spark, sf).actions(), str(tmp_path / "store"), "ts")
    rows = read_store(spark, str(tmp_path / "store"), ["shop1"], "2024-01-10 12:00:00", "2024-01-12 12:00:00")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters")[1] and "part#" in plan.split("PartitionFilters")[1]
    want = Tables(spark, sf).actions().where("shop_id = 'shop1' AND ts >= '2024-01-10 12:00:00' AND ts <= '2024-01-12 12:00:00'")
    assert sorted(r.event_id for r in rows.collect()) == sorted(r.event_id for r in want.collect())
    assert read_store(spark, str(tmp_path / "store"), []).count() == 0


def test_a_batch_that_fails_stays_pending(spark):
    p = spark.createDataFrame([(str(i), "bad" if i == 3 else f"t{i}") for i in range(6)], "product_id string, title string").withColumns({"shop_id": F.lit("s"), "product_type": F.lit(""), "vendor": F.lit("v"), "tags": F.array(F.lit("x")), "description": F.lit("")})

    def fn(texts):
        if any(t.startswith("bad") for t in texts):
            raise RuntimeError("provider")
        return [[float(len(t))] for t in texts]

    got = X.embed(p.coalesce(1), fn, batch=2).collect()
    assert sorted(r.product_id for r in got) == ["0", "1", "4", "5"] and all(len(r.content_hash) == 64 for r in got)
    later = p.join(spark.createDataFrame(got).select("product_id", "content_hash"), "product_id", "left")
    assert sorted(r.product_id for r in X.pending_embeddings(later).collect()) == ["2", "3"]


def test_personalized_whole(spark):
    """Settled by the front or by ready lists, every session gets what scoring all pairs gives; a session that saw nothing known gets bestsellers."""
    import random

    random.seed(5)
    rows = [("s", str(i), "ACTIVE", True, i % 5 > 0, None, float(random.randrange(9)), random.choice(["t1", "t2", "", None]), random.choice(["v1", "v2", "v3"]), random.sample(["a", "b", "c", "d"], 2), random.sample(["x", "y", "z"], i % 3)) for i in range(160)]
    p = spark.createDataFrame(rows, "shop_id string, product_id string, status string, published_online boolean, available boolean, published_at timestamp, popularity double, product_type string, vendor string, tags array<string>, collections array<string>")
    seen = {f"k{n}": random.sample(range(160), n % 7 + 1) for n in range(25)}
    table = spark.createDataFrame([("s", k, str(i)) for k, ids in seen.items() for i in ids] + [("s", "none", "999")], "shop_id string, session_token string, product_id string")
    kinds = lambda r: (set(r[10]), {r[7]} - {"", None}, {r[8]}, set(r[9]))
    want = {}
    for k, ids in seen.items():
        mine = [set().union(*(kinds(rows[i])[n] for i in ids)) for n in range(4)]
        score = {r[1]: sum(w for w, a, b in zip((3, 2, 1, 1), mine, kinds(r), strict=True) if a & b) for r in rows if r[4] and int(r[1]) not in ids}
        want[k] = [(i, score[i]) for i in sorted((i for i in score if score[i]), key=lambda i: (-score[i], -rows[int(i)][6], i))[:4]]
    for front in (1, 20, 512):
        got = {}
        for r in R.personalized(table, p, 4, front=front).orderBy("rank").collect():
            got.setdefault(r.session_token, []).append((r.product_id, r.score))
        assert [x for _, x in got.pop("none")] == [0] * 4
        assert got == want


def test_export_lines_parsed_once(spark):
    """One parse of a line in the plan; rejects are counted without lists, equal handles once, and a line that is no object is skipped."""
    rows = ['{"id": "g/Product/1"}', "no json", "[1]", '{"id": "g/ProductVariant/1", "__parentId": "g/Product/2"}', '{"key": "k", "__parentId": "g/Product/2"}'] + ['{"id": "g/Collection/%d", "handle": "h%d", "__parentId": "g/Product/2"}' % (i, i % 2) for i in range(4)] + ['{"id": "g/Collection/9", "__parentId": "g/Product/2"}', None]
    lines = spark.createDataFrame([("s", r) for r in rows], "shop_id string, value string").repartition(3)
    parsed = C.parse_export(lines)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    good, rejects = C.regroup_export(parsed)
    assert [tuple(r) for r in rejects.collect()] == [("s", "g/Product/2", 1, 1, 2)]
    assert "collect_list" not in rejects._jdf.queryExecution().optimizedPlan().toString()
    assert [r.parent for r in good.collect()] == ["g/Product/1"]


def test_name_suggestions_pair_distinct_rows(spark, monkeypatch):
    """Equal terms and equal titles meet once: each title stands with its first items, and every request gets the same best."""
    names = spark.createDataFrame([("s", f"{i:03d}", f"Red widget{' new' if i % 2 else ''}") for i in range(60)], "shop_id string, item_id string, title string")
    q = spark.createDataFrame([(str(i), "s", "red  WIDGET", True) for i in range(5)], "query_id string, shop_id string, term string, typo_tolerance boolean")
    asked, plain = [], R.title_similarity
    monkeypatch.setattr(R, "title_similarity", lambda terms, grams: asked.append(terms.count()) or plain(terms, grams))
    got = {}
    for r in R.name_suggestions(q, names).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {str(i): ["000", "002", "004", "006"] for i in range(5)} and asked == [1]


def test_export_files_hold_each_shops_lines(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", f"line {i}") for i in range(30)], "shop_id string, value string")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    C.write_export(rows.repartition(2), str(tmp_path / "export"))
    assert spark.conf.get(name) == before
    for i in range(3):
        assert {r.value for r in spark.read.text(str(tmp_path / "export" / f"shop_id=s{i}")).collect()} == {f"line {n}" for n in range(i, 30, 3)}


def test_name_suggestions_broadcast_no_exploded_titles(spark):
    """Titles that are small enough to be broadcast have stretches and trigrams that are not."""
    names = spark.createDataFrame([("s", f"{i:03d}", f"Red widget number {i}") for i in range(60)], "shop_id string, item_id string, title string")
    q = names.select(F.col("item_id").alias("query_id"), "shop_id", F.left("title", F.lit(9)).alias("term"), F.lit(True).alias("typo_tolerance"))
    found = R.name_suggestions(q, names)
    assert found.count() == 240
    found.collect()
    joins = re.findall(r"(\w+Join) \[shop_id#\d+, gram#\d+\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_title_similarity_counts_every_pair_once(spark):
    """Rarest trigrams first, or in any order: the pairs and values of brute force, with no shuffle of pairs."""
    words = ["red", "wid-get", "é", "a", "ab", "Ring", "  x", "c3", "ring", "--", "redder", "a/b", "widge", "ñandú"]
    titles = {" ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 5)) for i in range(70)}
    names = spark.createDataFrame([("s", f"{i}", t) for i, t in enumerate(sorted(titles))], "shop_id string, product_id string, title string")
    grams = X.title_grams(X.product_titles(names)).cache()
    q = names.select(F.col("product_id").alias("query_id"), "shop_id", F.left("title", F.lit(9)).alias("term"))
    have = {r.folded_title: set(r.g) for r in grams.groupBy("folded_title").agg(F.collect_set("gram").alias("g")).collect()}
    asked = {r.query_id: set(r.g) for r in q.select("query_id", T.trigrams(T.normalize_query(F.col("term"))).alias("g")).collect()}
    for above in (0.2, 0.3):
        want = {(i, t): len(g & h) / len(g | h) for i, g in asked.items() for t, h in have.items() if g and len(g & h) / len(g | h) > above}
        for terms in (q, S.rarest_first(q, grams)):
            sims = S.title_similarity(terms, grams, above)
            rows = sims.collect()
            assert {(r.query_id, r.folded_title): r.sim for r in rows} == want and len(rows) == len(want) > 100
    plain = S.title_similarity(q, grams)
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
