"""The stored index: equal to a rebuild behind random batches, and read in part."""

import random
import re

from pyspark.sql import functions as F

from stallgrid import registry
from stallgrid.operators import index as X
from stallgrid.operators import prepare as P
from stallgrid.operators import search as S
from stallgrid.operators import stored as ST
from stallgrid.plans.fixtures import AS_OF, Tables
from stallgrid.plans.requests import TEXT, requests


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(c for c in df.columns if c not in ("part", "bucket"))).collect()))


def rebuilt(p):
    shown = S.eligible(p)
    i = X.index_tables(shown)
    return {"postings": i.postings, "titles": i.titles, "stretches": i.stretches, "grams": i.grams, "skus": i.skus, "facets": X.facet_values(shown)}


def same(spark, folder, p, compacted):
    got, want = ST.read_index(spark, folder), rebuilt(p)
    for table in ST.KEYS:
        left = got[table]
        if table in ("stretches", "grams") and not compacted:
            # Grams of titles that are gone stay until the index is compacted; no product leads to them.
            left = left.join(got["titles"].select("shop_id", "folded_title").distinct(), ["shop_id", "folded_title"], "left_semi")
        assert rows_of(left) == rows_of(want[table]), table


def test_random_batches_equal_a_rebuild(spark, sf, tmp_path):
    rng = random.Random(2)
    base = Tables(spark, sf).products().where("product_id % 4 = 0")
    rows = {(r.shop_id, r.product_id): r.asDict(recursive=True) for r in base.collect()}
    frame = lambda rs: spark.createDataFrame(rs, base.schema)
    folder = str(tmp_path / "index")
    ST.write_index(frame(list(rows.values())), folder)
    for number in (1, 2, 3):
        keys = rng.sample(sorted(rows), 12)
        changes = [rows[k] | {"title": rng.choice(["red hot", "Éclair", "a", rows[k]["title"]]), "status": rng.choice(["ACTIVE", "ACTIVE", "DRAFT"]), "tags": rng.choice([["x"], [], ["x", "y"]])} for k in keys]
        new = [changes[0] | {"product_id": f"new{number}", "title": "brand new"}]
        gone = rng.sample(sorted(rows), 5)
        for r in changes + new:
            rows[r["shop_id"], r["product_id"]] = r
        for k in gone:
            rows.pop(k)
        for _ in range(2):  # a repeated batch replaces itself
            ST.update_index(folder, number, frame(changes + new), spark.createDataFrame(gone, "shop_id string, product_id string"))
        same(spark, folder, frame(list(rows.values())), False)
    ST.compact_index(spark, folder, 4)
    same(spark, folder, frame(list(rows.values())), True)
    ST.update_index(folder, 5, frame(list(rows.values())[:3]).withColumn("title", F.lit("after")))
    assert ST.read_index(spark, folder)["titles"].where("folded_title = 'after'").count() == sum(1 for r in list(rows.values())[:3] if r["status"] == "ACTIVE" and r["published_online"])


def test_text_requests_read_their_folders_only(spark, sf, tmp_path):
    p = Tables(spark, sf).products()
    folder = str(tmp_path / "index")
    ST.write_index(p, folder)
    index = ST.stored_index(spark, folder)
    q = requests(spark, TEXT)
    rows = S.text_candidates(q, index)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan parquet" in line and "bucket#" in line and any(f"{c}#" in line for c in ("token", "gram", "sku_lower"))]
    assert len(reads) >= 4 and all("dynamicpruning" in line for line in reads), "\n".join(line[:300] for line in reads if "dynamicpruning" not in line)
    made = S.text_candidates(q, X.index_tables(S.eligible(p)))
    assert rows_of(rows.withColumn("text_rank", F.round("text_rank", 9))) == rows_of(made.withColumn("text_rank", F.round("text_rank", 9)))


def test_browsing_reads_no_index(spark, sf):
    q, p = requests(spark), Tables(spark, sf).products()
    plan = S.page(S.ranked(S.evaluated(q, p, S.browse_candidates(q, p))))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("Exchange ") < 20
    found = S.search(q, p, AS_OF)
    assert found.hits.count() > 0 and "posexplode" not in found.hits._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_an_empty_table_of_requests(spark, sf):
    found = S.search(requests(spark).limit(0), Tables(spark, sf).products(), AS_OF)
    assert found.hits.count() == found.totals.count() == found.suggestions.count() == 0


def test_an_index_works_its_products_out_once(spark, sf, tmp_path):
    p = Tables(spark, sf).products().limit(40)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ST.write_index(p.mapInArrow(counted, p.schema), str(tmp_path / "index"))
    assert seen.value == 40


def test_postings_of_a_product_are_put_together_where_they_lie(spark, sf):
    plan = registry.QUERIES["postings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan
    p = Tables(spark, sf).products()
    lists = p.sparkSession.createDataFrame(X.posting_lists(p).collect(), X.posting_lists(p).schema)
    of_lists = lists.select("shop_id", "product_id", F.posexplode("postings").alias("n", "x")).select("shop_id", "product_id", "x.*", (F.col("n") + 1).alias("pos"))
    assert rows_of(of_lists) == rows_of(X.build_postings(p))


def test_stems_of_any_number_leave_the_same_words(spark, monkeypatch):
    words = spark.createDataFrame([("en", w, f, i) for i, (w, f) in enumerate([("plate", "title"), ("plate", "skus"), ("ring", "title")])], "lang string, token string, field string, pos int")
    stems = spark.createDataFrame([("en", "plate", "plat"), ("fr", "ring", "rin")], "lang string, token string, stem string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = X.apply_stems(words, stems)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(X, "SMALL", 1)
        many = X.apply_stems(words, stems)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert rows_of(few) == rows_of(many) and {r.token for r in few.collect()} == {"plat", "plate", "ring"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_postings_are_not_shuffled_to_meet_few_requests(spark, sf):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = requests(spark, TEXT)
        terms = P.query_terms(P.plain_terms(q))
        plan = S.cover_density(terms, q, X.build_postings(S.eligible(Tables(spark, sf).products())))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [shop_id" in plan


def test_stems_of_a_large_dictionary_leave_words_where_they_are(spark, monkeypatch):
    """The same lists and postings with a dictionary of any size; with a large one no word is shuffled that it does not have."""
    text = ["plate ring red plate", "", "ring", "the plate of é ring 9 ring", "nothing here", None]
    rows = [("s", f"{i}", ("en", "fr", "en", "de")[i % 4], t, [f"plate-{i}", "ring"], f"{t} plate, red") for i, t in enumerate(text * 3)]
    products = spark.createDataFrame(rows, "shop_id string, product_id string, lang string, title string, skus array<string>, description string")
    stems = spark.createDataFrame([("en", "plate", "plat"), ("fr", "ring", "rin"), ("fr", "plate", "p"), ("en", "red", None), ("en", "here", "")], "lang string, token string, stem string")
    got = []
    for size in (500, 2):
        monkeypatch.setattr(X, "SMALL", size)
        lists = X.stemmed_lists(products, stems)
        have = {r.product_id: [tuple(x) for x in r.postings] for r in lists.collect() if r.postings}
        flat = {(r.product_id, r.pos, r.token, r.field, r.weight) for r in X.build_postings(products, stems).collect()}
        assert flat == {(i, *x) for i, xs in have.items() for x in xs}
        got.append(have)
    assert got[0] == got[1] and len(have) == 18
    assert [x[1] for x in have["0"]][:4] == ["plat", "ring", "red", "plat"] and ("plate", "skus") in {x[1:3] for x in have["0"]}
    # The dictionary meets words that went through the filter, and no word comes back to its product one by one.
    plan = X.build_postings(products, stems)._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" in plan and re.search(r"Join LeftOuter, .*_a#", plan) and not re.search(r"Join LeftOuter, .*token#", plan)


def test_the_filter_of_a_dictionary_leaves_out_no_word_of_it(spark, monkeypatch):
    monkeypatch.setattr(X, "SLOTS", 64)
    words = spark.range(400).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"))
    columns, marks = X._filter_of(words.where("token < 'w2'"))
    left = {r.token for r in words.withColumns(columns).join(marks, "slot").where("bits & mask = mask").collect()}
    own = {r.token for r in words.where("token < 'w2'").collect()}
    assert own <= left and len(left) < 400
