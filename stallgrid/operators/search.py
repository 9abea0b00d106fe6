"""Batch search: a table of requests against the catalog's index tables.

requests: query_id, shop_id, term, page, per_page, sort, filters map<string,array<string>>, price_min, price_max,
collection, include_unavailable, typo_tolerance, bucket; query_vec for semantic matches, lang for stems.

Candidates come from equi-joins (tokens, trigrams, SKUs, for browsing the shop); every request's predicates are
evaluated once per candidate, and hits, totals and facets are read off the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.functions.text import fold_accents, looks_like_sku, normalize_query, trigrams, ts_config, word_sim
from stallgrid.operators.index import SMALL, WEIGHTS, Index, apply_stems, index_tables, meet
from stallgrid.operators.prepare import apply_redirects, boolean_query, expand_synonyms, match_rules, plain_terms, query_terms
from stallgrid.operators.scratch import written
from stallgrid.operators.vectors import blocked_matches

# Sorts, limits of similarity and distance, deepest page and largest page.
SORTS = ("relevance", "price_asc", "price_desc", "title_asc", "title_desc", "newest", "bestselling")
FUZZY, SEMANTIC, SPELLING = 0.2, 0.62, 0.3
MAX_PAGE, MAX_PER_PAGE = 200, 48


def eligible(products: DataFrame) -> DataFrame:
    """Products that may be shown; availability stays a column, since the facet on it needs both sides."""
    return products.where((F.col("status") == "ACTIVE") & F.col("published_online"))


# ---- matches: (query_id, shop_id, product_id, how) ----


def match_fulltext(terms: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Products that hold all tokens of at least one group."""
    need = terms.groupBy("query_id", "group_no").agg(F.count("*").alias("need"))
    t = terms.join(queries.select("query_id", "shop_id"), "query_id")
    hits = meet(t, postings, "token").select("query_id", "shop_id", "group_no", "token", "product_id").distinct().groupBy("query_id", "shop_id", "group_no", "product_id").agg(F.count("*").alias("got"))
    return hits.join(need, ["query_id", "group_no"]).where("got = need").select("query_id", "shop_id", "product_id").distinct()


def match_substring(queries: DataFrame, titles: DataFrame, grams: DataFrame, spread: bool = True) -> DataFrame:
    """Products whose folded title holds the term. ``titles`` and ``grams`` are those of an index (``title_stretches``).

    Distinct titles are found by the term's last three characters, or by the whole of a shorter term, then tested, then
    spread to their products, unless ``spread`` is off.
    """
    q = queries.select("query_id", "shop_id", normalize_query(F.col("term")).alias("norm")).where("norm <> ''").withColumn("gram", F.right("norm", F.lit(3)))
    hit = meet(q, grams, "gram").where(F.col("folded_title").contains(F.col("norm"))).select("query_id", "shop_id", "folded_title")
    if not spread:
        return hit
    return meet(hit, titles, "folded_title").select("query_id", "shop_id", "product_id")


def match_sku(queries: DataFrame, skus: DataFrame) -> DataFrame:
    q = queries.where(looks_like_sku(F.col("term"))).select("query_id", "shop_id", F.lower(F.trim("term")).alias("sku_lower"))
    return meet(q, skus, "sku_lower").select("query_id", "shop_id", "product_id").distinct()


def rarest_first(queries: DataFrame, grams: DataFrame) -> DataFrame:
    """``queries`` with ``grams``: the trigrams of their terms, those that the fewest titles of ``grams`` hold in front."""
    found = grams.groupBy("shop_id", "gram").agg(F.count("*").alias("_n"))
    own = queries.select("query_id", "shop_id", F.explode(trigrams(normalize_query(F.col("term")))).alias("gram"))
    # Trigrams of terms look as small as the terms to the planner: a hint keeps them from being broadcast.
    ordered = own.join(found.hint("merge"), ["shop_id", "gram"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram"))).alias("x"))
    return queries.join(ordered.select("query_id", F.col("x.gram").alias("grams")), "query_id", "left")


def title_similarity(queries: DataFrame, grams: DataFrame, above: float = FUZZY) -> DataFrame:
    """query_id, shop_id, folded_title, sim for titles with more than ``above`` trigram similarity to the term.

    ``grams`` are the trigrams of distinct titles (``title_grams``). A term's trigrams have an order: that of its column
    ``grams`` (``rarest_first``), or any. A pair counts where the first of them meets that the title holds, and only if
    those behind it can still be enough; there all are looked up in the title, so no pair is shuffled.
    """
    given = ["grams"] if "grams" in queries.columns else []
    q = queries.select("query_id", "shop_id", normalize_query(F.col("term")).alias("norm"), *given).where("norm <> ''").withColumn("g", F.col("grams") if given else trigrams(F.col("norm")))
    q = q.select("query_id", "shop_id", "g", F.size("g").alias("nq"), F.posexplode("g").alias("at", "gram"))
    enough = (1 + above) * (F.col("nq") - F.col("at")) > above * (F.col("nq") + F.col("n_grams")) - 1e-9
    pairs = meet(q, grams, "gram").where((F.col("n_grams") > above * F.col("nq")) & enough)
    # Words padded as for their trigrams, so that a trigram is one of the title's if it stands in this text. As a row of a generator, so that it is made once.
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower("folded_title"), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    held = F.explode(F.transform(F.array(padded), lambda t: F.filter("g", lambda x: F.contains(t, x))))
    both = pairs.select("query_id", "shop_id", "folded_title", "nq", "n_grams", "gram", held.alias("held")).where(F.get("held", F.lit(0)) == F.col("gram"))
    n = F.size("held")
    return both.withColumn("sim", n / (F.col("nq") + F.col("n_grams") - n)).where(F.col("sim") > above).select("query_id", "shop_id", "folded_title", "sim")


def match_fuzzy(queries: DataFrame, titles: DataFrame, grams: DataFrame) -> DataFrame:
    sims = title_similarity(queries.where("typo_tolerance"), grams)
    return meet(sims, titles, "folded_title").select("query_id", "shop_id", "product_id", "sim")


def match_semantic(queries: DataFrame, vectors: DataFrame, above: float = SEMANTIC) -> DataFrame:
    """query_id, product_id, dist: vectors nearer than ``above`` to the request's; a request without a vector matches nothing.

    Vectors and requests meet in blocks, as products of matrices. A request with a collection matches in it only, if
    the vectors have their products' collections.
    """
    return blocked_matches(queries.where("query_vec IS NOT NULL"), vectors, above)


def cover_density(terms: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, product_id, text_rank: the sum over minimal covers of their weight by their noise.

    A cover is a shortest stretch that holds all tokens of a group. The fold over a product's matched positions
    keeps the last place of every token; a cover ends where its start moves on.
    """
    groups = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"), F.collect_list(F.struct("group_no", "token")).alias("gt"))
    member = F.transform(F.array_distinct(F.transform("gt", lambda x: x["group_no"])), lambda g: F.transform(F.filter("gt", lambda x: x["group_no"] == g), lambda x: F.array_position("tokens", x["token"])))
    groups = groups.select("query_id", "tokens", member.alias("groups"))
    t = terms.select("query_id", "token").distinct().join(queries.select("query_id", "shop_id"), "query_id")
    # Up to a bounded number of words of requests go to the postings, which are then not shuffled before they are met.
    t = F.broadcast(t) if t.limit(SMALL + 1).count() <= SMALL else t
    w = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(1 / v))]), F.col("weight"))
    hits = meet(t, postings, "token").groupBy("query_id", "product_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", w.alias("inv")))).alias("p")).join(groups, "query_id")
    none = F.lit(None).cast("struct<pos:int,n:int,inv:double>")
    state = F.struct(
        F.transform("tokens", lambda _: none).alias("last"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("inv"), F.lit(0.0).alias("rank")
    )

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["pos"].cast("int").alias("pos"), s["n"].alias("n"), s["inv"].alias("inv"))
        at = F.array_position(F.col("tokens"), x["token"])
        last = F.transform(s["last"], lambda v, i: F.when(i + 1 == at, here).otherwise(v))
        firsts = F.transform(F.col("groups"), lambda g: F.when(~F.exists(g, lambda i: F.element_at(last, i.cast("int")).isNull()), F.array_min(F.transform(g, lambda i: F.element_at(last, i.cast("int"))))))
        start = F.array_max(firsts)
        fresh = start.isNotNull() & (start["pos"] > s["start"])
        inv = s["inv"] + x["inv"]
        n = s["n"] + 1
        size = n - start["n"]
        noise = (x["pos"] - start["pos"]) - (size - 1)
        gain = size / (inv - start["inv"]) / (1 + F.when(noise < 0, (size - 1) / 2).otherwise(noise))
        return F.struct(last.alias("last"), F.when(fresh, start["pos"]).otherwise(s["start"]).alias("start"), n.alias("n"), inv.alias("inv"), (s["rank"] + F.when(fresh, gain).otherwise(0.0)).alias("rank"))

    return hits.select("query_id", "product_id", F.aggregate("p", state, step, lambda s: s["rank"]).alias("text_rank"))


# ---- candidates, filters, scores ----


_PARTS = {"fulltext": False, "sim": 0.0, "dist": 9.0, "sku": False, "text_rank": 0.0}


def _part(df: DataFrame, **given: Column) -> DataFrame:
    """query_id, product_id and the match parts, those that are not given as no match."""
    return df.select("query_id", "product_id", *[given.get(k, F.lit(v)).alias(k) for k, v in _PARTS.items()])


def _together(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    best = {"fulltext": F.max, "sim": F.max, "dist": F.min, "sku": F.max, "text_rank": F.max}
    return rows.groupBy("query_id", "product_id").agg(*[f(c).alias(c) for c, f in best.items()])


def browse_candidates(queries: DataFrame, products: DataFrame) -> DataFrame:
    """All products of the shop of each request without a term; no index is read."""
    q = queries.where(normalize_query(F.col("term")) == "")
    return _part(q.select("query_id", "shop_id").join(eligible(products).select("shop_id", "product_id"), "shop_id"))


def text_candidates(
    queries: DataFrame, index: Index, synonyms: DataFrame | None = None, vectors: DataFrame | None = None, stems: DataFrame | None = None, shops: DataFrame | None = None,
) -> DataFrame:
    """query_id, product_id and the match parts of every request with a term, from the tables of an index.

    A product that holds all tokens of a group has a cover, and so a rank over 0. With ``stems`` (lang, token, stem),
    of which the index is made, words are compared by their stems: those of a request in its ``lang``, or else in
    the language of its shop (``shops``: shop_id, search_language).
    """
    typed = with_language(queries, shops).where(normalize_query(F.col("term")) != "")
    terms = query_terms(expand_synonyms(typed, synonyms)) if synonyms is not None else query_terms(plain_terms(typed))
    if stems is not None:
        terms = apply_stems(terms.join(typed.select("query_id", "lang"), "query_id"), stems).drop("lang").distinct()
    ranks = cover_density(terms, typed, index.postings).where("text_rank > 0")
    parts = [
        _part(ranks, fulltext=F.lit(True), text_rank=F.col("text_rank")), _part(match_substring(typed, index.titles, index.stretches), fulltext=F.lit(True)),
        _part(match_sku(typed, index.skus), sku=F.lit(True)), _part(match_fuzzy(typed, index.titles, index.grams), sim=F.col("sim")),
    ]
    if vectors is not None and "query_vec" in queries.columns:
        parts.append(_part(match_semantic(typed, vectors), dist=F.col("dist")))
    return _together(parts)


def with_language(queries: DataFrame, shops: DataFrame | None = None) -> DataFrame:
    """``queries`` with ``lang``: their own, or their shop's, or 'simple'."""
    if "lang" in queries.columns:
        return queries
    if shops is None:
        return queries.withColumn("lang", F.lit("simple"))
    known = shops.select("shop_id", ts_config(F.col("search_language")).alias("lang"))
    return queries.join(known, "shop_id", "left").withColumn("lang", F.coalesce("lang", F.lit("simple")))


def candidates(queries: DataFrame, products: DataFrame, synonyms: DataFrame | None = None, vectors: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Candidates of all requests, with an index made on the way."""
    return text_candidates(queries, index_tables(eligible(products), stems), synonyms, vectors, stems).unionByName(browse_candidates(queries, products))


def filter_passes(e: Column) -> Column:
    """Whether a product passes one selected filter (key: source, value: values); a missing attribute does not."""
    source, values = e["key"], e["value"]
    wants = lambda v: F.array_contains(values, v)
    stock = F.when(wants("in_stock") == wants("out_of_stock"), True).otherwise(F.col("available") == wants("in_stock"))
    option = F.arrays_overlap(F.element_at(F.col("options"), F.substr(source, F.lit(8))), values)
    meta = F.array_contains(values, F.element_at(F.col("metafields"), F.substr(source, F.lit(11))))
    test = (
        F.when(F.size(values) == 0, True).when(source == "vendor", F.array_contains(values, F.col("vendor"))).when(source == "productType", F.array_contains(values, F.col("product_type")))
        .when(source == "tag", F.arrays_overlap(F.col("tags"), values)).when(source == "collection", F.arrays_overlap(F.col("collections"), values))
        .when(source == "availability", stock).when(source.startswith("option:"), option).when(source.startswith("metafield:"), meta).otherwise(True)
    )
    return F.coalesce(test, F.lit(False))


def failed_filters() -> Column:
    """The sources of the predicates that a (request, product) row fails; the stock rule belongs to availability."""
    none = F.array().cast("array<string>")
    chosen = F.transform(F.filter(F.map_entries(F.coalesce("filters", F.create_map().cast("map<string,array<string>>"))), lambda e: ~filter_passes(e)), lambda e: e["key"])
    add = lambda bad, name: F.when(bad, F.array(F.lit(name))).otherwise(none)
    price = F.coalesce(F.col("price_max") < F.col("q_price_min"), F.lit(False)) | F.coalesce(F.col("price_min") > F.col("q_price_max"), F.lit(False))
    scope = F.col("collection").isNotNull() & ~F.array_contains("collections", F.col("collection"))
    stock = ~F.col("available") & ~F.coalesce("include_unavailable", F.lit(False))
    return F.array_distinct(F.concat(chosen, add(price, "price"), add(scope, "__collection"), add(stock, "availability")))


def condition_holds(c: Column, null_safe: bool = False) -> Column:
    """A merchandising condition over a product row, with SQL's three values; ``null_safe`` takes a missing attribute as unequal."""
    field, value, contains = c["field"], c["value"], c["op"] == "contains"
    inside = lambda x: F.lower(x).contains(F.lower(value))
    text = lambda x: F.when(contains, inside(x)).otherwise(x == value)
    meta = F.element_at(F.col("metafields"), F.substr(field, F.lit(11)))
    test = (
        F.when(field == "tag", F.when(contains, F.exists("tags", inside)).otherwise(F.array_contains("tags", value)))
        .when(field == "vendor", text(F.col("vendor"))).when(field == "productType", text(F.col("product_type")))
        .when(field == "collection", F.array_contains("collections", value)).when(field == "available", F.col("available") == (value == "true"))
        .when(field.startswith("option:"), F.array_contains(F.element_at(F.col("options"), F.substr(field, F.lit(8))), value))
        .when(field.startswith("metafield:"), F.when(contains, inside(F.coalesce(meta, F.lit("")))).otherwise(meta == value))
    )
    test = F.coalesce(test, F.lit(False)) if null_safe else test
    return F.when(c["op"] == "neq", ~test).otherwise(test)


def condition_score(conditions: Column, null_safe: bool = False) -> Column:
    """Boosts add their weight, buries take it, conditional pins add it and 50."""
    gain = lambda c: F.when(c["action"] == "boost", c["weight"]).when(c["action"] == "bury", -c["weight"]).when(c["action"] == "pin", c["weight"] + 50).otherwise(0.0)
    return F.coalesce(F.aggregate(conditions, F.lit(0.0), lambda a, c: a + F.when(condition_holds(c, null_safe), gain(c)).otherwise(0.0)), F.lit(0.0))


def not_hidden(conditions: Column, null_safe: bool = False) -> Column:
    """False for a row that a hide condition removes; a missing attribute hides it too, unless ``null_safe``."""
    return F.coalesce(F.forall(F.filter(conditions, lambda c: c["action"] == "hide"), lambda c: F.coalesce(~condition_holds(c, null_safe), F.lit(False))), F.lit(True))


def scored(rows: DataFrame, null_safe: bool = False) -> DataFrame:
    """The six score parts, the score, and the strategy label."""
    term = F.col("norm") != ""
    ids = lambda c: F.coalesce(F.array_contains(F.col(c), F.col("product_id")), F.lit(False))
    parts = {
        "x_text": 4 * F.col("text_rank"), "x_similarity": 2 * F.col("sim"), "x_semantic": 2.5 * F.greatest(F.lit(0.0), F.when(F.col("dist") < SEMANTIC, 1 - F.col("dist")).otherwise(0.0)),
        "x_prefix": F.when(term & F.lower(fold_accents(F.col("title"))).startswith(F.col("norm")), 1.5).otherwise(0.0), "x_popularity": F.when(term, 0.3 * F.log1p("popularity")).otherwise(0.0),
        "x_merchandising": F.when(term, F.when(F.col("sku"), 50.0).otherwise(0.0) + F.when(ids("boosted"), 5.0).otherwise(0.0) - F.when(ids("buried"), 5.0).otherwise(0.0) + condition_score(F.col("conditions"), null_safe)).otherwise(0.0),
    }
    rows = rows.withColumns(parts).withColumn("score", sum((F.col(k) for k in list(parts)[1:]), F.col("x_text")))
    return rows.withColumn("strategy", F.when(~term, "browse").when(F.col("sku"), "sku").when((F.col("dist") < SEMANTIC) & F.col("fulltext"), "hybrid").when(F.col("dist") < SEMANTIC, "semantic").otherwise("fulltext"))


RULE_COLUMNS = {"conditions": "array<struct<field:string,op:string,value:string,action:string,weight:double>>", "hidden": "array<string>", "boosted": "array<string>", "buried": "array<string>", "pinned": "array<string>"}


def evaluated(queries: DataFrame, products: DataFrame, cands: DataFrame, rules: DataFrame | None = None, matched: DataFrame | None = None, null_safe: bool = False) -> DataFrame:
    """Candidate rows with product columns, scores, and ``failed``: the predicates each row fails.

    Rows hidden by a rule are gone from here on, and so from all counts.
    """
    q = queries.withColumn("norm", normalize_query(F.col("term"))).withColumnsRenamed({"price_min": "q_price_min", "price_max": "q_price_max"})
    if rules is not None and matched is not None:
        q = q.join(matched, "query_id", "left").join(rules.select("shop_id", "rule_id", *RULE_COLUMNS), ["shop_id", "rule_id"], "left")
    for name, kind in RULE_COLUMNS.items():
        q = q.withColumn(name, F.coalesce(name, F.array().cast(kind)) if rules is not None else F.array().cast(kind))
    rows = cands.join(q, "query_id").join(eligible(products), ["shop_id", "product_id"])
    rows = rows.where(~F.array_contains("hidden", F.col("product_id")) & not_hidden(F.col("conditions"), null_safe))
    return scored(rows, null_safe).withColumn("failed", failed_filters())


def order_columns() -> list[Column]:
    """One ordering for all sorts: within a request the sort is constant, so unused keys are null or equal."""
    sort = F.when(F.col("sort").isin(*SORTS), F.col("sort")).otherwise("relevance")
    term = F.col("norm") != ""
    popular = (sort == "bestselling") | ((sort == "relevance") & ~term)
    published = F.unix_micros(F.col("published_at").cast("timestamp")).cast("double")
    first = F.when(sort == "price_asc", -F.col("price_min")).when(sort == "price_desc", F.col("price_max")).when(sort == "newest", published).when(popular, F.col("popularity")).when(sort == "relevance", F.round("score", 9))
    second = F.when(popular, published).when(sort == "relevance", F.col("popularity"))
    return [F.desc_nulls_last(first), F.when(sort == "title_asc", F.col("title")).asc_nulls_last(), F.when(sort == "title_desc", F.col("title")).desc_nulls_last(), F.desc_nulls_last(second), F.asc("product_id")]


def totals(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("failed") == 0).groupBy("query_id").agg(F.count("*").alias("total"))


def pinned_candidates(queries: DataFrame, rules: DataFrame, matched: DataFrame) -> DataFrame:
    """query_id, product_id, pin_no of the products that the rule of a request by relevance pins; the text need not match."""
    pins = queries.where("sort = 'relevance' OR sort IS NULL").join(matched, "query_id").join(rules.select("shop_id", "rule_id", "pinned"), ["shop_id", "rule_id"])
    return pins.select("query_id", F.posexplode("pinned").alias("pin_no", "product_id"))


def ranked(rows: DataFrame) -> DataFrame:
    """Hits with their rank: pins in list order first (score 999), then the rest in the request's order."""
    hits = rows.where(F.size("failed") == 0)
    order = order_columns()
    if "pin_no" in rows.columns:
        pinned = F.col("pin_no").isNotNull()
        hits = hits.withColumn("score", F.when(pinned, 999.0).otherwise(F.col("score"))).withColumn("pinned_hit", pinned)
        order = [F.asc_nulls_last("pin_no"), *order]
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def page(hits: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(1), F.least(F.lit(MAX_PER_PAGE), F.coalesce("per_page", F.lit(24))))
    no = F.greatest(F.lit(1), F.least(F.lit(MAX_PAGE), F.coalesce("page", F.lit(1))))
    return hits.where((F.col("rank") > (no - 1) * size) & (F.col("rank") <= no * size))


def first_variant(variants: DataFrame) -> DataFrame:
    """The variant that a cart button adds (available first, then the smallest id), and the number of variants."""
    return variants.groupBy("shop_id", "product_id").agg(F.min_by("variant_id", F.struct(~F.col("available"), F.col("variant_id"))).alias("variant_id"), F.count("*").alias("n_variants"))


def suggest_spelling(queries: DataFrame, grams: DataFrame, counts: DataFrame, few: int = 3) -> DataFrame:
    """query_id, suggestion for requests with under ``few`` results: the nearest word of near titles, else a near title."""
    q = queries.where("typo_tolerance").join(counts, "query_id", "left").where(F.coalesce("total", F.lit(0)) < few)
    sims = title_similarity(q, grams, SPELLING)
    top = sims.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "folded_title"))).where("n <= 5")
    typed = q.select("query_id", normalize_query(F.col("term")).alias("norm")).withColumn("typed", F.split("norm", " "))
    words = top.join(typed, "query_id").withColumn("word", F.explode(F.filter(F.split("folded_title", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)))
    sim = F.array_max(F.transform("typed", lambda t: word_sim(F.col("word"), t)))
    best = words.where(~F.array_contains("typed", F.col("word"))).withColumn("ws", sim).where("ws > 0.34").groupBy("query_id").agg(F.max_by("word", F.struct("ws", "word")).alias("word"))
    whole = top.where("n = 1").select("query_id", "folded_title")
    return whole.join(best, "query_id", "left").select("query_id", F.coalesce("word", "folded_title").alias("suggestion"))


def explain_requests(queries: DataFrame, synonyms: DataFrame | None = None, rules: DataFrame | None = None, matched: DataFrame | None = None, shops: DataFrame | None = None) -> DataFrame:
    """query_id, normalized_term, expansions, ts_query, language, rule_id, priority: how each request was understood."""
    q = with_language(queries, shops).select("query_id", normalize_query(F.col("term")).alias("normalized_term"), F.col("lang").alias("language"))
    phrases = expand_synonyms(queries, synonyms) if synonyms is not None else plain_terms(queries)
    listed = phrases.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "phrase"))), lambda x: x["phrase"]).alias("expansions"))
    rows = q.join(listed, "query_id", "left").withColumn("expansions", F.coalesce("expansions", F.array().cast("array<string>")))
    rows = rows.withColumn("ts_query", boolean_query(F.col("expansions")))
    if rules is None or matched is None:
        return rows.withColumns({"rule_id": F.lit(None).cast("int"), "priority": F.lit(None).cast("int")})
    own = queries.select("query_id", "shop_id").join(matched, "query_id").join(rules.select("shop_id", "rule_id", "priority"), ["shop_id", "rule_id"])
    return rows.join(own.select("query_id", "rule_id", "priority"), "query_id", "left")


@dataclass
class Found:
    """What a table of requests finds; hits, totals and facets are read off the same written rows."""

    redirected: DataFrame | None  # requests that a redirect answers, with url
    rows: DataFrame  # candidates with scores and failed filters: what facets count
    hits: DataFrame  # the asked page of each request, ranked
    totals: DataFrame
    suggestions: DataFrame  # spelling, for requests with few hits
    explained: DataFrame  # how each request was understood


def search(
    queries: DataFrame, products: DataFrame, as_of: str, *, synonyms: DataFrame | None = None, redirects: DataFrame | None = None,
    rules: DataFrame | None = None, vectors: DataFrame | None = None, stems: DataFrame | None = None, shops: DataFrame | None = None, index: Index | None = None, null_safe: bool = False,
) -> Found:
    """A whole search: redirects, synonyms, candidates, rules, filters, scores, pins, order, page, totals, spelling.

    Each table that is left out leaves its step out. ``rules`` have parsed conditions (``parse_conditions``). ``index``
    is a stored one; without it the tables are made on the way, and only if a request has a term. The evaluated
    rows are written once.
    """
    redirected, rest = apply_redirects(queries, redirects) if redirects is not None else (None, queries)
    matched = match_rules(rest, rules, as_of) if rules is not None else None
    if vectors is not None and "collections" not in vectors.columns:
        vectors = vectors.join(eligible(products).select("shop_id", "product_id", "collections"), ["shop_id", "product_id"])
    index = index or index_tables(eligible(products), stems)
    cands = browse_candidates(rest, products)
    if not rest.where(normalize_query(F.col("term")) != "").isEmpty():
        cands = cands.unionByName(text_candidates(rest, index, synonyms, vectors, stems, shops))
    if rules is not None:
        found = cands.withColumns({"matched": F.lit(True), "pin_no": F.lit(None).cast("int")})
        pins = pinned_candidates(rest, rules, matched).select("query_id", "product_id", *[F.lit(v).alias(k) for k, v in _PARTS.items()], F.lit(False).alias("matched"), "pin_no")
        best = {"dist": F.min, "pin_no": F.min}
        cands = found.unionByName(pins).groupBy("query_id", "product_id").agg(*[best.get(c, F.max)(c).alias(c) for c in (*_PARTS, "matched", "pin_no")])
    rows = evaluated(rest, products, cands, rules, matched, null_safe)
    if rules is not None:
        # A pinned product need not match the term, but must pass the filters.
        rows = rows.where(F.col("matched") | (F.size("failed") == 0)).drop("matched")
    rows = written(rows)
    count = totals(rows)
    return Found(redirected, rows, page(ranked(rows)), count, suggest_spelling(rest, index.grams, count), explain_requests(rest, synonyms, rules, matched, shops))
