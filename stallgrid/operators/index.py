"""Index tables of the catalog: weighted postings, title trigrams, SKU postings, facet values, embedding text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallgrid.functions.text import fold_accents, tokenize, trigrams
from stallgrid.operators.scratch import written

# Weights of the text classes in ranking.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
_FIELDS = (("title", "A"), ("skus", "A"), ("vendor", "B"), ("product_type", "B"), ("tags", "B"), ("variant_text", "B"), ("description", "C"))


#: Words of a dictionary of stems, or of requests, that are broadcast.
SMALL = 500_000


def _labelled_tokens(text: Column, field: str, weight: str) -> Column:
    return F.transform(tokenize(text), lambda t: F.struct(t.alias("token"), F.lit(field).alias("field"), F.lit(weight).alias("weight")))


def posting_lists(products: DataFrame, *kept: str) -> DataFrame:
    """shop_id, product_id, postings (token, field, weight): every word of a product in the order of its places, as one array.

    No row leaves its task, so nothing is shuffled to put a product's postings together.
    """
    # As a row of a generator, so that the words are made once, however often the array is read.
    return products.select("shop_id", "product_id", *kept, F.inline(F.array(F.struct(_words(products).alias("postings")))))


def _words(products: DataFrame) -> Column:
    parts = []
    for field, weight in _FIELDS:
        if field in products.columns:
            kind = dict(products.dtypes)[field]
            text = F.array_join(field, " ") if kind.startswith("array") else F.col(field)
            parts.append(_labelled_tokens(text, field, weight))
    return F.concat(*parts)


def stemmed_lists(products: DataFrame, stems: DataFrame) -> DataFrame:
    """``posting_lists`` with the words that ``stems`` (lang, token, stem) has replaced by their stems; SKUs are never stemmed.

    A dictionary of up to ``SMALL`` words is broadcast, and a product's words are put together where they lie. With a
    larger one only the places of words that it has are shuffled: a bounded filter leaves out nearly all others, and a
    product's places and stems meet its text, not its words.
    """
    d, few = _dictionary(stems)
    if few:
        dealt = products.repartition(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shop_id", "product_id")
        rows = _replaced(_exploded(dealt, "lang"), d)
        return rows.groupBy("shop_id", "product_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "field", "weight"))).alias("postings"))
    return _stemmed_places(products, d)


def _stemmed_places(products: DataFrame, d: DataFrame) -> DataFrame:
    texts = [c for c, _ in _FIELDS if c in products.columns]
    # The key of a row is all that its words are made of.
    key = [F.xxhash64("shop_id", "product_id", "lang", *texts).alias("_a"), F.xxhash64(F.lit(1), "shop_id", "product_id", "lang", *texts).alias("_b")]
    p = products.select("shop_id", "product_id", "lang", *texts, *key)
    places = posting_lists(p, "lang", "_a", "_b").select("lang", "_a", "_b", F.posexplode("postings").alias("pos", "x")).where("x.field <> 'skus'").select("lang", "_a", "_b", "pos", "x.token")
    slots, marks = _filter_of(d)
    places = places.withColumns(slots).join(F.broadcast(marks), "slot").where("bits & mask = mask").drop("slot", "bits", "mask")
    d = d.groupBy("lang", "token").agg(F.min("stem").alias("stem")).where("stem IS NOT NULL")
    found = places.join(d.hint("merge"), ["lang", "token"])
    found = found.groupBy("_a", "_b").agg(F.sort_array(F.collect_set(F.struct("pos", "stem"))).alias("found"))
    # One entry for each place up to the last stem, null where the word stays: no search for each word.
    gap = lambda x, i: x["pos"] - F.coalesce(F.get("found", i - 1)["pos"] + 1, F.lit(0))
    dense = F.flatten(F.transform("found", lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(x, i)), F.array(x["stem"]))))
    rows = p.join(found.hint("merge"), ["_a", "_b"], "left")
    rows = rows.select("shop_id", "product_id", F.inline(F.array(F.struct(_words(p).alias("postings"), dense.alias("stems")))))
    one = lambda x, i: F.struct((i + 1).alias("pos"), F.coalesce(F.get("stems", i), x["token"]).alias("token"), x["field"].alias("field"), x["weight"].alias("weight"))
    return rows.select("shop_id", "product_id", F.inline(F.array(F.struct(F.transform("postings", one).alias("postings")))))


#: Words of 64 bits in the filter of a large dictionary: 32 million bits, of which a word of the dictionary sets three.
SLOTS = 1 << 19


def _filter_of(d: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    """The columns slot and mask of a word (lang, token), and the bits of each slot that a word of ``d`` is in.

    A word of ``d`` has all bits of its mask in its slot. Its size is bounded; with more words it lets more others through.
    """
    h = F.xxhash64("token", "lang")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(h, n), F.lit(64)).cast("int"))
    columns = {"slot": F.pmod(F.xxhash64("lang", "token"), F.lit(SLOTS)), "mask": bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))}
    return columns, d.withColumns(columns).groupBy("slot").agg(F.bit_or("mask").alias("bits"))


def build_postings(products: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """shop_id, token, product_id, field, weight, pos: every word of every product, positions running over the fields.

    One narrow step: the fields' words are strung together per row and exploded once. ``stems`` (lang, token,
    stem) replaces tokens of a language; SKUs are never stemmed.
    """
    if stems is None:
        return _exploded(products)
    d, few = _dictionary(stems)
    if few:
        return _replaced(_exploded(products, "lang"), d).drop("lang")
    return _stemmed_places(products, d).select("shop_id", "product_id", F.explode("postings").alias("x")).select("shop_id", "product_id", "x.token", "x.field", "x.weight", "x.pos")


def _exploded(products: DataFrame, *kept: str) -> DataFrame:
    keep = ["shop_id", "product_id", *kept]
    return posting_lists(products, *kept).select(*keep, F.posexplode("postings").alias("pos", "x")).select(*keep, "x.token", "x.field", "x.weight", (F.col("pos") + 1).alias("pos"))


def _dictionary(stems: DataFrame) -> tuple[DataFrame, bool]:
    """The dictionary, written once and marked for a broadcast if it has up to ``SMALL`` words, and whether it has."""
    d = written(stems.select("lang", "token", "stem"))
    few = d.limit(SMALL + 1).count() <= SMALL
    return (F.broadcast(d) if few else d), few


def apply_stems(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """Tokens replaced by the stem of their language where the dictionary has one; SKU tokens stay.

    A dictionary of up to ``SMALL`` words is broadcast, so that the tokens stay where they are; with a larger one they meet
    by a shuffle.
    """
    return _replaced(tokens, _dictionary(stems)[0])


def _replaced(tokens: DataFrame, d: DataFrame) -> DataFrame:
    joined = tokens.join(d, ["lang", "token"], "left")
    sku = F.col("field") == "skus" if "field" in tokens.columns else F.lit(False)
    return joined.withColumn("token", F.when(~sku & F.col("stem").isNotNull(), F.col("stem")).otherwise(F.col("token"))).drop("stem").select(*tokens.columns)


def product_titles(products: DataFrame, column: str = "title") -> DataFrame:
    return products.select("shop_id", "product_id", F.lower(fold_accents(F.col(column))).alias("folded_title"))


def title_grams(titles: DataFrame) -> DataFrame:
    """shop_id, folded_title, gram, n_grams: the padded trigrams of the distinct titles of ``product_titles``."""
    t = titles.select("shop_id", "folded_title").distinct()
    return t.withColumn("g", trigrams(F.col("folded_title"))).select("shop_id", "folded_title", F.size("g").alias("n_grams"), F.explode("g").alias("gram"))


def title_stretches(titles: DataFrame) -> DataFrame:
    """shop_id, folded_title, gram: every stretch of one, two and three characters of the distinct titles, across word ends."""
    c = F.col("folded_title")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    t = titles.select("shop_id", "folded_title").distinct()
    return t.select("shop_id", "folded_title", F.explode(F.filter(F.array_distinct(F.concat(of(1), of(2), of(3))), lambda g: g != "")).alias("gram"))


def sku_postings(products: DataFrame) -> DataFrame:
    return products.select("shop_id", "product_id", F.explode("skus").alias("s")).select("shop_id", F.lower("s").alias("sku_lower"), "product_id").distinct()


#: Folders that a stored table is cut into: by shop, and by word.
PARTS, BUCKETS = 16, 16


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the part of their shop and the bucket of their ``key``."""
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    return rows.withColumns({"part": place("shop_id", PARTS), "bucket": place(key, BUCKETS)})


def meet(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a table of the index on shop and ``key``; of a stored one only the folders of the rows are read."""
    if "bucket" not in table.columns:
        return rows.join(table, ["shop_id", key])
    return placed(rows, key).join(table, ["part", "bucket", "shop_id", key]).drop("part", "bucket")


@dataclass
class Index:
    """The tables that text requests are put to; stored ones have the columns part and bucket that they are cut by."""

    postings: DataFrame
    titles: DataFrame
    stretches: DataFrame
    grams: DataFrame
    skus: DataFrame


def index_tables(products: DataFrame, stems: DataFrame | None = None) -> Index:
    titles = product_titles(products)
    return Index(build_postings(products, stems), titles, title_stretches(titles), title_grams(titles), sku_postings(products))


def facet_pairs(products: DataFrame) -> Column:
    """Array of (source, value) of one product: what it counts for in each facet."""
    one = lambda source, c: F.when(F.trim(c) != "", F.array(F.struct(F.lit(source).alias("source"), c.alias("value")))).otherwise(F.array().cast("array<struct<source:string,value:string>>"))
    many = lambda source, c: F.transform(F.array_distinct(F.array_compact(c)), lambda v: F.struct(F.lit(source).alias("source"), v.alias("value")))
    options = F.flatten(F.transform(F.map_entries("options"), lambda e: F.transform(F.array_distinct(e["value"]), lambda v: F.struct(F.concat(F.lit("option:"), e["key"]).alias("source"), v.alias("value")))))
    meta = F.transform(F.filter(F.map_entries("metafields"), lambda e: F.trim(e["value"]) != ""), lambda e: F.struct(F.concat(F.lit("metafield:"), e["key"]).alias("source"), e["value"].alias("value")))
    stock = F.array(F.struct(F.lit("availability").alias("source"), F.when(F.col("available"), "in_stock").otherwise("out_of_stock").alias("value")))
    empty = F.array().cast("array<struct<source:string,value:string>>")
    parts = [one("vendor", F.col("vendor")), one("productType", F.col("product_type")), many("tag", F.col("tags")), many("collection", F.col("collections")), options, meta, stock]
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def facet_values(products: DataFrame) -> DataFrame:
    return products.select("shop_id", "product_id", F.explode(facet_pairs(products)).alias("x")).select("shop_id", "product_id", "x.source", "x.value")


def embedding_text() -> Column:
    """What a product's vector is made of: title, type, vendor, tags, the description's first 1000 characters."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.left(F.concat_ws(". ", blank(F.col("title")), blank(F.col("product_type")), blank(F.col("vendor")), blank(F.array_join("tags", ", ")), blank(F.left("description", F.lit(1000)))), F.lit(4000))


def pending_embeddings(products: DataFrame) -> DataFrame:
    """Products whose embedding text changed since they were embedded (content_hash), or that never were."""
    now = F.sha2(embedding_text(), 256)
    old = F.col("content_hash") if "content_hash" in products.columns else F.lit(None)
    return products.withColumn("new_hash", now).where(old.isNull() | (old != F.col("new_hash")))


def embed(products: DataFrame, fn: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Vectors of pending products by a user function over batches of texts; a batch that fails stays pending."""
    rows = pending_embeddings(products).select("shop_id", "product_id", "new_hash", embedding_text().alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                try:
                    vectors = fn(part["text"].tolist())
                except Exception:  # noqa: BLE001, S112  the user's provider may fail in any way; its rows are tried again
                    continue
                yield part[["shop_id", "product_id", "new_hash"]].rename(columns={"new_hash": "content_hash"}).assign(embedding=vectors)

    return rows.mapInPandas(run, "shop_id string, product_id string, content_hash string, embedding array<float>")
