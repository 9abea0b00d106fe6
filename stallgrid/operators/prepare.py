"""Preparing a table of search requests: synonyms, boolean terms, redirects, merchandising rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.functions.text import normalize_query, tokenize

MAX_EXPANSIONS = 12
CONDITION = "array<struct<field:string,op:string,value:string,action:string,weight:double>>"


def expand_synonyms(queries: DataFrame, synonyms: DataFrame, cap: int = MAX_EXPANSIONS, lenient: bool = False) -> DataFrame:
    """query_id, group_no, phrase: the normalised term first, then the phrases of the rules that fire, in rule order.

    A rule fires by its input (one-way) or by any of its terms: a single word must be one of the query's words, a
    phrase must stand in the query. Words are found by an equi-join; phrases by a join on their first word. A word with
    a sign in it ("t-shirt") is no word of any query and never fires, unless ``lenient``: then the words between its
    signs must stand in the query one after another.
    """
    q = queries.select("query_id", "shop_id", normalize_query(F.col("term")).alias("norm"))
    trigger = F.when(F.col("type") == "oneway", F.array("input")).otherwise(F.col("terms"))
    rules = synonyms.select("shop_id", "rule_id", "terms", F.explode(F.transform(F.array_compact(trigger), normalize_query)).alias("trigger")).where("trigger <> ''")
    if lenient:
        rules = rules.withColumn("trigger", F.when(F.col("trigger").contains(" "), F.col("trigger")).otherwise(F.array_join(tokenize(F.col("trigger")), " "))).where("trigger <> ''")
    rules = rules.withColumn("word", F.split_part("trigger", F.lit(" "), F.lit(1)))
    words = F.array_distinct(F.concat(tokenize(F.col("norm")), F.split("norm", " ")))
    exploded = q.withColumn("word", F.explode(words)).withColumn("is_token", F.array_contains(tokenize(F.col("norm")), F.col("word")))
    phrase = F.col("trigger").contains(" ")
    inside = lambda text: F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), F.col("trigger"), F.lit(" ")))
    stands = inside(F.col("norm")) | inside(F.array_join(tokenize(F.col("norm")), " ")) if lenient else inside(F.col("norm"))
    ok = F.when(phrase, stands).otherwise(F.col("is_token"))
    fired = exploded.join(rules, ["shop_id", "word"]).where(ok).select("query_id", "rule_id", "terms").distinct()
    added = fired.select("query_id", "rule_id", F.posexplode(F.transform("terms", normalize_query)).alias("n", "phrase")).where("phrase <> ''")
    base = q.where("norm <> ''").select("query_id", F.lit(None).cast("string").alias("rule_id"), F.lit(-1).alias("n"), F.col("norm").alias("phrase"))
    every = base.unionByName(added.withColumn("rule_id", F.col("rule_id").cast("string")))
    first = every.groupBy("query_id", "phrase").agg(F.min(F.struct(F.col("n") >= 0, "rule_id", "n")).alias("at"))
    no = F.row_number().over(W.partitionBy("query_id").orderBy("at", "phrase"))
    return first.withColumn("group_no", no).where(F.col("group_no") <= cap).select("query_id", "group_no", "phrase")


def plain_terms(queries: DataFrame) -> DataFrame:
    """query_id, group_no, phrase of requests without synonyms: the normalised term."""
    return queries.select("query_id", F.lit(1).alias("group_no"), normalize_query(F.col("term")).alias("phrase")).where("phrase <> ''")


def _clean_words(phrase: Column) -> Column:
    """The words of a phrase without quotes, leading signs of exclusion and the word "or"."""
    bare = F.transform(F.split(F.regexp_replace(phrase, "[\"']", " "), r"\s+"), lambda w: F.regexp_replace(w, r"^[-!]+", ""))
    return F.filter(bare, lambda w: (w != "") & (F.lower(w) != "or"))


def query_terms(expansions: DataFrame) -> DataFrame:
    """query_id, group_no, token: groups are alternatives, the tokens of one are all required."""
    return expansions.select("query_id", "group_no", F.explode(F.array_distinct(tokenize(F.array_join(_clean_words(F.col("phrase")), " ")))).alias("token"))


def boolean_query(phrases: Column) -> Column:
    """The alternatives as one line: phrases of several words in brackets, with OR between them."""
    clean = F.filter(F.transform(phrases, lambda p: F.array_join(_clean_words(p), " ")), lambda p: p != "")
    return F.array_join(F.transform(clean, lambda p: F.when(p.contains(" "), F.concat(F.lit("("), p, F.lit(")"))).otherwise(p)), " OR ")


def apply_redirects(queries: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redirected with url, the rest): exact matches of the normalised term skip the search."""
    q = queries.withColumn("_norm", normalize_query(F.col("term")))
    r = redirects.select("shop_id", normalize_query(F.col("query")).alias("_norm"), "url").dropDuplicates(["shop_id", "_norm"])
    return q.join(r, ["shop_id", "_norm"]).drop("_norm"), q.join(r, ["shop_id", "_norm"], "left_anti").drop("_norm")


def parse_conditions(c: Column) -> Column:
    """Rule conditions from JSON: unknown operators and actions go, weights are held in 0..20 (0 counts as 5), at most 20."""
    raw = F.from_json(c, CONDITION)
    good = F.filter(raw, lambda x: x["field"].isNotNull() & x["value"].isNotNull() & x["op"].isin("eq", "neq", "contains") & x["action"].isin("boost", "bury", "hide", "pin"))
    weight = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.when(F.coalesce(w, F.lit(0.0)) == 0, 5.0).otherwise(w)))
    return F.slice(F.transform(good, lambda x: F.struct(x["field"].alias("field"), x["op"].alias("op"), x["value"].alias("value"), x["action"].alias("action"), weight(x["weight"]).alias("weight"))), 1, 20)


def rule_status(rules: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return rules.withColumn("state", F.when(~F.col("active"), "paused").when(F.col("starts_at") > now, "scheduled").when(F.col("ends_at") <= now, "ended").otherwise("active"))


def match_rules(queries: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """query_id and the rule that serves it: the highest priority among those that fit, then the smallest rule_id.

    A missing trigger fits everything, which would be a join without keys; there are four combinations of present
    triggers, so the join is four equi-joins.
    """
    live = rule_status(rules, as_of).where("state = 'active'").withColumn("has_conditions", F.size(F.coalesce("conditions", F.array().cast(CONDITION))) > 0)
    r = live.withColumn("tq", F.when(F.trim("trigger_query") != "", F.col("trigger_query"))).withColumn("tc", F.when(F.trim("trigger_collection") != "", F.col("trigger_collection")))
    r = r.where("tq IS NOT NULL OR tc IS NOT NULL OR has_conditions").select("shop_id", "rule_id", "priority", F.coalesce("variant", F.lit("all")).alias("variant"), "tq", "tc")
    q = queries.select("query_id", "shop_id", normalize_query(F.col("term")).alias("tq"), F.col("collection").alias("tc"), "bucket")
    found = None
    for keys in (["tq", "tc"], ["tq"], ["tc"], []):
        part = r
        for k in ("tq", "tc"):
            part = part.where(F.col(k).isNotNull() if k in keys else F.col(k).isNull())
        one = q.join(part.select("shop_id", "rule_id", "priority", "variant", *keys), ["shop_id", *keys]).where((F.col("variant") == "all") | (F.col("variant") == F.col("bucket")))
        one = one.select("query_id", "rule_id", "priority")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("priority"), "rule_id"))
    return found.withColumn("_n", rank).where("_n = 1").select("query_id", "rule_id")
