"""Search reports for all shops at once: totals, rates, term lists, daily series, experiment arms.

``searches`` holds one row per recorded search: shop_id, ts, term, results_count, clicked, converted, purchased,
revenue, product_id, bucket. Windows end at ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallgrid.functions.text import trigrams, word_sim
from stallgrid.operators.merge import PLAN_DAYS, TIERS, plan_value


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _days_before(as_of: str, days: int) -> Column:
    return _ts(as_of) - F.make_interval(days=F.lit(days))


def in_window(as_of: str, days: int) -> Column:
    return (F.col("ts") >= _days_before(as_of, days)) & (F.col("ts") <= _ts(as_of))


def _funnel() -> list[Column]:
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("bigint")
    return [
        F.count("*").alias("searches"), flag("clicked").alias("clicks"), flag("converted").alias("conversions"), flag("purchased").alias("purchases"),
        F.round(F.coalesce(F.sum(F.when(F.col("purchased"), F.col("revenue"))), F.lit(0.0)), 4).alias("revenue"),
        F.sum(F.when(F.col("results_count") == 0, 1).otherwise(0)).cast("bigint").alias("zero_results"),
    ]


def funnel_totals(searches: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Totals of the window and of the one before it, from one scan (period: current or previous)."""
    now, start, before = _ts(as_of), _days_before(as_of, days), _days_before(as_of, 2 * days)
    period = F.when((F.col("ts") >= start) & (F.col("ts") <= now), "current").when((F.col("ts") >= before) & (F.col("ts") < start), "previous")
    return searches.withColumn("period", period).where("period IS NOT NULL").groupBy("shop_id", "period").agg(*_funnel())


def rate(part: Column, whole: Column) -> Column:
    """Per cent with one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10).otherwise(0.0)


def funnel_rates(totals: DataFrame) -> DataFrame:
    n = F.col("searches")
    return totals.withColumns({
        "click_rate": rate(F.col("clicks"), n), "conversion_rate": rate(F.col("conversions"), n), "purchase_rate": rate(F.col("purchases"), n),
        "zero_rate": rate(F.col("zero_results"), n), "no_click_rate": rate(n - F.col("clicks"), n),
    })


def period_delta(totals: DataFrame) -> DataFrame:
    """Change of each figure against the previous period: per cent of counts, points of rates; none without a base."""
    rates = funnel_rates(totals)
    figures = ["searches", "revenue", "click_rate", "zero_rate"]
    now = rates.where("period = 'current'").select("shop_id", *[F.col(f).cast("double").alias(f"{f}_now") for f in figures])
    then = rates.where("period = 'previous'").select("shop_id", *[F.col(f).cast("double").alias(f"{f}_then") for f in figures])
    rows = now.join(then, "shop_id", "left")
    items = []
    for f in figures:
        a, b = F.col(f"{f}_now"), F.coalesce(F.col(f"{f}_then"), F.lit(0.0))
        raw = a - b if f.endswith("rate") else (a - b) / b * 100
        items.append(F.struct(F.lit(f).alias("figure"), F.when(b != 0, F.round(raw, 1)).alias("delta")))
    out = rows.select("shop_id", F.explode(F.array(*items)).alias("x")).select("shop_id", "x.figure", "x.delta")
    up = F.col("delta") > 0
    tone = F.when(F.col("delta").isNull(), "none").when(F.abs("delta") < 0.1, "no change").when(up == (F.col("figure") != "zero_rate"), "good").otherwise("bad")
    return out.withColumn("tone", tone)


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("shop_id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_terms(searches: DataFrame, as_of: str, days: int = 30, k: int = 25) -> DataFrame:
    rows = searches.where(in_window(as_of, days) & (F.trim("term") != ""))
    g = rows.groupBy("shop_id", "term").agg(F.count("*").alias("searches"), F.round(F.avg("results_count"), 4).alias("avg_results"), F.sum(F.col("clicked").cast("bigint")).alias("clicks"))
    return _top(g.withColumn("ctr", rate(F.col("clicks"), F.col("searches"))), k, F.desc("searches"), F.asc("term"))


def zero_terms(searches: DataFrame, as_of: str, days: int = 30, k: int = 25) -> DataFrame:
    rows = searches.where(in_window(as_of, days) & (F.col("results_count") == 0) & (F.trim("term") != ""))
    return _top(rows.groupBy("shop_id", "term").agg(F.count("*").alias("searches")), k, F.desc("searches"), F.asc("term"))


def no_click_terms(searches: DataFrame, as_of: str, days: int = 30, k: int = 25, least: int = 3) -> DataFrame:
    rows = searches.where(in_window(as_of, days) & (F.col("results_count") > 0) & (F.trim("term") != ""))
    g = rows.groupBy("shop_id", "term").agg(F.count("*").alias("searches"), F.sum(F.col("clicked").cast("bigint")).alias("clicks")).where((F.col("clicks") == 0) & (F.col("searches") >= least))
    return _top(g.drop("clicks"), k, F.desc("searches"), F.asc("term"))


def top_clicked(searches: DataFrame, products: DataFrame, as_of: str, days: int = 30, k: int = 15) -> DataFrame:
    rows = searches.where(in_window(as_of, days) & F.col("clicked") & F.col("product_id").isNotNull())
    top = _top(rows.groupBy("shop_id", "product_id").agg(F.count("*").alias("clicks")), k, F.desc("clicks"), F.asc("product_id"))
    titles = products.select("shop_id", "product_id", "title")
    return top.join(titles, ["shop_id", "product_id"], "left").withColumn("title", F.coalesce("title", F.lit("(removed product)")))


def daily_series(searches: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Searches and clicks of every day from the window's first day to as_of; days without any are 0."""
    first = F.to_date(_days_before(as_of, days))
    by_day = searches.where((F.to_date("ts") >= first) & (F.col("ts") <= _ts(as_of))).groupBy("shop_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), F.sum(F.col("clicked").cast("bigint")).alias("clicks"))
    shops = searches.select("shop_id").distinct()
    calendar = shops.select("shop_id", F.explode(F.sequence(first, F.to_date(_ts(as_of)))).alias("day"))
    return calendar.join(by_day, ["shop_id", "day"], "left").select("shop_id", "day", F.coalesce("searches", F.lit(0)).cast("bigint").alias("searches"), F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks"))


def ab_arms(searches: DataFrame, as_of: str, days: int = 30, least: int = 20) -> DataFrame:
    """The funnel by experiment arm, with the winner: a higher purchase rate than the other arm, at least ``least`` searches."""
    rows = searches.where(in_window(as_of, days) & (F.coalesce(F.trim("bucket"), F.lit("")) != ""))
    return arm_winners(rows.groupBy("shop_id", "bucket").agg(*_funnel()), least)


def arm_winners(arms: DataFrame, least: int = 20) -> DataFrame:
    """The arms' totals with purchase_rate and winner."""
    arms = arms.withColumn("purchase_rate", rate(F.col("purchases"), F.col("searches")))
    shop = W.partitionBy("shop_id")
    others = F.min("purchase_rate").over(shop)
    best = F.max("purchase_rate").over(shop)
    return arms.withColumn("winner", (F.col("purchase_rate") == best) & (others < best) & (F.col("searches") >= least))


def activity(searches: DataFrame, as_of: str, days: int = 7, k: int = 10) -> DataFrame:
    """Most searched terms of a short range, with each bar's share of the longest."""
    rows = searches.where(in_window(as_of, max(1, min(days, 31))) & (F.trim("term") != ""))
    top = _top(rows.groupBy("shop_id", "term").agg(F.count("*").alias("searches")), k, F.desc("searches"), F.asc("term"))
    return with_shares(top)


def with_shares(top: DataFrame) -> DataFrame:
    return top.withColumn("share", F.round(F.col("searches") / F.max("searches").over(W.partitionBy("shop_id")), 6))


def clamp_days(shops: DataFrame, requested: int) -> DataFrame:
    """shop_id and the days its plan lets it look back; a request of no days asks for all that the plan includes."""
    plan = F.when(F.col("plan_override").isin(*TIERS), F.col("plan_override")).otherwise(F.col("plan_name"))
    most = plan_value(plan, PLAN_DAYS)
    return shops.select("shop_id", (F.least(F.lit(requested), most) if requested > 0 else most).alias("days"))


def dashboard_counts(searches: DataFrame, products: DataFrame, as_of: str) -> DataFrame:
    """Searches, clicks and zero results of the last seven days, and the catalog's size."""
    week = searches.where(in_window(as_of, 7)).groupBy("shop_id").agg(F.count("*").alias("searches"), F.sum(F.col("clicked").cast("bigint")).alias("clicks"), F.sum(F.when(F.col("results_count") == 0, 1).otherwise(0)).cast("bigint").alias("zero_results"))
    size = products.groupBy("shop_id").agg(F.count("*").alias("catalog"))
    return size.join(week, "shop_id", "left").na.fill(0, ["searches", "clicks", "zero_results"])


def synonym_candidates(searches: DataFrame, products: DataFrame, synonyms: DataFrame, as_of: str, days: int = 30, top: int = 40, keep: int = 10, least: float = 0.3) -> DataFrame:
    """For frequent terms without results: the catalog title nearest by trigrams, and its word nearest to the term.

    Terms that a synonym rule already covers are left out. Distinct titles are joined on their trigrams only.
    """
    zero = searches.where(in_window(as_of, days) & (F.col("results_count") == 0) & (F.length(F.trim("term")) >= 3))
    terms = _top(zero.groupBy("shop_id", "term").agg(F.count("*").alias("searches")), top, F.desc("searches"), F.asc("term"))
    covered = synonyms.select("shop_id", F.explode(F.array_compact(F.concat("terms", F.array("input")))).alias("term"))
    terms = terms.join(covered, ["shop_id", "term"], "left_anti")
    titles = products.select("shop_id", "title").distinct()
    grams = lambda df, c: df.withColumn("g", trigrams(F.col(c))).withColumn("n_" + c, F.size("g")).withColumn("gram", F.explode("g")).drop("g")
    shared = grams(terms, "term").join(grams(titles, "title"), ["shop_id", "gram"]).groupBy("shop_id", "term", "searches", "title").agg(F.count("*").alias("n"), F.first("n_term").alias("a"), F.first("n_title").alias("b"))
    sim = F.col("n") / (F.col("a") + F.col("b") - F.col("n"))
    near = shared.groupBy("shop_id", "term", "searches").agg(F.max_by("title", F.struct(sim, F.col("title"))).alias("title"))
    words = near.withColumn("word", F.explode(F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))))
    scored = words.withColumn("sim", F.round(word_sim(F.col("word"), F.col("term")), 6)).where(F.col("sim") > least)
    best = scored.groupBy("shop_id", "term", "searches", "title").agg(F.max_by(F.struct("word", "sim"), F.struct("sim", "word")).alias("w"))
    return _top(best.select("shop_id", "term", "searches", "title", "w.word", "w.sim"), keep, F.desc("searches"), F.asc("term"))


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
