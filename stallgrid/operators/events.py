"""Event jobs in batch: recording, repeat collapse, attribution, popularity, retention.

``actions`` rows: event_id, shop_id, session_token, ts, kind (search, click, add_to_cart, purchase), term,
product_id, results_count, order_id, revenue. The streaming forms are in stallgrid.streaming.events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What an action adds to a product's popularity.
POPULARITY = {"click": 1.0, "add_to_cart": 5.0, "purchase": 25.0}


def record_searches(actions: DataFrame) -> DataFrame:
    """Searches with a non-blank term."""
    return actions.where((F.col("kind") == "search") & (F.coalesce(F.trim("term"), F.lit("")) != ""))


def sanitize_beacons(raw: DataFrame) -> DataFrame:
    """Beacons with allowed types; tokens, revenue, product and order ids cut to their limits."""
    digits = F.filter(F.slice(F.coalesce("product_ids", F.array().cast("array<string>")), 1, 50), lambda x: x.rlike(r"^\d{1,20}$"))
    return raw.where(F.col("type").isin(*POPULARITY)).select(
        *[c for c in raw.columns if c not in ("session_token", "revenue", "product_ids", "order_id")],
        F.left("session_token", F.lit(64)).alias("session_token"),
        F.greatest(F.lit(0.0), F.least(F.lit(1e6), F.coalesce("revenue", F.lit(0.0)))).alias("revenue"),
        digits.alias("product_ids"), F.left("order_id", F.lit(64)).alias("order_id"),
    )


def _folded(rows: DataFrame, keys: list[str], keep: Callable[[tuple | None, int, bool], tuple[bool, tuple]], mark: str = "false") -> DataFrame:
    """event_id of the rows that ``keep`` accepts, going through each key in time order with what it carries along.

    Rows are sorted by Spark and read batch by batch, so that a key of any size takes one state of memory. ``mark`` is
    a condition on a row that ``keep`` is told.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            kept = []
            for k, at, marked in zip(f[keys].itertuples(index=False, name=None), f["at"].tolist(), f["mark"].tolist(), strict=True):
                if k != key:
                    key, state = k, None
                good, state = keep(state, at, marked)
                kept.append(good)
            yield f.loc[kept, ["event_id"]]

    sized = rows.select(*[F.coalesce(F.concat(F.lit("="), k), F.lit("")).alias(k) for k in keys], F.unix_micros("ts").alias("at"), "event_id", F.expr(mark).alias("mark"))
    return sized.repartition(*keys).sortWithinPartitions(*keys, "at", "event_id").mapInPandas(run, "event_id bigint")


def collapse_repeats(searches: DataFrame, seconds: int = 60) -> DataFrame:
    """Searches without repeats: one within ``seconds`` of the last kept one of its shop, term and token goes.

    The fold runs over one (shop, token, term) at a time, in time order. Rows without a token are then folded among
    the kept rows of their (shop, term): any kept row before them within the time, of whatever token, suppresses.
    """
    least = seconds * 1_000_000

    def keep(last: tuple | None, at: int, marked: bool) -> tuple[bool, tuple]:
        return (True, (at,)) if marked or last is None or at - last[0] > least else (False, last)

    kept = _folded(searches.where("session_token IS NOT NULL"), ["shop_id", "session_token", "term"], keep)
    recorded = searches.join(kept, "event_id", "left_semi").unionByName(searches.where("session_token IS NULL"))
    return searches.join(_folded(recorded, ["shop_id", "term"], keep, "session_token IS NOT NULL"), "event_id", "left_semi")


def attribute(actions: DataFrame, kind: str, hours: int, same_term: bool = False) -> DataFrame:
    """event_id of each action of ``kind`` and the latest search of its shop and token within ``hours`` before it.

    One sorted window over searches and actions together (an as-of join): linear, whatever the number of
    searches in the window.
    """
    keys = ["shop_id", "session_token"] + (["term"] if same_term else [])
    rows = actions.where(F.col("kind").isin("search", kind) & F.col("session_token").isNotNull())
    order = W.partitionBy(*keys).orderBy(F.col("ts"), (F.col("kind") != "search").cast("int"), "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "search", F.struct(F.col("event_id").alias("search_id"), F.col("ts").alias("search_ts"))), ignorenulls=True).over(order)
    found = rows.withColumn("s", last).where((F.col("kind") == kind) & (F.col("s.search_ts") >= F.col("ts") - F.make_interval(hours=F.lit(hours))))
    return found.select("event_id", "shop_id", "session_token", "ts", "term", "product_id", "order_id", "revenue", F.col("s.search_id").alias("search_id"))


def unique_orders(purchases: DataFrame) -> DataFrame:
    """The first purchase of each (shop, order); purchases without an order are each their own."""
    own = F.when(F.col("order_id").isNull(), F.col("event_id"))
    first = F.row_number().over(W.partitionBy("shop_id", "order_id", own).orderBy("ts", "event_id"))
    return purchases.withColumn("_n", first).where("_n = 1").drop("_n")


def attributed_orders(actions: DataFrame, hours: int = 24) -> DataFrame:
    """The first purchase of each order that a search stands behind; one that no search precedes does not count as its order."""
    return unique_orders(attribute(actions, "purchase", hours))


def synthetic_searches(actions: DataFrame, hours: int = 2) -> DataFrame:
    """A search with one result for every click that found none."""
    clicks = actions.where("kind = 'click'")
    found = attribute(actions, "click", hours, same_term=True).select("event_id")
    return clicks.join(found, "event_id", "left_anti").select("event_id", "shop_id", "session_token", "ts", "term", "product_id", F.lit(1).alias("results_count"))


def attributed_searches(actions: DataFrame, click_hours: int = 2, cart_hours: int = 2, purchase_hours: int = 24, overwrite: bool = False) -> DataFrame:
    """Every recorded search with clicked, converted, purchased, product_id, revenue and order_id.

    Revenue of several orders of a search is summed; with ``overwrite`` the last order's stands alone.
    """
    clicks = attribute(actions, "click", click_hours, same_term=True)
    carts = attribute(actions, "add_to_cart", cart_hours)
    orders = attributed_orders(actions, purchase_hours)
    both = clicks.withColumn("what", F.lit("click")).unionByName(carts.withColumn("what", F.lit("cart"))).unionByName(orders.withColumn("what", F.lit("order")))
    is_ = lambda w: F.col("what") == w
    last = lambda c: F.max_by(F.when(is_("order"), F.col(c)), F.when(is_("order"), F.struct("ts", "event_id")))
    per = both.groupBy("search_id").agg(
        F.max(is_("click")).alias("clicked"), F.max(is_("cart") | is_("order")).alias("converted"), F.max(is_("order")).alias("purchased"),
        F.min_by(F.when(~is_("order"), F.col("product_id")), F.when(~is_("order"), F.struct("ts", "event_id"))).alias("product_id"),
        (last("revenue") if overwrite else F.sum(F.when(is_("order"), F.col("revenue")))).alias("revenue"), (last("order_id") if overwrite else F.max(F.when(is_("order"), F.col("order_id")))).alias("order_id"),
    )
    base = record_searches(actions).select(F.col("event_id").alias("search_id"), "shop_id", "session_token", "ts", "term", "results_count")
    no = F.lit(False)
    return base.join(per, "search_id", "left").withColumns({c: F.coalesce(c, no) for c in ("clicked", "converted", "purchased")})


def popularity_increments(actions: DataFrame, purchase_hours: int = 24) -> DataFrame:
    """What clicks, carts and attributed orders add to each product."""
    light = actions.where(F.col("kind").isin("click", "add_to_cart") & F.col("product_id").isNotNull()).select("shop_id", "product_id", F.when(F.col("kind") == "click", POPULARITY["click"]).otherwise(POPULARITY["add_to_cart"]).alias("w"))
    bought = attributed_orders(actions, purchase_hours).where("product_id IS NOT NULL")
    heavy = bought.select("shop_id", "product_id", F.lit(POPULARITY["purchase"]).alias("w"))
    return light.unionByName(heavy).groupBy("shop_id", "product_id").agg(F.sum("w").alias("increment"))


def cap_events(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """At most ``limit`` events of a token per fixed window; a window starts at the first event after the last one ended."""

    def keep(state: tuple | None, at: int, marked: bool) -> tuple[bool, tuple]:
        start, n = state if state is not None and at - state[0] < seconds * 1_000_000 else (at, 0)
        return n < limit, (start, n + 1)

    return events.join(_folded(events, ["shop_id", "session_token"], keep), "event_id", "left_semi")


def retain(events: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))


def expire_tokens(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    old = F.col("ts") < F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return events.withColumn("session_token", F.when(~old, F.col("session_token")))


def decay_popularity(products: DataFrame, as_of: str, days: int = 30, factor: float = 0.5) -> DataFrame:
    """Halves popularity that was not decayed for ``days``; a product never decayed is due."""
    now = F.lit(as_of).cast("timestamp")
    due = (F.col("popularity") > 0) & (F.col("decayed_at").isNull() | (F.col("decayed_at") < now - F.make_interval(days=F.lit(days))))
    return products.withColumns({"popularity": F.when(due, F.col("popularity") * factor).otherwise(F.col("popularity")), "decayed_at": F.when(due, now).otherwise(F.col("decayed_at"))})
