"""Registered queries of the reports and event jobs, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallgrid.functions.text import ab_bucket
from stallgrid.operators import analytics as A
from stallgrid.operators import events as E
from stallgrid.operators import partials as PA
from stallgrid.operators import recommend as R
from stallgrid.operators.scratch import written
from stallgrid.plans.search_sql import grams, jaccard, whole_grams
from stallgrid.plans.fixtures import AS_OF, Tables, shared_folder, with_views

#: Longer attribution windows than the defaults: the events are sparse.
HOURS = {"click_hours": 24, "cart_hours": 24, "purchase_hours": 24}


def searches(spark, d):
    """Attributed searches of the given events."""
    return E.attributed_searches(Tables(spark, d).actions(), **HOURS).withColumn("bucket", ab_bucket(F.col("session_token")))


_ATTR = """
last_search AS (
  SELECT event_id, shop_id, session_token, ts, kind, term, product_id, order_id, revenue,
    last_value(CASE WHEN kind = 'search' THEN {{'id': event_id, 'ts': ts}} END IGNORE NULLS) OVER (PARTITION BY shop_id, session_token ORDER BY ts, kind <> 'search', event_id ROWS UNBOUNDED PRECEDING) AS s,
    last_value(CASE WHEN kind = 'search' THEN {{'id': event_id, 'ts': ts}} END IGNORE NULLS) OVER (PARTITION BY shop_id, session_token, term ORDER BY ts, kind <> 'search', event_id ROWS UNBOUNDED PRECEDING) AS st
  FROM v_actions),
click AS (SELECT event_id, shop_id, product_id, ts, st.id AS search_id FROM last_search WHERE kind = 'click' AND st.ts >= ts - INTERVAL {h} HOUR),
cart AS (SELECT event_id, shop_id, product_id, ts, s.id AS search_id FROM last_search WHERE kind = 'add_to_cart' AND s.ts >= ts - INTERVAL {h} HOUR),
bought AS (SELECT event_id, shop_id, product_id, ts, order_id, revenue, s.id AS search_id FROM last_search WHERE kind = 'purchase' AND s.ts >= ts - INTERVAL {h} HOUR QUALIFY row_number() OVER (PARTITION BY shop_id, order_id ORDER BY ts, event_id) = 1)"""


def _attr(h=24):
    return _ATTR.format(h=h)


# Click attribution by a plain inequality join, apart from the window form above.
_CLICK = """SELECT a.event_id, max_by(s.event_id, (s.ts, s.event_id)) AS search_id
FROM v_actions a JOIN v_actions s ON s.kind = 'search' AND a.kind = '{kind}' AND s.shop_id = a.shop_id AND s.session_token = a.session_token {term}
 AND s.ts <= a.ts AND s.ts >= a.ts - INTERVAL {h} HOUR GROUP BY a.event_id"""

_SEARCHES = (
    _attr()
    + """,
per AS (
  SELECT search_id, bool_or(what = 'click') AS clicked, true AS converted_any, bool_or(what IN ('cart', 'order')) AS converted, bool_or(what = 'order') AS purchased,
         min_by(CASE WHEN what <> 'order' THEN product_id END, (ts, event_id)) FILTER (what <> 'order') AS product_id, sum(revenue) AS revenue
  FROM (SELECT search_id, 'click' AS what, product_id, ts, event_id, NULL AS revenue FROM click UNION ALL SELECT search_id, 'cart', product_id, ts, event_id, NULL FROM cart
        UNION ALL SELECT search_id, 'order', product_id, ts, event_id, revenue FROM bought) GROUP BY search_id),
searches AS (
  SELECT a.event_id AS search_id, a.shop_id, a.session_token, a.ts, a.term, a.results_count, coalesce(p.clicked, false) AS clicked, coalesce(p.converted, false) AS converted,
         coalesce(p.purchased, false) AS purchased, p.product_id, p.revenue
  FROM v_actions a LEFT JOIN per p ON p.search_id = a.event_id WHERE a.kind = 'search')"""
)
_NOW = f"TIMESTAMP '{AS_OF}'"
_WIN = f"ts >= {_NOW} - INTERVAL 30 DAY AND ts <= {_NOW}"
_FUN = "count(*) AS searches, count(*) FILTER (clicked) AS clicks, count(*) FILTER (converted) AS conversions, count(*) FILTER (purchased) AS purchases, round(coalesce(sum(revenue) FILTER (purchased), 0), 4) AS revenue, count(*) FILTER (results_count = 0) AS zero_results"


def _on_searches(sql: str) -> str:
    return with_views(_SEARCHES + sql, "v_actions", "v_products")


def _rate(a, b="searches"):
    return f"CASE WHEN {b} > 0 THEN round(({a}) / {b}::DOUBLE * 1000) / 10 ELSE 0.0::DOUBLE END"


def _ranked(g: str, k: int, order: str) -> str:
    return f", g AS ({g}), r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY {order}) AS rank FROM g) SELECT * FROM r WHERE rank <= {k}"


def _first(df):
    return df.withColumn("rank", F.col("rank").cast("bigint")) if "rank" in df.columns else df


def _syn(spark, d):
    s = spark.createDataFrame([("shop0", "hot bolt", ["screw"]), ("shop1", None, ["plate", "plat"])], "shop_id string, input string, terms array<string>")
    # Terms that no title holds as they are, made from the given events.
    odd = searches(spark, d).withColumn("term", F.regexp_replace("term", "[aeiou]", "e"))
    return _first(A.synonym_candidates(odd, Tables(spark, d).products(), s, AS_OF))


def _plan_window(spark, d):
    """Every shop's searches of 60 days, as far back as its plan goes: a name of no plan, growth, pro, and pro under an override."""
    rows = searches(spark, d)
    plan = F.when(F.col("shop_id") == "shop0", "starter").when(F.col("shop_id") == "shop1", "growth").otherwise("pro")
    days = A.clamp_days(rows.select("shop_id").distinct().withColumn("plan_name", plan).withColumn("plan_override", F.when(F.col("shop_id") == "shop3", "free").otherwise("none")), 60)
    now = F.lit(AS_OF).cast("timestamp")
    kept = rows.join(days, "shop_id").where((F.col("ts") <= now) & (F.col("ts") >= now - F.make_interval(days=F.col("days"))))
    return kept.groupBy("shop_id", F.col("days").cast("bigint").alias("days")).agg(F.count("*").alias("searches"))


def partials(spark, d):
    """Reports from partials of three batches: the first half of the searches before what came of them was known, those again as they are, and the others, which are earlier and later."""
    rows = searches(spark, d).select("search_id", "shop_id", "ts", "term", "results_count", "clicked", "converted", "purchased", "revenue", "product_id", "bucket")
    # All batches are cut out of the attributed searches, which are worked out once.
    rows = written(rows)
    no = F.lit(False)
    first = rows.where("search_id % 2 = 0").withColumns({"clicked": no, "converted": no, "purchased": no, "revenue": F.lit(None).cast("double"), "product_id": F.lit(None).cast("string")})
    folder = f"{shared_folder(spark)}/partials-{uuid.uuid4().hex}"
    PA.write_partials(folder, 0, first)
    PA.write_partials(folder, 1, rows.where("search_id % 2 = 0"), first)
    PA.write_partials(folder, 2, rows.where("search_id % 2 = 1"))
    return PA.Reports(spark, folder, AS_OF)


QUERIES = {
    "partial_funnel_totals": lambda s, d: partials(s, d).funnel_totals(15),
    "partial_period_delta": lambda s, d: partials(s, d).period_delta(15),
    "partial_top_terms": lambda s, d: _first(partials(s, d).top_terms()),
    "partial_zero_terms": lambda s, d: _first(partials(s, d).zero_terms()),
    "partial_top_clicked": lambda s, d: _first(partials(s, d).top_clicked(Tables(s, d).products())),
    "partial_daily_series": lambda s, d: partials(s, d).daily_series().withColumn("day", F.col("day").cast("string")),
    "partial_ab_arms": lambda s, d: partials(s, d).ab_arms(),
    "partial_activity_share": lambda s, d: _first(partials(s, d).activity()),
    "plan_window": _plan_window,
    "funnel_totals": lambda s, d: A.funnel_totals(searches(s, d), AS_OF, 15),
    "funnel_rates": lambda s, d: A.funnel_rates(A.funnel_totals(searches(s, d), AS_OF)).drop("revenue"),
    "period_delta": lambda s, d: A.period_delta(A.funnel_totals(searches(s, d), AS_OF, 15)),
    "top_terms": lambda s, d: _first(A.top_terms(searches(s, d), AS_OF)),
    "zero_terms": lambda s, d: _first(A.zero_terms(searches(s, d), AS_OF)),
    "no_click_terms": lambda s, d: _first(A.no_click_terms(searches(s, d).withColumn("term", F.concat_ws(" ", "term", (F.col("search_id") % 500).cast("string"))), AS_OF, least=2)),
    "top_clicked": lambda s, d: _first(A.top_clicked(searches(s, d), Tables(s, d).products(), AS_OF)),
    "daily_series": lambda s, d: A.daily_series(searches(s, d), AS_OF).withColumn("day", F.col("day").cast("string")),
    "ab_arms": lambda s, d: A.ab_arms(searches(s, d), AS_OF),
    "activity_share": lambda s, d: _first(A.activity(searches(s, d), AS_OF)),
    "dashboard_counts": lambda s, d: A.dashboard_counts(searches(s, d), Tables(s, d).products(), AS_OF),
    "synonym_candidates": _syn,
    "attributed_searches": lambda s, d: searches(s, d).select("search_id", "clicked", "converted", "purchased", "product_id", F.round("revenue", 4).alias("revenue")),
    "search_dedup": lambda s, d: E.collapse_repeats(E.record_searches(Tables(s, d).actions()).withColumn("session_token", F.when(F.col("event_id") % 5 != 0, F.col("session_token"))), 6 * 3600).select("event_id"),
    "click_attribution": lambda s, d: E.attribute(Tables(s, d).actions(), "click", 24, same_term=True).select("event_id", "search_id"),
    "cart_attribution": lambda s, d: E.attribute(Tables(s, d).actions(), "add_to_cart", 2).select("event_id", "search_id"),
    "purchase_attribution": lambda s, d: E.attribute(Tables(s, d).actions(), "purchase", 24).select("event_id", "search_id"),
    "unique_orders": lambda s, d: E.unique_orders(Tables(s, d).actions().where("kind = 'purchase'")).select("shop_id", "order_id", "event_id"),
    "synthetic_searches": lambda s, d: E.synthetic_searches(Tables(s, d).actions()).select("event_id", "shop_id", "term", "results_count"),
    "popularity": lambda s, d: E.popularity_increments(Tables(s, d).actions()),
    "event_cap": lambda s, d: E.cap_events(Tables(s, d).actions(), 3, 5 * 24 * 3600).groupBy("shop_id", "session_token").agg(F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids")),
    "retention": lambda s, d: E.retain(Tables(s, d).actions(), AS_OF, 20).select("event_id"),
    "token_expiry": lambda s, d: E.expire_tokens(Tables(s, d).actions(), AS_OF, 24).select("event_id", "session_token"),
    "beacon_sanitize": lambda s, d: E.sanitize_beacons(Tables(s, d).actions().select("event_id", F.col("kind").alias("type"), F.repeat("session_token", F.lit(20)).alias("session_token"), (F.col("revenue") * 1e4 - 2e5).alias("revenue"), F.array("product_id", F.lit("x1")).alias("product_ids"), "order_id")).select("event_id", "type", "session_token", F.round("revenue", 4).alias("revenue"), F.array_join("product_ids", ",").alias("product_ids"), "order_id"),
    "popularity_decay": lambda s, d: E.decay_popularity(Tables(s, d).products().withColumn("decayed_at", F.when(F.col("product_id").cast("int") % 3 != 0, F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.col("product_id").cast("int") % 60))), AS_OF).select("product_id", F.round("popularity", 6).alias("popularity")),
    "ab_bucket": lambda s, d: Tables(s, d).actions().select("event_id", ab_bucket(F.col("session_token")).alias("bucket")),
    "trending": lambda s, d: _first(R.trending(searches(s, d), Tables(s, d).products(), AS_OF)),
    "prefix_completions": lambda s, d: _first(R.prefix_completions(E.record_searches(Tables(s, d).actions()))),
    "recently_viewed": lambda s, d: _first(R.recently_viewed(Tables(s, d).actions())).select("session_token", "product_id", "rank"),
    "recent_searches": lambda s, d: _first(R.recent_searches(Tables(s, d).actions())).select("session_token", "term", "rank"),
    "empty_box": lambda s, d: _first(R.empty_box(searches(s, d), Tables(s, d).products(), AS_OF)),
}

_FOLD = """
t AS (SELECT event_id, shop_id, term, CASE WHEN event_id % 5 <> 0 THEN session_token END AS tok, ts FROM v_actions WHERE kind = 'search'),
k(event_id, shop_id, tok, term, ts) AS (
  SELECT * FROM (SELECT event_id, shop_id, tok, term, ts FROM t WHERE tok IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shop_id, tok, term ORDER BY ts, event_id) = 1)
  UNION ALL
  SELECT * FROM (SELECT n.event_id, n.shop_id, n.tok, n.term, n.ts FROM k JOIN t n ON n.shop_id = k.shop_id AND n.tok = k.tok AND n.term = k.term AND n.ts > k.ts + INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY n.shop_id, n.tok, n.term ORDER BY n.ts, n.event_id) = 1)),
bare AS (SELECT b.event_id, b.shop_id, b.term, b.ts FROM t b WHERE tok IS NULL AND NOT EXISTS (
  SELECT 1 FROM k o WHERE o.shop_id = b.shop_id AND o.term = b.term AND (o.ts, o.event_id) < (b.ts, b.event_id) AND o.ts >= b.ts - INTERVAL 6 HOUR)),
kb(event_id, shop_id, term, ts) AS (
  SELECT * FROM (SELECT event_id, shop_id, term, ts FROM bare QUALIFY row_number() OVER (PARTITION BY shop_id, term ORDER BY ts, event_id) = 1)
  UNION ALL
  SELECT * FROM (SELECT n.event_id, n.shop_id, n.term, n.ts FROM kb JOIN bare n ON n.shop_id = kb.shop_id AND n.term = kb.term AND n.ts > kb.ts + INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY n.shop_id, n.term ORDER BY n.ts, n.event_id) = 1))
SELECT event_id FROM k UNION ALL SELECT event_id FROM kb"""

_SELL = "SELECT * FROM v_products WHERE status = 'ACTIVE' AND published_online AND available"
_BEST = f"SELECT shop_id, product_id, popularity, published_at, row_number() OVER (PARTITION BY shop_id ORDER BY popularity DESC, published_at DESC NULLS LAST, product_id) AS rank FROM ({_SELL})"

_DELTA = f""", w AS (SELECT shop_id, CASE WHEN ts >= {_NOW} - INTERVAL 15 DAY AND ts <= {_NOW} THEN 'current' WHEN ts >= {_NOW} - INTERVAL 30 DAY AND ts < {_NOW} - INTERVAL 15 DAY THEN 'previous' END AS period, * EXCLUDE (shop_id) FROM searches),
f AS (SELECT shop_id, period, {_FUN} FROM w WHERE period IS NOT NULL GROUP BY ALL)"""

# 32-bit FNV-1a over the token's characters.
_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS UBIGINT)) % 2 = 0"

# Windows of five days that begin at a session's first event after the last one ended; three events of each stay.
CAPPED = """
t AS (SELECT event_id, shop_id, session_token, ts FROM v_actions),
k(shop_id, session_token, ts) AS (
  SELECT shop_id, session_token, min(ts) FROM t GROUP BY ALL
  UNION ALL
  SELECT k.shop_id, k.session_token, min(n.ts) FROM k JOIN t n ON n.shop_id = k.shop_id AND n.session_token = k.session_token AND n.ts >= k.ts + INTERVAL 120 HOUR GROUP BY k.shop_id, k.session_token),
w AS (SELECT t.event_id, t.shop_id, t.session_token, row_number() OVER (PARTITION BY t.shop_id, t.session_token, k.ts ORDER BY t.ts, t.event_id) AS n
  FROM t JOIN k ON k.shop_id = t.shop_id AND k.session_token = t.session_token AND t.ts >= k.ts AND t.ts < k.ts + INTERVAL 120 HOUR)
"""

_ODD = r"regexp_replace(term, '[aeiou]', 'e', 'g')"
ORACLE_SQL = {
    "plan_window": _on_searches(f" SELECT shop_id, days, count(*) AS searches FROM (SELECT *, CAST(CASE shop_id WHEN 'shop1' THEN 30 WHEN 'shop2' THEN 60 ELSE 7 END AS BIGINT) AS days FROM searches) WHERE ts <= {_NOW} AND ts >= {_NOW} - to_days(days::INT) GROUP BY ALL"),
    "synonym_candidates": _on_searches(f""", z AS (SELECT shop_id, {_ODD} AS term, count(*) AS searches FROM searches WHERE results_count = 0 AND {_WIN} AND length(trim(term)) >= 3 GROUP BY ALL),
zt AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY searches DESC, term) <= 40), terms AS (SELECT * FROM zt WHERE NOT (shop_id = 'shop0' AND term IN ('hot bolt', 'screw')) AND NOT (shop_id = 'shop1' AND term IN ('plate', 'plat'))),
titles AS (SELECT DISTINCT shop_id, title FROM v_products),
near AS (SELECT shop_id, term, searches, title FROM (SELECT t.shop_id, term, searches, title, {jaccard(grams('term'), grams('title'))} AS sim, len(list_intersect({grams('term')}, {grams('title')})) AS n FROM terms t JOIN titles USING (shop_id)) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY shop_id, term ORDER BY sim DESC, title DESC) = 1),
w AS (SELECT *, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3))) AS word FROM near),
ws AS (SELECT *, round({jaccard(whole_grams('word'), whole_grams('term'))}, 6) AS sim FROM w), best AS (SELECT * FROM ws WHERE sim > 0.3 QUALIFY row_number() OVER (PARTITION BY shop_id, term ORDER BY sim DESC, word DESC) = 1)
SELECT * FROM (SELECT shop_id, term, searches, title, word, sim, row_number() OVER (PARTITION BY shop_id ORDER BY searches DESC, term) AS rank FROM best) WHERE rank <= 10"""),
    "event_cap": with_views(CAPPED + "SELECT shop_id, session_token, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM w WHERE n <= 3 GROUP BY ALL", "v_actions").replace("WITH ", "WITH RECURSIVE ", 1),
    "ab_bucket": with_views(f"SELECT event_id, CASE WHEN {_FNV.format('session_token')} THEN 'a' ELSE 'b' END AS bucket FROM v_actions", "v_actions"),
    "ab_arms": _on_searches(f", b AS (SELECT *, CASE WHEN {_FNV.format('session_token')} THEN 'a' ELSE 'b' END AS bucket FROM searches WHERE {_WIN}), f AS (SELECT shop_id, bucket, {_FUN} FROM b GROUP BY ALL), r AS (SELECT *, {_rate('purchases')} AS purchase_rate FROM f) SELECT *, purchase_rate = max(purchase_rate) OVER (PARTITION BY shop_id) AND min(purchase_rate) OVER (PARTITION BY shop_id) < purchase_rate AND searches >= 20 AS winner FROM r"),
    "funnel_totals": _on_searches(_DELTA + " SELECT * FROM f"),
    "funnel_rates": _on_searches(f", f AS (SELECT shop_id, 'current' AS period, {_FUN} FROM searches WHERE {_WIN} GROUP BY shop_id) SELECT * EXCLUDE (revenue), {_rate('clicks')} AS click_rate, {_rate('conversions')} AS conversion_rate, {_rate('purchases')} AS purchase_rate, {_rate('zero_results')} AS zero_rate, {_rate('searches - clicks')} AS no_click_rate FROM f"),
    "period_delta": _on_searches(_DELTA + f""", x AS (SELECT *, {_rate('clicks')} AS click_rate, {_rate('zero_results')} AS zero_rate FROM f),
u AS (SELECT shop_id, period, unnest(['searches', 'revenue', 'click_rate', 'zero_rate']) AS figure, unnest([searches::DOUBLE, revenue, click_rate, zero_rate]) AS v FROM x),
j AS (SELECT a.shop_id, a.figure, CASE WHEN coalesce(b.v, 0) <> 0 THEN round(CASE WHEN a.figure LIKE '%rate' THEN a.v - b.v ELSE (a.v - b.v) / b.v * 100 END, 1) END AS delta
  FROM u a LEFT JOIN u b ON b.period = 'previous' AND b.shop_id = a.shop_id AND b.figure = a.figure WHERE a.period = 'current')
SELECT *, CASE WHEN delta IS NULL THEN 'none' WHEN abs(delta) < 0.1 THEN 'no change' WHEN (delta > 0) = (figure <> 'zero_rate') THEN 'good' ELSE 'bad' END AS tone FROM j"""),
    "top_terms": _on_searches(_ranked(f"SELECT shop_id, term, searches, avg_results, clicks, {_rate('clicks')} AS ctr FROM (SELECT shop_id, term, count(*) AS searches, round(avg(results_count), 4) AS avg_results, count(*) FILTER (clicked) AS clicks FROM searches WHERE {_WIN} GROUP BY ALL)", 25, "searches DESC, term")),
    "zero_terms": _on_searches(_ranked(f"SELECT shop_id, term, count(*) AS searches FROM searches WHERE {_WIN} AND results_count = 0 GROUP BY ALL", 25, "searches DESC, term")),
    "no_click_terms": _on_searches(_ranked(f"SELECT shop_id, term, searches FROM (SELECT shop_id, term || ' ' || (search_id % 500) AS term, count(*) AS searches, count(*) FILTER (clicked) AS c FROM searches WHERE {_WIN} AND results_count > 0 GROUP BY ALL) WHERE c = 0 AND searches >= 2", 25, "searches DESC, term")),
    "top_clicked": _on_searches(f", g AS (SELECT shop_id, product_id, count(*) AS clicks FROM searches WHERE {_WIN} AND clicked AND product_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY clicks DESC, product_id) AS rank FROM g) SELECT r.*, coalesce(p.title, '(removed product)') AS title FROM r LEFT JOIN v_products p ON p.shop_id = r.shop_id AND p.product_id = r.product_id WHERE rank <= 15"),
    "daily_series": _on_searches(f", c AS (SELECT shop_id, CAST(unnest(range(CAST(CAST({_NOW} - INTERVAL 30 DAY AS DATE) AS TIMESTAMP), {_NOW} + INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT shop_id FROM searches)) SELECT c.shop_id, CAST(c.day AS VARCHAR) AS day, count(s.search_id) AS searches, count(*) FILTER (s.clicked) AS clicks FROM c LEFT JOIN searches s ON s.shop_id = c.shop_id AND CAST(s.ts AS DATE) = c.day AND s.ts <= {_NOW} GROUP BY ALL"),
    "activity_share": _on_searches(f", g AS (SELECT shop_id, term, count(*) AS searches FROM searches WHERE ts >= {_NOW} - INTERVAL 7 DAY AND ts <= {_NOW} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY searches DESC, term) AS rank FROM g) SELECT *, round(searches / max(searches) OVER (PARTITION BY shop_id)::DOUBLE, 6) AS share FROM r WHERE rank <= 10"),
    "dashboard_counts": _on_searches(f", w AS (SELECT shop_id, count(*) AS searches, count(*) FILTER (clicked) AS clicks, count(*) FILTER (results_count = 0) AS zero_results FROM searches WHERE ts >= {_NOW} - INTERVAL 7 DAY AND ts <= {_NOW} GROUP BY 1) SELECT p.shop_id, p.catalog, coalesce(searches, 0) AS searches, coalesce(clicks, 0) AS clicks, coalesce(zero_results, 0) AS zero_results FROM (SELECT shop_id, count(*) AS catalog FROM v_products GROUP BY 1) p LEFT JOIN w ON w.shop_id = p.shop_id"),
    "attributed_searches": _on_searches(" SELECT search_id, clicked, converted, purchased, product_id, round(revenue, 4) AS revenue FROM searches"),
    "search_dedup": with_views(_FOLD, "v_actions").replace("WITH ", "WITH RECURSIVE ", 1),
    "click_attribution": with_views(_CLICK.format(kind="click", term="AND s.term = a.term", h=24), "v_actions"),
    "cart_attribution": with_views(_CLICK.format(kind="add_to_cart", term="", h=2), "v_actions"),
    "purchase_attribution": with_views(_CLICK.format(kind="purchase", term="", h=24), "v_actions"),
    "unique_orders": with_views("SELECT shop_id, order_id, min_by(event_id, (ts, event_id)) AS event_id FROM v_actions WHERE kind = 'purchase' GROUP BY ALL", "v_actions"),
    "synthetic_searches": with_views("SELECT event_id, shop_id, term, 1 AS results_count FROM v_actions a WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM v_actions s WHERE s.kind = 'search' AND s.shop_id = a.shop_id AND s.session_token = a.session_token AND s.term = a.term AND s.ts <= a.ts AND s.ts >= a.ts - INTERVAL 2 HOUR)", "v_actions"),
    "popularity": with_views(_attr() + " SELECT shop_id, product_id, CAST(sum(w) AS DOUBLE) AS increment FROM (SELECT shop_id, product_id, CASE WHEN kind = 'click' THEN 1 ELSE 5 END AS w FROM v_actions WHERE kind IN ('click', 'add_to_cart') UNION ALL SELECT shop_id, product_id, 25 FROM (SELECT DISTINCT shop_id, product_id, order_id FROM bought)) GROUP BY ALL", "v_actions"),
    "retention": with_views(f"SELECT event_id FROM v_actions WHERE ts >= {_NOW} - INTERVAL 20 DAY", "v_actions"),
    "token_expiry": with_views(f"SELECT event_id, CASE WHEN ts >= {_NOW} - INTERVAL 24 HOUR THEN session_token END AS session_token FROM v_actions", "v_actions"),
    "beacon_sanitize": with_views("SELECT event_id, kind AS type, substr(repeat(session_token, 20), 1, 64) AS session_token, round(greatest(0, least(1e6, revenue * 1e4 - 2e5)), 4) AS revenue, product_id AS product_ids, order_id FROM v_actions WHERE kind <> 'search'", "v_actions"),
    "popularity_decay": with_views(f"SELECT product_id, round(CASE WHEN popularity > 0 AND (CAST(product_id AS INT) % 3 = 0 OR CAST(product_id AS INT) % 60 > 30) THEN popularity * 0.5 ELSE popularity END, 6) AS popularity FROM v_products", "v_products"),
    "trending": _on_searches(f", g AS (SELECT s.shop_id, s.product_id, count(*) AS clicks FROM searches s JOIN ({_SELL}) p ON p.shop_id = s.shop_id AND p.product_id = s.product_id WHERE s.clicked AND s.ts >= {_NOW} - INTERVAL 7 DAY AND s.ts <= {_NOW} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY clicks DESC, product_id) AS rank FROM g) SELECT * FROM r WHERE rank <= 12 UNION ALL SELECT shop_id, product_id, 0, rank FROM ({_BEST}) b WHERE rank <= 12 AND shop_id NOT IN (SELECT shop_id FROM r)"),
    "prefix_completions": with_views(", ".join(["t AS (SELECT shop_id, lower(term) AS term, count(*) AS n FROM v_actions WHERE kind = 'search' AND results_count > 0 GROUP BY ALL)", "p AS (SELECT shop_id, term, n, substr(term, 1, i) AS prefix FROM (SELECT *, unnest(range(1, length(term) + 1)) AS i FROM t))"]) + " SELECT * FROM (SELECT shop_id, prefix, term, n, row_number() OVER (PARTITION BY shop_id, prefix ORDER BY n DESC, term) AS rank FROM p) WHERE rank <= 5 AND term <> prefix", "v_actions"),
    "recently_viewed": with_views("SELECT session_token, product_id, rank FROM (SELECT session_token, product_id, row_number() OVER (PARTITION BY shop_id, session_token ORDER BY max(ts) DESC, product_id) AS rank FROM v_actions WHERE kind <> 'search' GROUP BY shop_id, session_token, product_id) WHERE rank <= 20", "v_actions"),
    "recent_searches": with_views("SELECT session_token, term, rank FROM (SELECT session_token, term, row_number() OVER (PARTITION BY shop_id, session_token ORDER BY max(ts) DESC, term) AS rank FROM v_actions WHERE kind = 'search' GROUP BY shop_id, session_token, term) WHERE rank <= 8", "v_actions"),
    "empty_box": _on_searches(f""", b AS ({_BEST}),
c AS (SELECT shop_id, collection AS value, row_number() OVER (PARTITION BY shop_id ORDER BY count(*) DESC, collection) AS rank FROM v_products WHERE status = 'ACTIVE' AND published_online GROUP BY shop_id, collection),
t AS (SELECT shop_id, term AS value, row_number() OVER (PARTITION BY shop_id ORDER BY count(*) DESC, term) AS rank FROM searches WHERE results_count > 0 AND {_WIN} GROUP BY shop_id, term)
SELECT shop_id, 'product' AS kind, product_id AS value, rank FROM b WHERE rank <= 6 UNION ALL SELECT shop_id, 'collection', value, rank FROM c WHERE rank <= 6 UNION ALL SELECT shop_id, 'term', value, rank FROM t WHERE rank <= 6"""),
}
ORACLE_SQL |= {f"partial_{k}": ORACLE_SQL[k] for k in ("funnel_totals", "period_delta", "top_terms", "zero_terms", "top_clicked", "ab_arms", "activity_share")}
# Whole days before the midnight: not the day that begins with it.
ORACLE_SQL["partial_daily_series"] = f"SELECT * FROM ({ORACLE_SQL['daily_series']}) WHERE day < '{AS_OF[:10]}'"
