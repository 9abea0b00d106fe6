"""DuckDB SQL of the text search: candidates, cover density, scores, rules, pins, spelling.

Where the Spark jobs fold over matched places, this text uses windows: the last place of every token up to each
match, the start of the cover from those, and the covers whose start moved on.
"""

from __future__ import annotations

from stallgrid.plans.fixtures import with_views
from stallgrid.plans.requests import TEXT, requests_cte

# The phrases of each request, its own first, as its synonyms expand it.
PHRASES = [(21, ["red widget"]), (22, ["hot bolt", "screw"]), (23, ["blue plat", "plate", "plat"]), (24, ["sku4"]), (25, ["small ring"]), (26, ["wdget"]), (27, ["economy"]), (28, ["the ring"]), (29, ["r"]), (30, ["gren gear", "bolt", "ring"]), (31, ["plate", "plat"]), (32, ["hot"])]


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(strip_accents({text})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def grams(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def whole_grams(word: str) -> str:
    return f"list_distinct(list_transform(range(1, length({word}) + 2), lambda i: substr('  ' || {word} || ' ', i, 3)))"


def jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE"


def _groups(phrases: list) -> str:
    return "grp AS (" + " UNION ALL ".join("SELECT {} AS query_id, {} AS g, unnest([{}]) AS tok".format(q, n, ", ".join(f"'{w}'" for w in p.split())) for q, ps in phrases for n, p in enumerate(ps)) + ")"


_GROUPS = _groups(PHRASES)
_ELIGIBLE = "elig AS (SELECT * FROM v_products WHERE status = 'ACTIVE' AND published_online)"


def _weighted(text: str, inverse: float) -> str:
    return f"list_transform({tokens(text)}, lambda t: {{'t': t, 'inv': {inverse}::DOUBLE}})"


_FIELDS = [("title", 1), ("sku", 1), ("vendor", 2.5), ("product_type", 2.5), ("array_to_string(tags, ' ')", 2.5), ("description", 5)]
_ALL = "flatten([" + ", ".join(_weighted(f, w) for f, w in _FIELDS) + "])"

#: ranks: query_id, product_id, text_rank of every product that holds all words of a phrase.
RANKS = f"""{requests_cte(TEXT)}, {_ELIGIBLE}, {_GROUPS},
words AS (SELECT shop_id, product_id, {_ALL} AS l FROM elig),
place AS (SELECT shop_id, product_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM words),
hits AS (SELECT q.query_id, p.product_id, p.pos, p.x.t AS tok, p.x.inv AS inv FROM req q JOIN (SELECT DISTINCT query_id, tok FROM grp) g ON g.query_id = q.query_id JOIN place p ON p.shop_id = q.shop_id AND p.x.t = g.tok),
m AS (SELECT *, row_number() OVER w AS n, sum(inv) OVER w AS cum FROM hits WINDOW w AS (PARTITION BY query_id, product_id ORDER BY pos)),
lastp AS (SELECT m.query_id, m.product_id, m.pos, g.g, max(CASE WHEN m.tok = g.tok THEN m.pos END) OVER (PARTITION BY m.query_id, m.product_id, g.g, g.tok ORDER BY m.pos) AS last_pos FROM m JOIN grp g ON g.query_id = m.query_id),
begun AS (SELECT query_id, product_id, pos, g, CASE WHEN count(last_pos) = count(*) THEN min(last_pos) END AS start FROM lastp GROUP BY ALL),
cover AS (SELECT query_id, product_id, pos, max(start) AS start FROM begun GROUP BY ALL),
fresh AS (SELECT *, coalesce(max(start) OVER (PARTITION BY query_id, product_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM cover),
gain AS (SELECT f.query_id, f.product_id, e.n - s.n + 1 AS size, e.cum - s.cum + s.inv AS inv, f.pos - f.start AS span FROM fresh f JOIN m e USING (query_id, product_id, pos) JOIN m s ON s.query_id = f.query_id AND s.product_id = f.product_id AND s.pos = f.start WHERE f.start > f.before),
ranks AS (SELECT query_id, product_id, sum(size / inv / (1 + span - (size - 1))) AS text_rank FROM gain GROUP BY ALL)"""

_HAS = "len(coalesce(q.filters['{0}'], [])) = 0 OR coalesce(list_contains(q.filters['{0}'], {1}), false)"

#: trow: candidates of the text requests with their score parts; ok says that a row passes every filter.
ROWS = RANKS + f""",
tt AS (SELECT DISTINCT shop_id, lower(title) AS t FROM elig),
sims AS (SELECT query_id, shop_id, t, sim FROM (SELECT q.query_id, q.shop_id, t, {jaccard(grams('q.term'), grams('t'))} AS sim FROM req q JOIN tt ON tt.shop_id = q.shop_id) WHERE sim > 0.2),
base AS (SELECT q.query_id, p.product_id, r.text_rank, s.sim, contains(lower(p.title), lower(q.term)) AS inside, lower(trim(q.term)) = lower(p.sku) AS is_sku
  FROM req q JOIN elig p ON p.shop_id = q.shop_id LEFT JOIN ranks r ON r.query_id = q.query_id AND r.product_id = p.product_id LEFT JOIN sims s ON s.query_id = q.query_id AND s.t = lower(p.title)),
trow AS (SELECT q.query_id, q.page, q.per_page, q.sort, lower(q.term) AS norm, p.*, b.is_sku,
    4 * coalesce(b.text_rank, 0) AS x_text, 2 * coalesce(b.sim, 0) AS x_similarity, CASE WHEN starts_with(lower(p.title), lower(q.term)) THEN 1.5 ELSE 0 END AS x_prefix,
    0.3 * ln(1 + p.popularity) AS x_popularity, CASE WHEN b.is_sku THEN 50.0 ELSE 0 END AS x_sku,
    ({_HAS.format('vendor', 'p.vendor')}) AND (p.available OR q.include_unavailable) AS ok
  FROM base b JOIN req q ON q.query_id = b.query_id JOIN elig p ON p.product_id = b.product_id AND p.shop_id = q.shop_id
  WHERE b.text_rank IS NOT NULL OR b.inside OR b.sim IS NOT NULL OR b.is_sku)"""

_ORDER = """CASE sort WHEN 'price_asc' THEN -price_min WHEN 'title_desc' THEN NULL ELSE round(score, 9) END DESC NULLS LAST, CASE WHEN sort = 'title_desc' THEN title END DESC NULLS LAST,
    CASE WHEN sort = 'relevance' THEN popularity END DESC NULLS LAST, product_id"""
_PAGE = "rank > (page - 1) * per_page AND rank <= page * per_page"
# Rule 1 serves request 21 (pins 5 and 17, boosts, buries), rule 2 all requests of shop2 (bury tag hot by 7, boost
# vendor brand#1 by 5, hide material m4 and products without a material).
_RULED = """,
ruled AS (SELECT *, x_sku + CASE WHEN query_id = 21 AND product_id IN ('1', '33', '9') THEN 5.0 ELSE 0 END - CASE WHEN query_id = 21 AND product_id = '13' THEN 5.0 ELSE 0 END
    + CASE WHEN shop_id = 'shop2' AND list_contains(tags, 'hot') THEN -7.0 ELSE 0 END + CASE WHEN shop_id = 'shop2' AND contains(lower(vendor), 'brand#1') THEN 5.0 ELSE 0 END AS x_merchandising
  FROM {} WHERE shop_id <> 'shop2' OR coalesce(material <> 'm4', false))"""
_PINS = """,
pins(product_id, pin_no) AS (VALUES ('5', 0), ('17', 1)),
pinned AS (SELECT * FROM trow UNION ALL
  SELECT q.query_id, q.page, q.per_page, q.sort, lower(q.term) AS norm, p.*, false AS is_sku, 0.0 AS x_text, 0.0 AS x_similarity, CASE WHEN starts_with(lower(p.title), lower(q.term)) THEN 1.5 ELSE 0 END AS x_prefix,
    0.3 * ln(1 + p.popularity) AS x_popularity, 0.0 AS x_sku, p.available OR q.include_unavailable AS ok
  FROM req q JOIN elig p ON p.shop_id = q.shop_id JOIN pins USING (product_id) WHERE q.query_id = 21 AND NOT EXISTS (SELECT 1 FROM trow t WHERE t.query_id = 21 AND t.product_id = p.product_id))"""

#: Vectors of the text requests and their distances to the products of their shop.
_NEAR = """, vec AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS product_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.query_id, p.product_id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS dist FROM req q JOIN vec a ON a.vec_id = q.query_id % 4 + 4 * q.query_id JOIN vec b ON b.vec_id % 4 = CAST(q.shop_id[5] AS INT) JOIN elig p ON p.product_id = b.product_id
  WHERE 1 - list_cosine_similarity(a.e, b.e) < 0.62 AND (q.collection IS NULL OR p.collection = q.collection))"""
# Stems are words without their last letter, of words of titles with three letters and more.
_STEMMED = RANKS
for _what, _with in (
    ("words AS (", "stems AS (SELECT DISTINCT tok, left(tok, length(tok) - 1) AS stem FROM (SELECT unnest(" + tokens("title") + ") AS tok FROM v_products) WHERE length(tok) >= 3),\nsg AS (SELECT DISTINCT grp.query_id, g, coalesce(stem, grp.tok) AS tok FROM grp LEFT JOIN stems ON stems.tok = grp.tok),\nwords AS ("),
    ("place AS (SELECT shop_id, product_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM words)", "place0 AS (SELECT shop_id, product_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM words),\nplace AS (SELECT shop_id, product_id, pos, {'t': CASE WHEN starts_with(x.t, 'sku') THEN x.t ELSE coalesce(stem, x.t) END, 'inv': x.inv} AS x FROM place0 LEFT JOIN stems ON stems.tok = x.t)"),
    ("(SELECT DISTINCT query_id, tok FROM grp)", "(SELECT DISTINCT query_id, tok FROM sg)"), ("JOIN grp g ON g.query_id = m.query_id", "JOIN sg g ON g.query_id = m.query_id"),
):
    assert _what in _STEMMED
    _STEMMED = _STEMMED.replace(_what, _with)
_PLAIN = [(q, ps[:1]) for q, ps in PHRASES]

ORACLE_SQL = {
    "text_rank": with_views(RANKS + " SELECT query_id, product_id, round(text_rank, 6) AS text_rank FROM ranks", "v_products"),
    "search_ranked": with_views(ROWS + f", s AS (SELECT *, x_text + x_similarity + x_prefix + x_popularity + x_sku AS score FROM trow WHERE ok), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM s) SELECT query_id, rank, product_id, round(score, 6) AS score, CASE WHEN is_sku THEN 'sku' ELSE 'fulltext' END AS strategy FROM r WHERE {_PAGE}", "v_products"),
    "search_explain": with_views(ROWS + _RULED.format("trow") + " SELECT query_id, product_id, round(x_text, 6) AS x_text, round(x_similarity, 6) AS x_similarity, 0.0::DOUBLE AS x_semantic, x_prefix::DOUBLE AS x_prefix, round(x_popularity, 6) AS x_popularity, x_merchandising::DOUBLE AS x_merchandising FROM ruled WHERE ok", "v_products"),
    "pinned_page": with_views(ROWS + _PINS + _RULED.format("pinned") + f", s AS (SELECT *, x_text + x_similarity + x_prefix + x_popularity + x_merchandising AS score FROM ruled WHERE ok), r AS (SELECT s.*, pin_no IS NOT NULL AS pinned_hit, row_number() OVER (PARTITION BY query_id ORDER BY pin_no NULLS LAST, {_ORDER.replace('product_id', 's.product_id')}) AS rank FROM s LEFT JOIN pins ON pins.product_id = s.product_id AND s.query_id = 21) SELECT query_id, rank, product_id, pinned_hit FROM r WHERE {_PAGE}", "v_products"),
    "search_composed": with_views(ROWS + _PINS + _RULED.format("pinned") + " SELECT query_id, count(*) AS total, '' AS url FROM ruled WHERE ok AND query_id <> 21 GROUP BY 1 UNION ALL SELECT 21, 0, '/pages/red'", "v_products"),
    "product_suggestions": with_views(ROWS + ", s AS (SELECT *, round(x_text + x_similarity + CASE WHEN x_prefix > 0 THEN 2 ELSE 0 END, 9) AS s FROM trow WHERE ok) SELECT query_id, product_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, popularity DESC, product_id) AS rank FROM s) WHERE rank <= 6", "v_products"),
    "search_hybrid": with_views(ROWS + _NEAR + f""",
pair AS (SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.product_id, n.product_id) AS product_id, n.dist, t.query_id IS NOT NULL AND (t.x_text > 0 OR contains(lower(t.title), t.norm)) AS fulltext, coalesce(t.is_sku, false) AS is_sku, coalesce(t.x_text, 0) AS x_text, coalesce(t.x_similarity, 0) AS x_similarity FROM trow t FULL JOIN near n ON n.query_id = t.query_id AND n.product_id = t.product_id),
s AS (SELECT b.*, CASE WHEN dist < 0.62 THEN 2.5 * greatest(0, 1 - dist) ELSE 0 END AS x_semantic, x_text + x_similarity + CASE WHEN starts_with(lower(p.title), lower(q.term)) THEN 1.5 ELSE 0 END + 0.3 * ln(1 + p.popularity) + CASE WHEN is_sku THEN 50 ELSE 0 END AS others,
  ({_HAS.format('vendor', 'p.vendor')}) AND (p.available OR q.include_unavailable) AS ok FROM pair b JOIN req q ON q.query_id = b.query_id JOIN elig p ON p.product_id = b.product_id)
SELECT query_id, product_id, round(x_semantic, 6)::DOUBLE AS x_semantic, round(others + x_semantic, 6) AS score, CASE WHEN is_sku THEN 'sku' WHEN dist < 0.62 AND fulltext THEN 'hybrid' WHEN dist < 0.62 THEN 'semantic' ELSE 'fulltext' END AS strategy FROM s WHERE ok""", "v_products"),
    "search_stemmed": with_views(_STEMMED.replace(_GROUPS, _groups(_PLAIN)) + """ SELECT coalesce(r.query_id, i.query_id) AS query_id, coalesce(r.product_id, i.product_id) AS product_id, round(coalesce(text_rank, 0), 6)::DOUBLE AS text_rank FROM ranks r
FULL JOIN (SELECT q.query_id, p.product_id FROM req q JOIN elig p ON p.shop_id = q.shop_id AND contains(lower(p.title), lower(q.term))) i ON i.query_id = r.query_id AND i.product_id = r.product_id""", "v_products"),
    "search_understood": f"""WITH {requests_cte(TEXT)}, x(query_id, expansions) AS (VALUES {", ".join(f"({q}, {ps})" for q, ps in PHRASES)})
SELECT q.query_id, lower(term) AS normalized_term, CASE WHEN shop_id = 'shop2' THEN 'turkish' ELSE 'simple' END AS language, array_to_string(expansions, '|') AS expansions,
  array_to_string(list_transform(expansions, lambda p: CASE WHEN contains(p, ' ') THEN '(' || p || ')' ELSE p END), ' OR ') AS ts_query,
  CAST(CASE WHEN q.query_id = 21 THEN 1 WHEN shop_id = 'shop2' THEN 2 ELSE -1 END AS INT) AS rule_id, CAST(CASE WHEN q.query_id = 21 THEN 5 WHEN shop_id = 'shop2' THEN 3 ELSE -1 END AS INT) AS priority FROM req q JOIN x ON x.query_id = q.query_id""",
    "did_you_mean": with_views(ROWS + f""", few AS (SELECT q.query_id, q.shop_id, lower(q.term) AS norm FROM req q LEFT JOIN (SELECT query_id, count(*) AS n FROM trow WHERE ok GROUP BY 1) USING (query_id) WHERE q.typo_tolerance AND coalesce(n, 0) < 3),
top AS (SELECT f.query_id, f.norm, s.t, row_number() OVER (PARTITION BY f.query_id ORDER BY s.sim DESC, s.t) AS n FROM few f JOIN sims s ON s.query_id = f.query_id AND s.sim > 0.3 QUALIFY n <= 5),
w AS (SELECT query_id, norm, unnest(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS word FROM top),
ws AS (SELECT query_id, word, max(sim) AS ws FROM (SELECT query_id, word, {jaccard(whole_grams('word'), whole_grams('typed'))} AS sim FROM (SELECT *, unnest(string_split(norm, ' ')) AS typed FROM w WHERE NOT list_contains(string_split(norm, ' '), word))) GROUP BY ALL HAVING max(sim) > 0.34),
best AS (SELECT query_id, word FROM ws QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ws DESC, word DESC) = 1)
SELECT t.query_id, coalesce(b.word, t.t) AS suggestion FROM top t LEFT JOIN best b USING (query_id) WHERE t.n = 1""", "v_products"),
}
