"""Request tables that the registered queries put to the catalog of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query_id int, shop_id string, term string, page int, per_page int, sort string, filters map<string,array<string>>, price_min double, price_max double, collection string, include_unavailable boolean, typo_tolerance boolean, bucket string"


def _r(i, sort="relevance", term="", page=1, per_page=24, filters=None, lo=None, hi=None, coll=None, every=False, typo=True, bucket=None):
    return (i, f"shop{i % 4}", term, page, per_page, sort, filters or {}, lo, hi, coll, every, typo, bucket)


BROWSE = [
    _r(1), _r(2, "price_asc", page=2, per_page=10), _r(3, "price_desc", filters={"vendor": ["Brand#1", "Brand#2", "Brand#17"]}), _r(4, "title_asc", filters={"tag": ["red", "hot"]}),
    _r(5, "title_desc", filters={"option:Size": ["11", "28", "3"]}, every=True), _r(6, "newest", filters={"metafield:material": ["m0", "m2"]}), _r(7, "bestselling", lo=950.0, hi=1200.0),
    _r(8, "relevance", coll="c1"), _r(9, "price_asc", filters={"productType": ["ECONOMY"], "option:Color": ["red", "blue"]}), _r(10, "newest", filters={"availability": ["out_of_stock"]}, every=True),
    _r(11, "relevance", filters={"collection": ["c2", "c3"], "vendor": ["Brand#5"]}, hi=1500.0), _r(12, "bestselling", filters={"unknown": ["x"]}, page=3, per_page=48),
]

TEXT = [
    _r(21, term="red widget"), _r(22, term="Hot Bolt", sort="price_asc"), _r(23, term="blue plat"), _r(24, term="SKU4"), _r(25, term="small ring", filters={"vendor": ["Brand#2"]}),
    _r(26, term="wdget"), _r(27, term="economy", per_page=48), _r(28, term="the ring", every=True), _r(29, term="r"), _r(30, term="gren gear"), _r(31, term="plate", bucket="a"), _r(32, term="hot", sort="title_desc"),
]


def requests(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(BROWSE if rows is None else rows, SCHEMA)


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return str(v)
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{_q(k)}: [{', '.join(map(_q, x))}]" for k, x in v.items()) + "}" if v else "CAST(MAP {} AS MAP(VARCHAR, VARCHAR[]))"
    return "'" + str(v).replace("'", "''") + "'"


def requests_cte(rows=None) -> str:
    """The same rows as a DuckDB CTE named req."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    one = [f"SELECT {', '.join(f'CAST({_q(v)} AS {k}) AS {n}' for v, n, k in zip(r, names, ('INT', 'VARCHAR', 'VARCHAR', 'INT', 'INT', 'VARCHAR', 'MAP(VARCHAR, VARCHAR[])', 'DOUBLE', 'DOUBLE', 'VARCHAR', 'BOOLEAN', 'BOOLEAN', 'VARCHAR'), strict=True))}" for r in (rows or BROWSE)]
    return "req AS (" + " UNION ALL ".join(one) + ")"
