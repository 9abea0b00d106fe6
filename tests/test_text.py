from pyspark.sql import functions as F

from stallgrid.functions import text as T


def value(spark, column, v):
    return spark.createDataFrame([(v,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_normalize(spark):
    assert value(spark, T.normalize_query, "  Café\x00\tCRÈME  ") == "cafe creme"
    assert value(spark, T.normalize_query, None) == ""
    assert value(spark, T.tokenize, "T-Shirt, été!") == ["t", "shirt", "ete"]
    assert value(spark, T.fold_accents, "søß") == "søß"
    assert value(spark, T.fold_accents, "ế ậ ά й Ǘ e\u0301 한") == "e a α и U e 한"


def test_sku(spark):
    assert value(spark, T.looks_like_sku, "AB-12.x")
    for bad in ("ab", "a b1", "abc", "ab#1", "x" * 64 + "1"):
        assert not value(spark, T.looks_like_sku, bad)


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert round(df.select(T.trgm_similarity(F.col("a"), F.col("b"))).first()[0], 4) == 0.3636


def test_ab_bucket_matches_fnv_and_splits(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return "a" if h % 2 == 0 else "b"

    rows = spark.range(2000).select(F.concat(F.lit("token-"), F.col("id").cast("string")).alias("t")).select("t", T.ab_bucket(F.col("t")).alias("b")).collect()
    assert all(r.b == fnv(r.t) for r in rows)
    assert 0.45 < sum(r.b == "a" for r in rows) / 2000 < 0.55
    assert value(spark, T.ab_bucket, None) is None


def test_strip_html(spark):
    assert value(spark, T.strip_html, "<p>a &lt;b&gt; &#65;&#x42; &amp;lt; &copy;</p><script>x()</script> <style>p{}</style>z") == "a <b> AB &lt; z"
    assert value(spark, T.strip_html, None) == ""


def test_ids_and_cells(spark):
    assert value(spark, T.gid_id, "gid://store/Product/123?x=1") == "123"
    assert value(spark, T.gid_id, "abc") == "abc"
    for c in ("=1", "+1", "-1", "@x", "\tx", "\rx"):
        assert value(spark, T.csv_safe, c) == "'" + c
    assert value(spark, T.csv_safe, "a=1") == "a=1"


def test_highlight(spark):
    assert value(spark, lambda c: T.highlight(c, "red (x"), "Red hat (x)") == "<mark>Red</mark> hat <mark>(x</mark>)"
