"""Quality rules: one threshold table, compiled into one native projection.

Every measure and every rule is a Spark SQL expression, so the whole operator is a single narrow
projection over the scan: no shuffle, no Python. Repeated 5-word windows are found per row by hashing the
windows to 64 bits; only rows in which two windows are equal sort (hash, position) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
RATIOS = ("symbol_ratio", "mean_word_chars", "stop_ratio", "repeat_ratio", "dup_line_ratio")

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on with as be this by at or from are an a "
    "der die das und in zu den von mit ist für auf ein eine dem im des sich als auch "
    "le la les de des et à en un une du que qui est pour dans sur pas au avec par "
    "el la los las de y en un una que por con para del se no es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The method's own thresholds (ratios are per word, per character of words, or per line with a word).
RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("many_symbols", "symbol_ratio", high=0.25),
    Rule("odd_word_length", "mean_word_chars", low=1.5, high=25),
    Rule("few_stop_words", "stop_ratio", low=0.01),
    Rule("repeated_windows", "repeat_ratio", high=0.20),
    Rule("repeated_lines", "dup_line_ratio", high=0.60),
)


def compile_rules(rules=RULES) -> Column:
    """The names of the rules that a row fails, as one array expression; a null measure fails no rule."""
    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < F.lit(r.low))
        if r.high is not None:
            bad = bad | (F.col(r.measure) > F.lit(r.high))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stop_words, n_repeat_words and ratios.

    Null text counts as empty: zero everywhere, ratios null. Input columns with the same names as the measures
    are replaced. Equal windows are equal 64-bit hashes of their five words.
    """
    own = ("_t", "_w", "_h", "_p", "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_repeat_words")
    keep = [c for c in docs.columns if c not in own and c not in RATIOS]
    q = lambda c: f"`{c}`"
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    span = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    step1 = docs.select(*map(q, keep), F.coalesce(F.col(q(text)).cast("string"), F.lit("")).alias("_t"))
    step2 = step1.selectExpr(
        *map(q, keep),
        "_t",
        r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '') AS _w",
        r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]') AS _lines",
    )
    step3 = step2.selectExpr(
        *map(q, keep),
        "size(_w) AS _n",
        r"length(translate(_t, ' \u0009\u000A\u000B\u000C\u000D', '')) AS _chars",
        "length(_t) - length(translate(_t, '#*$%&|<>', '')) AS _symbols",
        "size(_lines) AS _nl",
        "size(_lines) - size(array_distinct(_lines)) AS _dup",
        f"size(filter(_w, w -> lower(w) IN ({stops}))) AS _stop",
        f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({span})) ELSE array() END AS _h",
    )
    # Only rows with two equal windows build and sort (hash, position) pairs.
    step4 = step3.withColumn(
        "_p",
        F.expr(
            "CASE WHEN size(array_distinct(_h)) < size(_h) THEN "
            "sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    ).withColumn(
        "_p",
        F.expr("CASE WHEN _p IS NOT NULL THEN sort_array(transform(filter(_p, (x, k) -> (k > 0 AND _p[k - 1].h = x.h) OR (k + 1 < size(_p) AND _p[k + 1].h = x.h)), x -> x.i)) END"),
    )
    covered = f"CASE WHEN _p IS NULL OR size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (p, k) -> CASE WHEN k + 1 < size(_p) THEN least({WINDOW}, _p[k + 1] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x) END"
    out = step4.selectExpr(
        *map(q, keep),
        "CAST(_n AS BIGINT) AS n_words",
        "CAST(_chars AS BIGINT) AS word_chars",
        "CAST(_symbols AS BIGINT) AS n_symbols",
        "CAST(_dup AS BIGINT) AS n_dup_lines",
        "CAST(_nl AS BIGINT) AS n_lines",
        "CAST(_stop AS BIGINT) AS n_stop_words",
        f"{covered} AS n_repeat_words",
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns(
        {
            "symbol_ratio": per("n_symbols", "word_chars"),
            "mean_word_chars": per("word_chars", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
        }
    )


def quality_filter(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All rows with their measures, ``failed_rules`` and ``kept`` (no rule failed)."""
    return quality_measures(docs, text).withColumn("failed_rules", compile_rules(rules)).withColumn("kept", F.size("failed_rules") == 0)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """One row per document of the whole table: the digest columns of the quality rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return quality_filter(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"),
        "n_lines", "n_stop_words", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         concat_ws(',', CASE WHEN n_words < 10 THEN 'few_words' END,
           CASE WHEN n_symbols / nullif(word_chars, 0)::DOUBLE > 0.25 THEN 'many_symbols' END,
           CASE WHEN word_chars / nullif(n_words, 0)::DOUBLE < 1.5 OR word_chars / nullif(n_words, 0)::DOUBLE > 25 THEN 'odd_word_length' END,
           CASE WHEN n_stop_words / nullif(n_words, 0)::DOUBLE < 0.01 THEN 'few_stop_words' END,
           CASE WHEN n_repeat_words / nullif(n_words, 0)::DOUBLE > 0.2 THEN 'repeated_windows' END,
           CASE WHEN n_dup_lines / nullif(n_lines, 0)::DOUBLE > 0.6 THEN 'repeated_lines' END) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM f"""


OP5_SQL = _sql()
