"""Text helpers as column expressions; all run inside whole-stage code or as higher-order functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters of all scripts that decompose, in one step or several, into one base character, and that character."""
    pairs = {}
    for point in range(0xC0, 0x10000):
        if unicodedata.decomposition(chr(point)).partition(" ")[0].startswith("<"):
            continue  # compatibility forms are no accents
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            pairs[chr(point)] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _accent_table()


def fold_accents(c: Column) -> Column:
    """Base letters without diacritics; letters that do not decompose (ø, ß) stay. Text of one-byte characters is left as it is."""
    return F.when(F.octet_length(c) > F.length(c), F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}", "")).otherwise(c)


def normalize_query(c: Column) -> Column:
    """Folded, lower-cased, control characters and runs of white space as one space, trimmed; null is empty."""
    folded = F.lower(fold_accents(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[\x00-\x1f\x7f]", " "), r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    """Words of a normalised text; control characters and white space separate words as they are."""
    return F.array_remove(F.split(F.lower(fold_accents(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), "")


# What a SKU looks like.
def looks_like_sku(c: Column) -> Column:
    t = F.trim(c)
    return F.length(t).between(3, 64) & t.rlike(r"\d") & t.rlike(r"^[\p{L}\p{N}._/-]+$")


def _padded_grams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of every word, each padded with two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(words, _padded_grams)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 if both are empty."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union > 0, common / union).otherwise(0.0)


def trgm_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def word_sim(a: Column, b: Column) -> Column:
    """Jaccard over trigrams of the whole strings, padded once."""
    return set_similarity(F.array_distinct(_padded_grams(F.lower(a))), F.array_distinct(_padded_grams(F.lower(b))))


# Languages with their own text configuration.
LANGUAGES = "simple english french german spanish italian portuguese dutch danish swedish norwegian finnish russian turkish hungarian".split()


def ts_config(c: Column) -> Column:
    """The language if it is on the list, else 'simple'."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(LANGUAGES), low).otherwise("simple")


def ab_bucket(c: Column) -> Column:
    """'a' or 'b' by the parity of the 32-bit FNV-1a hash of the token's characters; null without a token."""
    # The prime and the start of 32-bit FNV-1a.
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0x811C9DC5), step)
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.when(h % 2 == 0, "a").otherwise("b"))


def highlight(text: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Marks each word of ``term`` in ``text``, whatever its case."""
    words = sorted({w for w in term.split() if w}, key=len, reverse=True)
    quote = lambda w: "".join("\\" + ch if not (ch.isalnum() or ch == "_") and ord(ch) < 128 else ch for ch in w)
    return F.regexp_replace(text, "(?iu)(" + "|".join(map(quote, words)) + ")", f"{before}$1{after}") if words else text


def gid_id(c: Column) -> Column:
    """Trailing digits of a global id, before an optional query part; other values unchanged."""
    digits = F.regexp_extract(c, r"(\d+)(?:\?.*)?$", 1)
    return F.when(digits != "", digits).otherwise(c)


def _char_of(number: Column) -> Column:
    return F.when(number.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(" "))


def strip_html(c: Column, limit: int = 5000) -> Column:
    """Text of a HTML fragment: script and style bodies go, tags become spaces, then entities are decoded."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    parts = F.split(t, r"(?=&#)")
    decimal = lambda p: F.regexp_extract(p, r"^&#(\d{1,7});", 1)
    hexa = lambda p: F.regexp_extract(p, r"(?i)^&#x([0-9a-f]{1,6});", 1)
    rest = lambda p: F.regexp_replace(p, r"(?i)^&#x?[0-9a-f]{1,7};", "")
    decoded = F.transform(
        parts,
        lambda p: F.when(decimal(p) != "", F.concat(_char_of(decimal(p).cast("int")), rest(p)))
        .when(hexa(p) != "", F.concat(_char_of(F.conv(hexa(p), 16, 10).cast("int")), rest(p)))
        .otherwise(p),
    )
    t = F.when(t.contains("&#"), F.array_join(decoded, "")).otherwise(t)
    # Named entities that are decoded; any other is a space. Ampersands come last.
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        t = F.regexp_replace(t, f"(?i)&{name};", char)
    t = F.regexp_replace(t, r"(?i)&(?!amp;)[a-z][a-z0-9]*;", " ")
    t = F.regexp_replace(t, r"(?i)&amp;", "&")
    return F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(limit))


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    # Characters that begin a formula.
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
