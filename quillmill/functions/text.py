"""Text: normalisation, character classes, tokens, n-grams, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes in Java's regex syntax.
CJK = r"\u4e00-\u9fff"
SYMBOL = r"[\p{P}\p{S}]"


def normalize(text: Column) -> Column:
    """White space of any script collapsed to one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\u3000\u00a0]+", " "))


def strip_all(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def info_ratio(text: Column) -> Column:
    """(CJK + letters + digits) / length; CJK characters are letters too and count twice."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((count(text, f"[{CJK}]") + count(text, r"\p{L}") + count(text, r"\p{Nd}")) / n)


def symbol_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 1.0).otherwise(count(text, SYMBOL) / n)


def detect_lang(text: Column) -> Column:
    """zh, en or mix, by the share of CJK among CJK and Latin letters."""
    zh, en = count(text, r"[\u4e00-\u9fa5]"), count(text, "[A-Za-z]")
    total = F.greatest(zh + en, F.lit(1))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "mix").when(zh / total >= 0.7, "zh").when(en / total >= 0.6, "en").otherwise("mix")


def tokens_en(text: Column, cap: int | None = 4000) -> Column:
    """Lower-cased runs of letters, digits, quotes, hyphens and underscores, at most cap, or all."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9’'_\-]+"), F.lit(0))
    return found if cap is None else F.slice(found, 1, cap)


def tokens_mixed(text: Column, cap: int | None = 4000) -> Column:
    """Tokens of a text that may be Chinese: single CJK characters and words as they stand, in order (a stand-in
    for a word segmenter), then the lower-cased English tokens once more; the doubled English words count twice."""
    plain = F.coalesce(text, F.lit(""))
    cut = F.regexp_extract_all(plain, F.lit(f"[{CJK}]|[A-Za-z0-9’'_\\-]+"), F.lit(0))
    both = F.concat(cut, F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z0-9’'_\-]+"), F.lit(0)))
    return both if cap is None else F.slice(both, 1, cap)


def reduced(text: Column) -> Column:
    """The text reduced to [0-9a-z] and CJK."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^0-9a-z{CJK}]", "")


def ngrams_of(s: Column, n: int = 3) -> Column:
    """Distinct n-grams of a reduced text. A column of its own, not an expression: a lambda computes what it names for every gram."""
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text reduced to [0-9a-z] and CJK."""
    return ngrams_of(reduced(text), n)


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct members that are in b; 0 when a is empty."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def stable_int64(text: Column) -> Column:
    return F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("long")


def unit_hash(text: Column) -> Column:
    """The first 8 hex digits of sha1 as a number from 0 to 1."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def truncate_within(text: Column, n: int) -> Column:
    """At most n characters, the dots included."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)


def last_line_answer(text: Column, letters: str = "A-F") -> Column:
    """The stand-alone option letter on the last line that is not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    last = F.element_at(lines, -1)
    got = F.regexp_extract(F.upper(F.coalesce(last, F.lit(""))), rf"(?<![A-Z0-9])([{letters}])(?![A-Z0-9])", 1)
    return F.nullif(got, F.lit(""))
