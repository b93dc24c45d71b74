"""Record shaping and validation: ids from paths, block types, tags, options, verdicts, anchor scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing option, in evaluation and in the harness.
NULL_OPTIONS = ("", "none", "null", "n/a")
NULL_OPTIONS_HARNESS = ("", "none", "null", "n/a", "nan", "-")


def doc_id_of(path: Column, length: int = 16) -> Column:
    """The last part of a folder name after a double underscore, cut to length."""
    return F.substring(F.element_at(F.split(path, "__"), -1), 1, length)


def block_type(kind: Column, noise: tuple[str, ...], known: tuple[str, ...], has_table: Column, latex: Column, has_image: Column, text: Column) -> Column:
    """discarded, table, equation, image, text, a known kind or other: the first that applies."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin(*noise), "discarded").when(has_table, "table").when(latex, "equation").when(has_image, "image").when(F.coalesce(F.trim(text), F.lit("")) != "", "text").when(k.isin(*known), k).otherwise("other")


def tag_flags(tags: Column, generic: str) -> tuple[Column, Column]:
    """(is_general, is_mixed): whether the generic tag is there; if not, whether two or more are."""
    general = F.array_contains(tags, generic)
    return general, ~general & (F.size(F.filter(F.array_distinct(tags), lambda x: x != generic)) >= 2)


def main_tag(tags: Column, generic: str) -> Column:
    return F.when(F.array_contains(tags, generic), generic).otherwise(F.coalesce(F.get(tags, F.lit(0)), F.lit("")))


def real_options(options: Column, null: tuple[str, ...] = NULL_OPTIONS) -> Column:
    return F.map_filter(options, lambda k, v: ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin(*null))


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null if none does (the record is accepted)."""
    return reduce(lambda c, r: c.when(F.coalesce(r[0], F.lit(True)), r[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(True)), rules[0][1]))


def anchor_score(counts: dict[str, Column], scores: dict[str, Column], weights: dict[str, float], caps: dict[str, int], best: float, good: float) -> dict[str, Column]:
    """score in 0..1 and class of an anchor: capped counts and a specificity, weighted, less two penalties. The class by
    rules (what is named at all) may be raised by the class by score, never lowered."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    share = {k: unit(c / float(caps[k])) for k, c in counts.items() if k in caps}
    raw = reduce(lambda a, b: a + b, [weights[k] * c for k, c in share.items()]) + weights["specificity"] * unit(scores["specificity"])
    raw = raw - weights["generic_penalty"] * unit(scores["generic_penalty"]) - weights["deictic_penalty"] * unit(scores["deictic_penalty"])
    score = unit(raw)
    strong = (counts["anatomy"] >= 1) | (counts["lesion"] >= 1)
    detail = reduce(lambda a, b: a | b, [counts[k] >= 1 for k in ("attribute", "distribution", "severity", "context")])
    rule = F.when((counts["anatomy"] >= 1) & (counts["lesion"] >= 1) & detail, "A").when(strong, "B").otherwise("C")
    by_score = F.when(score >= best, "A").when(score >= good, "B").otherwise("C")
    return {"score": score, "rule": rule, "by_score": by_score, "final": F.least(rule, by_score)}


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
