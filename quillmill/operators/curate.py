"""Rule cleaning, deduplication, audit and maintenance of text blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns and words of the cleaning rules; white space and digits are those of all scripts.
SHORT_LABEL = r"^(病例|视频|步骤|附件|目录)\s*\d{1,3}$"
PURE_NUMBER = r"^\d{1,4}$"
CHAPTER_ONLY = r"^第[0-9一二三四五六七八九十百千万]+[章节篇节部卷册](\s*)$"
CATALOG = r"^.{1,40}/\d{1,4}$"
FIGURE_SHORT = r"(?i)^(图|表|FIG|Figure|Table)\s*[0-9A-Za-z\-.]*\s*[:：]?\s*$"
PUBLICATION = r"(?i)(版权所有|ISBN|责任编辑|主编|开本|印张|出版|Copyright)"
PROTECTED = ("内镜", "胃", "食管", "肠", "结肠", "直肠", "胆", "胰", "肝", "癌", "肿瘤", "病变", "诊断", "治疗", "切除", "出血", "穿孔", "息肉", "溃疡", "炎", "ERCP", "EUS", "ESD", "EMR", "NBI")
CHAPTER = r"第[0-9一二三四五六七八九十百千万]+[章节篇节部卷册]"
SLASH_PAGE = r"/\d{1,4}$"
FIGURE = r"(?i)^(图|表|FIG|Figure|Table)\s*[0-9A-Za-z\-.]*"
PUBLICATION_LIKE = r"(?i)(主编|ISBN|责任编辑|版权所有|出版|Copyright)"
REFERENCE = r"^\s*\[?\d{1,3}\]?\s*[\.、)]\s*"
ENUMERATION = r"^\s*(?:[A-Za-zＡ-Ｚa-zａ-ｚ][、.:：]\s*[一-鿿A-Za-z]{1,10}\s*){2,}\s*$"
LATEX = r"(\\text|\\mathrm|\\mathbb|\\spadesuit|\\textcircled|\$\s*\\)"
BAD_CHARS = r"[�□◻◼◇◆※#@$%^&*_+=~`|]"
MEDICAL = r"(内镜|胃|食管|小肠|结肠|直肠|胰|胆|肝|癌|肿瘤|病变|溃疡|息肉|出血|穿孔|炎|ERCP|EUS|ESD|EMR|NBI)"
ACTION = r"(诊断|治疗|切除|检查|评估|手术|操作|处理|预防|随访|并发症|适应证|禁忌证|止血|穿刺)"
OUTCOME = r"(提示|考虑|符合|显示|可见|证实|阳性|阴性|改善|恶化|风险)"
LOW_VALUE = r"(大小的病变|位于.*部|见.*病变|难易度|病例|视频|章节|目录|页)"
HARD_DROP = r"(CIP|图书馆CIP|主编|责任编辑|译者|版权所有|ISBN|视频\s*\d+|p\.\d+|第\d+章|难易度|病例\d+|目录)"


def holds(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, its classes taken in Unicode."""
    return text.rlike("(?U)" + pattern)


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    chain = reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return chain.otherwise(F.lit(otherwise))


def stage1_reason(blocks: DataFrame, min_length: int = 5, dedup: bool = True, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """blocks(block_id, text, char_length, content_hash) with reason: why a block is dropped, null if kept.

    A block is a duplicate if an earlier one (by block_id) with its hash passed all other rules; short
    protected texts neither count nor are dropped as duplicates.
    """
    d = blocks.withColumn("s", T.normalize(F.col("text")))
    s, n = F.col("s"), F.length("s")
    rules = [
        (s == "", "empty_text"),
        (F.col("char_length") < min_length, f"too_short_lt_{min_length}"),
        (holds(s, r"^[\p{P}\p{S}\s]*$"), "only_symbols"),
        (holds(s, PURE_NUMBER), "pure_number"),
        (holds(s, SHORT_LABEL), "short_label_with_number"),
        (holds(s, CHAPTER_ONLY), "chapter_only_heading"),
        (holds(s, CATALOG), "catalog_slash_page"),
        (holds(s, FIGURE_SHORT), "figure_table_short_caption"),
        ((n <= 120) & holds(s, PUBLICATION), "publication_meta"),
        ((n <= 40) & (T.symbol_ratio(s) >= 0.6), "high_symbol_ratio_short"),
        ((n <= 12) & (T.info_ratio(s) < 0.5), "low_info_density_short"),
    ]
    d = d.withColumn("reason", first_of(rules))
    if dedup:
        lower = F.lower("s")
        safe = (n <= 12) & reduce(lambda a, b: a | b, [lower.contains(k.lower()) for k in protected])
        counts = F.col("reason").isNull() & ~safe & (F.coalesce("content_hash", F.lit("")) != "")
        d = d.withColumn("counts", counts)
        # not by a filter: one would be pushed below and normalise the text anew for every rule
        firsts = d.groupBy("content_hash").agg(F.min(F.when(F.col("counts"), F.col("block_id"))).alias("first_block"))
        d = d.join(firsts, "content_hash", "left")
        d = d.withColumn("reason", F.when(F.col("counts") & (F.col("block_id") > F.col("first_block")), "duplicate_content_hash").otherwise(F.col("reason"))).drop("counts", "first_block")
    return d.drop("s")


def signals(text: Column, length: Column, version: int = 1, normal: bool = False) -> tuple[Column, Column]:
    """(names, score) of the weighted signs that a block needs review; version 2 has three more signs and wider limits. normal: the text is normalised already."""
    s = text if normal else T.normalize(text)
    wide = version == 2
    latin, cjk = T.count(s, "[A-Za-z]"), T.count(s, f"[{T.CJK}]")
    found = [
        (length <= 8, "very_short", 3),
        ((length > 8) & (length <= 15), "short", 1),
        ((length <= (50 if wide else 40)) & holds(s, CHAPTER), "chapter_like", 2),
        ((length <= (100 if wide else 80)) & holds(s, SLASH_PAGE), "catalog_page_like", 2),
        (holds(s, FIGURE), "figure_table_like", 2),
        (holds(s, PUBLICATION_LIKE), "publication_meta_like", 2),
        ((length <= (60 if wide else 40)) & holds(s, REFERENCE), "enumeration_like", 1),
    ]
    if wide:
        found += [(holds(s, ENUMERATION), "enum_fragment_like", 3), ((length <= 120) & holds(s, LATEX), "latex_ocr_like", 2)]
    found.append(((length <= (120 if wide else 80)) & (T.symbol_ratio(s) >= 0.45), "high_symbol_ratio", 2))
    if wide:
        found.append((T.count(s, BAD_CHARS) >= 2, "bad_char_like", 2))
    upper = (length <= (24 if wide else 30)) & (latin >= 6) & (cjk == 0) & (F.upper(s) == s)
    found.append((upper, "upper_latin_fragment" if wide else "upper_english_fragment", 1))
    names = F.array_compact(F.array(*[F.when(c, n) for c, n, _ in found]))
    score = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, _, w in found])
    return names, score


def review_candidates(blocks: DataFrame, min_score: int = 2, limit: int | None = None) -> DataFrame:
    """Blocks whose score reaches min_score, in order of score (highest first), length, id."""
    names, score = signals(F.col("text"), F.col("char_length"))
    out = blocks.select("block_id", "char_length", F.array_join(names, ",").alias("signals"), score.alias("score")).where(F.col("score") >= min_score)
    out = out.orderBy(F.desc("score"), "char_length", "block_id")
    return out if limit is None else out.limit(limit)


def stage2_decision(blocks: DataFrame, candidate_score: int = 2) -> DataFrame:
    """Adds action (keep, drop, rewrite, llm), reason, score and quality (null for what a model decides)."""
    # what several rules look at is computed once for a row
    blocks = blocks.withColumn("_s", T.normalize(F.col("text")))
    s, ln = F.col("_s"), F.col("char_length")
    counts = {"_cjk": T.count(s, f"[{T.CJK}]"), "_latin": T.count(s, "[A-Za-z]"), "_bad": T.count(s, BAD_CHARS), "_ratio": T.symbol_ratio(s), "_medical": holds(s, MEDICAL), "_action": holds(s, ACTION), "_outcome": holds(s, OUTCOME), "_latex": holds(s, LATEX)}
    blocks = blocks.withColumns(counts)
    _, score = signals(s, ln, 2, True)
    cjk, latin, bad, ratio, medical, action, outcome, latex = map(F.col, counts)
    rules = [
        (s == "", "drop", "empty_text"),
        (ln <= 3, "drop", "very_short"),
        (holds(s, HARD_DROP), "drop", "hard_drop_non_content_meta_or_catalog"),
        (holds(s, PURE_NUMBER), "drop", "pure_number"),
        (holds(s, r"^[\p{P}\p{S}\s]*$"), "drop", "only_symbols"),
        ((ln <= 50) & holds(s, ENUMERATION) & ~medical, "drop", "enum_fragment_without_medical_semantics"),
        (latex & (cjk + latin <= 5), "drop", "latex_ocr_noise"),
        ((ratio >= 0.62) & (ln <= 60), "drop", "high_symbol_ratio_short"),
        ((bad >= 3) & (ln <= 80), "drop", "bad_chars_noise"),
        ((ln <= 20) & ~action & ~outcome, "drop", "short_without_retrieval_signal"),
        ((ln <= 80) & medical & ~action & ~outcome & (holds(s, LOW_VALUE) | s.rlike(r"^[1-5]\.")), "drop", "low_retrieval_value_fragment"),
        ((ln >= 80) & (cjk >= 20) & (ratio < 0.2), "keep", "long_semantic_sentence"),
        (medical & (action | outcome) & (ln >= 10) & (ratio < 0.35) & (bad == 0), None, "medical_statement_needs_llm_validation"),
        (latex & (cjk + latin >= 8), "rewrite", "has_semantics_but_latex_ocr_polluted"),
    ]
    reason = first_of([(c, r) for c, _, r in rules], "to_llm")
    act = reduce(lambda c, r: c.when(F.col("reason") == r[2], F.lit(r[1])), rules[1:], F.when(F.col("reason") == rules[0][2], F.lit(rules[0][1])))
    d = blocks.withColumn("reason", reason).withColumn("score", score).withColumn("action", act)
    low = F.col("action").isNull() & (F.col("score") < candidate_score)
    quality = F.when(F.col("action") == "drop", 5).when(F.col("reason") == "long_semantic_sentence", 85).when(low, 70)
    return d.withColumns({"quality": quality, "reason": F.when(low, "low_risk_after_candidate_filter").otherwise(F.col("reason")), "action": F.when(low, "keep").otherwise(F.coalesce("action", F.lit("llm")))}).drop("_s", *counts)


def rewrite_or_keep(old: Column, new: Column) -> Column:
    """new, unless it is blank or far shorter than an old text of 20 or more characters."""
    shrunk = (F.length(old) >= 20) & (F.length(new) < F.floor(F.length(old) * 0.6))
    return F.when((F.coalesce(F.trim(new), F.lit("")) == "") | shrunk, old).otherwise(new)


def pool_reasons(rows: DataFrame, key: str, text: str, least: int = 8, most: int = 2000, phrases: tuple[str, ...] = ()) -> DataFrame:
    """Adds reason: empty, too_short, too_long, low_conf, duplicate (by normalised text, first key wins) or null."""
    d = rows.withColumn("_norm", T.normalize(F.col(text)))
    n = F.length("_norm")
    rules = [(n == 0, "empty"), (n < least, "too_short"), (n > most, "too_long")]
    rules += [(F.col("_norm").contains(p), "low_conf") for p in phrases]
    d = d.withColumn("reason", first_of(rules)).withColumn("_h", F.sha2("_norm", 256))
    firsts = d.where("reason is null").groupBy("_h").agg(F.min(key).alias("_first"))
    d = d.join(firsts, "_h", "left")
    return d.withColumn("reason", F.when(F.col("reason").isNull() & (F.col(key) > F.col("_first")), "duplicate").otherwise(F.col("reason"))).drop("_norm", "_h", "_first")


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """n and share (4 decimals) of each reason; null counts as kept."""
    got = rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def examples(rows: DataFrame, reason: str, key: str, most: int = 5) -> DataFrame:
    w = Window.partitionBy(reason).orderBy(key)
    return rows.where(F.col(reason).isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select(reason, key, "rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key old does not have, the first of each key by all columns."""
    return new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def document_stats(docs: DataFrame, blocks: DataFrame, key: str, empty: int | None = 0) -> DataFrame:
    """block_count and page_count (highest page_idx + 1) of each document; `empty` stands for a missing page count."""
    got = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("block_count"), (F.max("page_idx") + 1).alias("page_count"))
    pages = F.col("page_count") if empty is None else F.coalesce("page_count", F.lit(empty))
    return docs.join(got, key, "left").select(key, F.coalesce("block_count", F.lit(0)).alias("block_count"), pages.alias("page_count"))


def neighbours(blocks: DataFrame) -> DataFrame:
    """Texts of block_id - 1 and block_id + 1, empty where there is no such block."""
    prev = blocks.select((F.col("block_id") + 1).alias("block_id"), F.col("text").alias("prev_text"))
    after = blocks.select((F.col("block_id") - 1).alias("block_id"), F.col("text").alias("next_text"))
    out = blocks.join(prev, "block_id", "left").join(after, "block_id", "left")
    return out.withColumns({"prev_text": F.coalesce("prev_text", F.lit("")), "next_text": F.coalesce("next_text", F.lit(""))})


def lag_lead(rows: DataFrame, order: str, value: str, width: int = 10_000) -> DataFrame:
    """prev and next of value in the global order, '' at the ends, without one global partition.

    Rows fall in ranges of `width` keys, whole numbers without equals. The numbers of the ranges and of their first and last keys are ordered among
    themselves; values are joined to them by key, so that no task holds the edges of all ranges.
    """
    d = rows.withColumn("_part", F.expr(f"`{order}` div {width}"))
    all_parts = Window.orderBy("_part")
    ends = d.groupBy("_part").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    edges = ends.select("_part", F.lag("_hi").over(all_parts).alias("_prev"), F.lead("_lo").over(all_parts).alias("_next"))
    of = lambda key, out: rows.select(F.col(order).alias(key), F.col(value).alias(out))
    edges = edges.join(of("_prev", "_before"), "_prev", "left").join(of("_next", "_after"), "_next", "left").select("_part", "_before", "_after")
    w = Window.partitionBy("_part").orderBy(order)
    out = d.join(edges, "_part").withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w)})
    return out.select(*rows.columns, F.coalesce("prev", "_before", F.lit("")).alias("prev"), F.coalesce("next", "_after", F.lit("")).alias("next"))


def bad_token(t: Column) -> Column:
    """Whether an English token is junk: length, edge punctuation, a letter four times, DNA, no vowel or digit."""
    return (F.length(t) < 3) | (F.length(t) > 40) | t.rlike(r"^[-'_]|[-'_]$") | t.rlike(r"(.)\1\1\1") | ((F.length(t) >= 12) & t.rlike("^[acgt]+$")) | ~t.rlike("[aeiou0-9]")


def text_blocks(blocks: DataFrame, docs: DataFrame, least: int | None = None, most: int | None = None, doc: str | None = None, limit: int | None = None) -> DataFrame:
    """Blocks with their document (inner join on doc), of a length and of one document if wanted, in order of block_id, at most limit. The filters reach the scan."""
    x = blocks if least is None else blocks.where(F.col("char_length") >= least)
    x = x if most is None else x.where(F.col("char_length") <= most)
    x = x if doc is None else x.where(F.col("doc") == doc)
    x = x.join(docs, "doc").orderBy("block_id")
    return x if limit is None else x.limit(limit)
