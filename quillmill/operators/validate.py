"""Validators: what is wrong with generated questions, chains, rewrites and records, and reports with examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splits, option letters and the question types that are allowed.
SPLITS = ("train", "dev", "internal_test")
LETTERS = ("A", "B", "C", "D")
QUERY_TYPES = ("anatomical_site_recognition", "lesion_or_finding_identification", "procedure_or_operation_recognition", "spatial_region_understanding")
#: What gives an answer away.
GIVES_AWAY = "答案[是为]|正确答案"
LEVELS = ("L0", "L1", "L2", "L3", "L4")
CASES = ("long_but_low_density", "short_but_high_density")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def found(rules: list[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order; null conditions do not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules]))


def first_found(rules: list[tuple[Column, str]]) -> Column:
    return F.get(found(rules), F.lit(0))


def option_issues(options: Column, answer: Column, answer_text: Column) -> list[tuple[Column, str]]:
    """Rules for options (a map of letters): four letters, four values, an answer among them, its text."""
    keys = F.array_sort(F.map_keys(options)) == F.array(*map(F.lit, LETTERS))
    whole = F.coalesce(keys, F.lit(False))
    known = answer.isin(*LETTERS)
    return [
        (~whole, "invalid_options"),
        (whole & (F.size(F.array_distinct(F.map_values(options))) != 4), "duplicate_option_values"),
        (whole & ~F.coalesce(known, F.lit(False)), "invalid_answer"),
        (whole & known & ~answer_text.eqNullSafe(F.try_element_at(options, answer)), "answer_text_mismatch"),
    ]


def with_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Adds repeated: whether a row that is not the first (by line) has this key; blank keys never repeat."""
    first = rows.where(~blank(F.col(key))).groupBy(key).agg(F.min("line").alias("_first"))
    return rows.join(first, key, "left").withColumn("repeated", F.coalesce(F.col("line") > F.col("_first"), F.lit(False))).drop("_first")


def gold_issues(rows: DataFrame) -> DataFrame:
    """line, qid, issues of gold questions: line, qid, split, query_type, question, options, answer, answer_text,
    query_image_path, doc_id, doc_name, evidence (array of texts), pages (array)."""
    c = F.col
    need = [(blank(c(f)), f"missing_{f}") for f in ("qid", "split", "query_type", "question", "answer_text")]
    stated = (F.length("answer_text") >= 4) & F.contains("question", "answer_text")
    return with_duplicates(rows, "qid").select(
        "line", "qid",
        found([
            *need, (c("repeated"), "duplicate_qid"), (~F.coalesce(c("split").isin(*SPLITS), F.lit(False)), "invalid_split"),
            (~blank(c("query_type")) & ~c("query_type").isin(*QUERY_TYPES), "invalid_query_type"),
            *option_issues(c("options"), c("answer"), c("answer_text")),
            (c("question").rlike(GIVES_AWAY), "question_answer_leakage"), (stated, "answer_text_in_question"),
            (blank(c("doc_id")) & blank(c("doc_name")), "missing_source_doc"), (F.forall("evidence", blank), "missing_all_evidence_text"),
            (~F.size("pages").between(1, 2), "pdf_context_pages_out_of_range"),
        ]).alias("issues"),
    )


def mcq_issues(rows: DataFrame) -> DataFrame:
    """line, qid, issues of template questions; used_benchmark must be false, evidence_text must be there."""
    c = F.col
    return with_duplicates(rows, "qid").select(
        "line", "qid",
        found([
            (blank(c("qid")), "missing_qid"), (c("repeated"), "duplicate_qid"), (~F.coalesce(c("split").isin(*SPLITS), F.lit(False)), "invalid_split"),
            (blank(c("query_type")), "missing_query_type"), *option_issues(c("options"), c("answer"), c("answer_text")),
            (blank(c("question")), "missing_question"), (c("question").rlike(GIVES_AWAY), "question_answer_leakage"),
            (~c("used_benchmark").eqNullSafe(F.lit(False)), "benchmark_flag_not_false"), (blank(c("doc_id")) & blank(c("doc_name")), "missing_source_doc"),
            (blank(c("evidence_text")), "missing_evidence_text"),
        ]).alias("issues"),
    )


def split_leaks(rows: DataFrame) -> DataFrame:
    """doc_id, splits of documents that stand in more than one split."""
    g = rows.where(~blank(F.col("doc_id")) & ~blank(F.col("split"))).groupBy("doc_id").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return g.where(F.size("splits") > 1)


def issue_report(judged: DataFrame, key: str = "line", most: int = 5) -> DataFrame:
    """issue, n, examples: the first `most` keys of each issue. The ranking is limited before the shuffle."""
    each = judged.select(key, F.explode("issues").alias("issue"))
    counts = each.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("issue").orderBy(key)
    few = each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("issue").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return counts.join(few, "issue")


def generation_reason(options: Column, answer: Column, answer_text: Column, question: Column, basis: Column, dependency: Column) -> Column:
    """Why a generated question is refused, by the first rule that holds; null if it is good."""
    a, b, c, d = option_issues(options, answer, F.coalesce(answer_text, F.lit("")))
    return first_found([
        a, b, (c[0], "invalid_candidate_answer"), d, (blank(question), "empty_question"), (blank(basis), "missing_evidence_basis"),
        (~F.coalesce(dependency.isin("high", "medium", "low"), F.lit(False)), "invalid_image_dependency"), (dependency == "low", "image_dependency_low"),
    ])


def verification_reason(v: Column) -> Column:
    """Why a verified question is refused: v has verifier_answer, answer_supported, image_dependency, question_naturalness,
    benchmark_style_match, multi_organ_ambiguity, option_quality, text_leakage, all_options_same_granularity, multiple_correct_options."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    low = lambda c: F.coalesce(c == "low", F.lit(True))
    return first_found([
        (no(v["verifier_answer"].isin(*LETTERS)), "missing_verifier_answer"), (no(v["answer_supported"]), "answer_not_supported"),
        (low(v["image_dependency"]), "low_image_dependency"), (low(v["question_naturalness"]), "low_naturalness"),
        (no(v["benchmark_style_match"]), "no_benchmark_style_match"), (v["multi_organ_ambiguity"], "multi_organ_ambiguity"),
        (~v["option_quality"].eqNullSafe(F.lit("good")), "option_quality_not_good"), (v["text_leakage"], "text_leakage"),
        (no(v["all_options_same_granularity"]), "mixed_option_granularity"), (v["multiple_correct_options"], "multiple_correct_options"),
    ])


def gates(l1: Column, l2: Column, l3: Column, l3_correct: Column) -> list[Column]:
    """Whether a question passes without image, without evidence, and gains from evidence: log-probabilities of the gold answer."""
    return [(l1 < -0.25).alias("pass_l1"), (l2 < -0.5).alias("pass_l2"), (l3_correct | (l3 - l2 > 0.5)).alias("pass_l3")]


def keeps_verdict(verdict: Column, confidence: Column, least: float) -> Column:
    return F.coalesce((F.lower(F.trim(verdict)) == "keep") & (confidence >= least), F.lit(False))


def is_query(text: Column) -> Column:
    """Whether a text looks like a user's question: a question mark at its end, 80 characters at most."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return (s != "") & ~F.endswith(s, F.lit("。")) & (F.length(s) <= 80) & s.rlike("[？?]$")


def chain_issues(chain: Column) -> Column:
    """Issues of a chain (array of level, query_text, density_score): five levels in order, question forms, rising scores, a last text not much shorter."""
    at = lambda i, f: F.get(chain, F.lit(i))[f]
    rules = []
    for i, level in enumerate(LEVELS):
        known = [at(j, "density_score") for j in range(i)]
        before = F.coalesce(*reversed(known), F.lit(-1.0)) if known else F.lit(-1.0)
        rules += [
            (~at(i, "level").eqNullSafe(F.lit(level)), f"wrong_level_at_{i}"), (~is_query(at(i, "query_text")), f"unnatural_query_format_at_{i}"),
            (at(i, "density_score").isNull(), f"missing_score_at_{i}"), (at(i, "density_score") <= before, f"non_monotonic_score_at_{i}"),
        ]
    rules.append((F.length(F.coalesce(at(4, "query_text"), F.lit(""))) + 8 < F.length(F.coalesce(at(3, "query_text"), F.lit(""))), "l3_not_shorter_than_l4"))
    return F.when(F.coalesce(F.size(chain), F.lit(0)) != 5, F.array(F.lit("main_chain_not_5"))).otherwise(found(rules))


def rewrite_issues(rewrites: Column, variants: Column, cases: Column) -> Column:
    """Issues of rewritten chains: maps of level or case to text; a missing map of rewrites is the only issue then."""
    get = F.try_element_at
    rules = [(~is_query(get(rewrites, F.lit(v))), f"bad_rewrite_{v}") for v in LEVELS]
    rules += [(variants.isNull(), "missing_variants"), *[(variants.isNotNull() & ~is_query(get(variants, F.lit(v))), f"bad_variant_{v}") for v in LEVELS[2:]]]
    rules += [(cases.isNull(), "missing_hard_cases"), *[(cases.isNotNull() & ~is_query(get(cases, F.lit(k))), f"bad_hard_case_{k}") for k in CASES]]
    return F.when(rewrites.isNull(), F.array(F.lit("missing_rewrites"))).otherwise(found(rules))


def overlay(chain: Column, texts: Column) -> Column:
    """The chain with the texts of a map of level to text in place of its own, where there is one."""
    return F.transform(chain, lambda x: x.withField("query_text", F.coalesce(F.trim(F.try_element_at(texts, x["level"])), x["query_text"])))


def chain_report(chains: DataFrame) -> DataFrame:
    """level, n, n_not_question, n_too_long, n_duplicate, n_not_rising, least, median, most: summary by level of chains(id, chain) of five."""
    x = chains.where(F.size("chain") == 5).select("id", F.posexplode("chain").alias("i", "c")).select("id", "i", "c.*").withColumn("t", F.trim("query_text"))
    w = Window.partitionBy("id").orderBy("i")
    x = x.withColumns({"p": F.lag("density_score", 1, -1.0).over(w), "seen": F.row_number().over(Window.partitionBy("id", "t").orderBy("i"))})
    n = F.length("t")
    return x.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.endswith("t", F.lit("？"))).alias("n_not_question"), F.count_if(n > 90).alias("n_too_long"),
        F.count_if(F.col("seen") > 1).alias("n_duplicate"), F.count_if(F.col("density_score") <= F.col("p")).alias("n_not_rising"),
        F.min(n).alias("least"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("most"),
    )


def record_errors(r: dict[str, Column]) -> Column:
    """Errors of a normalised record, by its fields' lengths and forms."""
    most = {"text": 32768, "sample_id": 128, "group_id": 128, "source_type": 32, "text_role": 32, "doc_id": 128, "doc_name": 1024}
    forms = [(r[f"{k}_raw"].isNotNull() & (F.trim(r[f"{k}_raw"]) != "") & r[f"{k}_raw"].try_cast("long").isNull(), f"invalid_{k}") for k in ("block_id", "page_idx")]
    return found([(blank(r["text"]), "missing_text"), *forms, *[(F.length(r[k]) > n, f"{k}_too_long") for k, n in most.items() if k in r]])


def key_counts(records: Column) -> Column:
    """The keys of a JSON object, for counting."""
    return F.json_object_keys(records)


def hits_of(text: Column, words: tuple[str, ...]) -> Column:
    """Those words that a text holds, in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def first_bucket(text: Column, groups: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first group one of whose words the text holds."""
    out = F.lit(other)
    for name, words in reversed(groups):
        out = F.when(F.size(hits_of(text, words)) > 0, name).otherwise(out)
    return out


def reuse_bucket(text: Column, kind: Column, factual: tuple[str, ...], weak: tuple[str, ...], steps: tuple[str, ...], concepts: tuple[str, ...], several: tuple[str, ...]) -> Column:
    """direct_reuse, rewrite_reuse, weak_or_discard or borderline, by knowledge type, length and words."""
    n, has = F.length(text), lambda w: F.size(hits_of(text, w)) > 0
    s, c, m, f = has(steps), has(concepts), has(several), kind.isin(*factual)
    return F.when(f & n.between(12, 80) & ~s & ~c & ~m, "direct_reuse").when(f & n.between(20, 220) & ~c & ~s, "rewrite_reuse").when(kind.isin(*weak) | s | c | m | (n > 220), "weak_or_discard").otherwise("borderline")


def kept_for_reuse(bucket: Column, decision: Column, skip: tuple[str, ...]) -> Column:
    return ~bucket.isin(*skip) & F.lower(F.trim(F.coalesce(decision, F.lit("")))).isin("direct_reuse", "rewrite_reuse", "keep")


def included(qid: Column, share: float) -> Column:
    """Whether a key belongs to a share of all keys, by its crc32."""
    if share <= 0 or share >= 1:
        return F.lit(share >= 1)
    return F.crc32(qid.cast("string").cast("binary")) % 10000 < share * 10000


def sparse_clean(indices: Column, values: Column) -> Column:
    """A sparse vector as map of index to value, ascending: negative indexes, zeros and values that are not finite go, equal indexes
    are summed. Null if the arrays differ in length or nothing is left."""
    pairs = F.zip_with(indices, values, lambda i, v: F.struct(i.cast("long").alias("i"), v.cast("double").alias("v")))
    good = F.filter(pairs, lambda p: (p["i"] >= 0) & ~F.isnan(p["v"]) & (F.abs(p["v"]) < float("inf")) & (p["v"] != 0))
    keys = F.array_sort(F.array_distinct(F.transform(good, lambda p: p["i"])))
    total = lambda k: F.aggregate(F.filter(good, lambda p: p["i"] == k), F.lit(0.0), lambda a, p: a + p["v"])
    ok = (F.size(indices) == F.size(values)) & (F.size(keys) > 0)
    return F.when(ok, F.map_from_arrays(keys, F.transform(keys, total)))


def sparse_map(indices: Column, values: Column) -> Column:
    """Index to value; zeros go, of equal indexes the last stays."""
    pairs = F.filter(F.zip_with(indices, values, lambda i, v: F.struct(i.cast("long").alias("i"), v.cast("double").alias("v"))), lambda p: p["v"] != 0)
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["i"] == p["i"]))
    return F.map_from_entries(last)


def lexical_weights(ids: Column, mask: Column, weights: Column, special: tuple[int, ...]) -> Column:
    """The largest positive weight of each token id; masked and special ones go."""
    rows = F.arrays_zip(ids.alias("i"), mask.alias("m"), weights.alias("w"))
    good = F.filter(rows, lambda r: (r["m"] != 0) & (r["w"] > 0) & ~r["i"].isin(*special))
    keys = F.array_sort(F.array_distinct(F.transform(good, lambda r: r["i"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(good, lambda r: r["i"] == k), lambda r: r["w"]))))


def in_vocabulary(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens(docid, pos, token) that the vocabulary(token) has, or whose lower case it has, which takes their place."""
    v = vocabulary.select(F.col("token").alias("_v")).distinct()
    a = tokens.join(v, F.col("token") == F.col("_v"), "left").withColumn("_l", F.lower("token"))
    b = a.join(v.withColumnRenamed("_v", "_w"), F.col("_l") == F.col("_w"), "left")
    return b.withColumn("token", F.coalesce("_v", "_w")).where("token is not null").drop("_v", "_w", "_l")


def best_text(record: Column, names: tuple[str, ...]) -> Column:
    """The first of these fields of a map that is not blank, else the longest value (the first of equals)."""
    named = F.coalesce(*[F.when(~blank(F.try_element_at(record, F.lit(n))), F.try_element_at(record, F.lit(n))) for n in names])
    values = F.map_values(record)
    longest = F.aggregate(values, F.lit(""), lambda a, x: F.when(F.length(F.coalesce(x, F.lit(""))) > F.length(a), x).otherwise(a))
    return F.coalesce(named, longest)
