"""Queries: validators, routing, sparse vectors. Faults are planted by id in rows made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from .base import fixture, plain, query

#: Word lists of the routing and bucket rules.
LESION = ("息肉", "腺瘤", "癌", "肿瘤", "肿物", "隆起", "凹陷", "溃疡", "糜烂", "狭窄", "出血", "炎症", "白斑", "红斑", "不染", "染色", "异型", "病变", "瘘", "穿孔", "气肿", "静脉曲张", "萎缩", "肠化", "黏膜改变", "异常", "结节", "囊肿", "坏死", "浸润", "分型", "分级")
PROCEDURE = ("切除", "剥离", "切开", "夹闭", "缝合", "注射", "止血", "活检", "染色", "标记", "牵引", "套扎", "扩张", "置入", "支架", "取石", "碎石", "ERCP", "ESD", "EMR", "POEM", "EUS", "治疗", "操作", "电刀", "圈套器", "止血夹", "器械", "导丝", "针刀", "透明帽")
SPATIAL = ("近端", "远端", "口侧", "肛侧", "前壁", "后壁", "左侧", "右侧", "小弯", "大弯", "上部", "中部", "下部", "边缘", "中心", "开口", "入口", "出口", "贲门", "幽门", "球部", "降部", "乳头", "齿状线", "回盲瓣", "位置", "区域", "侧壁", "顶端", "底部", "周围", "箭头", "所指")
ANATOMY = ("食管", "胃", "胃窦", "胃体", "胃角", "贲门", "幽门", "十二指肠", "小肠", "回肠", "空肠", "结肠", "直肠", "盲肠", "回盲", "胆管", "胰腺", "乳头", "咽", "肛管")
GROUPS = [
    ("organ_or_part_identification", ("哪个消化器官", "哪一个消化器官", "胃肠道器官名称", "哪个器官", "哪个部分", "哪种消化器官")),
    ("anatomy_or_landmark_identification", ("哪个解剖结构", "具体解剖结构", "识别出的解剖结构", "标示的解剖结构")),
    ("lesion_presence_or_type", ("病理发现", "病理诊断", "异常性质", "病变", "异常")),
    ("histology_or_pathology", ("组织病理学分类", "组织学类型", "病理类型")),
    ("lesion_count", ("息肉数量", "多少个", "数量", "总数", "数目")),
    ("surgical_workflow", ("手术过程", "手术步骤", "手术操作", "操作阶段", "哪个阶段", "哪种治疗操作")),
    ("quality_or_score", ("波士顿肠道准备", "BBPS", "评分", "Mayo评分")),
    ("visual_grounding", ("坐标", "边界框", "[x1, y1, x2, y2]")),
]
STEPS = ("第一步", "第二步", "第三步", "流程图", "步骤", "顺序", "阶段")
CONCEPTS = ("原理", "示意图", "图A", "图B", "图C", "图D", "图E", "敏感度", "特异度", "标准", "分类系统")
SEVERAL = ("第一幅图像", "第二幅图像", "第三幅图像", "第四幅图像", "上排图像", "下排图像", "编号", "依次展示", "由四幅")
FACTUAL, WEAK = ("病变特征", "诊断评估", "解剖特征"), ("检查操作", "治疗操作", "基础概念")
TEXT_FIELDS = ("text", "content", "body", "paragraph", "chunk", "passage", "summary", "abstract", "raw", "clean_text")

#: Chinese texts that the rules of a word list meet, by doc_id.
ZH = "CASE doc_id % 9 WHEN 0 THEN '胃窦息肉切除，位于前壁' WHEN 1 THEN '图中显示哪个器官' WHEN 2 THEN '病变数量是多少' WHEN 3 THEN '第一步：注射止血' WHEN 4 THEN '食管与胃的原理示意图' WHEN 5 THEN '请给出坐标' WHEN 6 THEN '波士顿肠道准备评分' WHEN 7 THEN '结肠黏膜光滑，未见特殊改变，血管纹理清晰可见' ELSE lang END"

_MCQ = """SELECT doc_id AS line, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'q1' ELSE 'q' || doc_id END AS qid,
CASE doc_id % 11 WHEN 0 THEN 'other' WHEN 1 THEN 'dev' WHEN 2 THEN 'internal_test' ELSE 'train' END AS split,
CASE WHEN doc_id % 13 = 0 THEN 'none_of_these' WHEN doc_id % 53 = 0 THEN ' ' ELSE 'anatomical_site_recognition' END AS query_type,
CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 29 = 0 THEN '正确答案在哪里' WHEN doc_id % 31 = 0 THEN 'is it value' || doc_id || ' here' ELSE 'which site is it' END AS question,
'value' || doc_id AS a, CASE WHEN doc_id % 7 = 0 THEN 'value' || doc_id ELSE lang END AS b, source AS c, CASE WHEN doc_id % 59 = 0 THEN NULL ELSE 'd' END AS d,
CASE WHEN doc_id % 37 = 0 THEN 'E' ELSE 'A' END AS answer, CASE WHEN doc_id % 41 = 0 THEN 'no' ELSE 'value' || doc_id END AS answer_text,
CASE WHEN doc_id % 43 = 0 THEN '' ELSE source END AS doc_id, '' AS doc_name, CASE WHEN doc_id % 47 = 0 THEN ' ' ELSE 'text' END AS evidence_text, doc_id % 4 AS n_pages, doc_id % 61 = 0 AS used_benchmark FROM T_documents"""
_MCQ_SQL = f"m AS (SELECT *, qid <> '' AND line > min(line) OVER (PARTITION BY qid) AS repeated FROM ({plain(_MCQ)}))"


def _mcq(spark, sf):
    m = fixture(spark, sf, _MCQ)
    letters = F.create_map(*[x for k in "abc" for x in (F.lit(k.upper()), F.col(k))])
    options = F.when(F.col("d").isNull(), letters).otherwise(F.map_concat(letters, F.create_map(F.lit("D"), F.col("d"))))
    return m.withColumns({"options": options, "evidence": F.array("evidence_text"), "pages": F.sequence(F.lit(1).cast("long"), F.col("n_pages") + 1)})


_OPTIONS = {"invalid_options": "d IS NULL", "duplicate_option_values": "d IS NOT NULL AND (a = b OR b = c OR a = c OR a = d OR b = d OR c = d)", "invalid_answer": "d IS NOT NULL AND answer = 'E'", "answer_text_mismatch": "d IS NOT NULL AND answer = 'A' AND answer_text <> a"}
_AWAY = {"question_answer_leakage": "question LIKE '%正确答案%'"}
_GOLD_RULES = {"missing_qid": "qid = ''", "missing_query_type": "trim(query_type) = ''", "missing_question": "question = ''", "duplicate_qid": "repeated", "invalid_split": "split = 'other'", "invalid_query_type": "query_type = 'none_of_these'", **_OPTIONS, **_AWAY, "answer_text_in_question": "length(answer_text) >= 4 AND contains(question, answer_text)", "missing_source_doc": "doc_id = ''", "missing_all_evidence_text": "trim(evidence_text) = ''", "pdf_context_pages_out_of_range": "n_pages >= 2"}
_MCQ_RULES = {k: v for k, v in _GOLD_RULES.items() if k not in ("invalid_query_type", "answer_text_in_question", "missing_all_evidence_text", "pdf_context_pages_out_of_range")} | {"missing_evidence_text": "trim(evidence_text) = ''", "benchmark_flag_not_false": "used_benchmark"}


def _report_sql(rules: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT line, '{n}' AS issue FROM m WHERE {c}" for n, c in rules.items())
    return f"WITH {_MCQ_SQL}, x AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY line) AS k FROM x) SELECT issue, count(*) AS n, string_agg(line, ',' ORDER BY line) FILTER (WHERE k <= 5) AS examples FROM r GROUP BY 1"


def _reported(judged):
    return V.issue_report(judged).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("validate_gold", _report_sql(_GOLD_RULES))
def validate_gold(spark, sf):
    return _reported(V.gold_issues(_mcq(spark, sf)))


@query("validate_mcq", _report_sql(_MCQ_RULES))
def validate_mcq(spark, sf):
    return _reported(V.mcq_issues(_mcq(spark, sf)))


@query("split_leakage", f"WITH {_MCQ_SQL} SELECT doc_id AS doc, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m WHERE doc_id <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    return V.split_leaks(_mcq(spark, sf)).select(F.col("doc_id").alias("doc"), F.array_join("splits", ",").alias("splits"))


@query("validate_generation", f"WITH {_MCQ_SQL} SELECT line, CASE {' '.join(f'WHEN {c} THEN ' + repr(n) for n, c in (('invalid_options', 'd IS NULL'), ('duplicate_option_values', _OPTIONS['duplicate_option_values']), ('invalid_candidate_answer', _OPTIONS['invalid_answer']), ('answer_text_mismatch', _OPTIONS['answer_text_mismatch']), ('empty_question', _GOLD_RULES['missing_question']), ('missing_evidence_basis', _MCQ_RULES['missing_evidence_text']), ('invalid_image_dependency', 'line % 5 = 3'), ('image_dependency_low', 'line % 5 = 4')))} END AS reason FROM m")
def validate_generation(spark, sf):
    dep = F.get(F.array(*map(F.lit, ("high", "medium", "high", "none", "low"))), (F.col("line") % 5).cast("int"))
    c = F.col
    return _mcq(spark, sf).select("line", V.generation_reason(c("options"), c("answer"), c("answer_text"), c("question"), c("evidence_text"), dep).alias("reason"))


_VER = "SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'F' ELSE 'B' END AS verifier_answer, doc_id % 19 <> 0 AS answer_supported, CASE WHEN doc_id % 17 = 0 THEN 'low' WHEN doc_id % 31 <> 0 THEN 'high' END AS image_dependency, CASE WHEN doc_id % 13 = 0 THEN 'low' ELSE 'high' END AS question_naturalness, doc_id % 11 <> 0 AS benchmark_style_match, doc_id % 9 = 0 AS multi_organ_ambiguity, CASE WHEN doc_id % 8 = 0 THEN 'poor' ELSE 'good' END AS option_quality, doc_id % 7 = 0 AS text_leakage, doc_id % 5 <> 0 AS all_options_same_granularity, doc_id % 3 = 0 AS multiple_correct_options FROM T_documents"


@query("verify_accept", f"SELECT doc_id, CASE WHEN verifier_answer = 'F' THEN 'missing_verifier_answer' WHEN NOT answer_supported THEN 'answer_not_supported' WHEN coalesce(image_dependency, 'low') = 'low' THEN 'low_image_dependency' WHEN question_naturalness = 'low' THEN 'low_naturalness' WHEN NOT benchmark_style_match THEN 'no_benchmark_style_match' WHEN multi_organ_ambiguity THEN 'multi_organ_ambiguity' WHEN option_quality <> 'good' THEN 'option_quality_not_good' WHEN text_leakage THEN 'text_leakage' WHEN NOT all_options_same_granularity THEN 'mixed_option_granularity' WHEN multiple_correct_options THEN 'multiple_correct_options' END AS reason FROM ({plain(_VER)})")
def verify_accept(spark, sf):
    v = fixture(spark, sf, _VER)
    return v.select("doc_id", V.verification_reason(F.struct(*[F.col(c) for c in v.columns])).alias("reason"))


@query("verify_three_gate", "SELECT event_id, -value / 100 < -0.25 AS pass_l1, -value / 50 < -0.5 AS pass_l2, event_id % 3 = 0 OR -value / 200 + value / 50 > 0.5 AS pass_l3 FROM events")
def verify_three_gate(spark, sf):
    v = F.col("value")
    return fixture(spark, sf, "SELECT event_id, value FROM T_events").select("event_id", *V.gates(-v / 100, -v / 50, -v / 200, F.col("event_id") % 3 == 0))


@query("keep_verdict", "SELECT event_id FROM events WHERE event_type <> 'error' AND value >= 10")
def keep_verdict(spark, sf):
    e = fixture(spark, sf, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'drop' ELSE ' Keep' END AS verdict, value FROM T_events")
    return e.where(V.keeps_verdict(F.col("verdict"), F.col("value"), 10.0)).select("event_id")


_LEVEL = [f"CASE WHEN doc_id % {17 + i} = 0 THEN '病变在哪里。' WHEN doc_id % {29 + i} = 0 THEN NULL ELSE 'level {i} of ' || lang || '？' END AS t{i}, doc_id % {5 + i} + {i} AS s{i}" for i in range(5)]
_CHAIN = f"SELECT doc_id, doc_id % 4 AS k, {', '.join(_LEVEL)} FROM T_documents"


def _chains(spark, sf):
    d = fixture(spark, sf, _CHAIN)
    item = lambda i: F.struct(F.when((F.col("doc_id") % 23 == 0) & F.lit(i == 2), "L9").otherwise(f"L{i}").alias("level"), F.col(f"t{i}").alias("query_text"), F.when(F.col("doc_id") % 31 != i, F.col(f"s{i}").cast("double")).alias("density_score"))
    whole = F.array(*map(item, range(5)))
    return d.select("doc_id", F.when(F.col("doc_id") % 37 == 0, F.slice(whole, 1, 4)).otherwise(whole).alias("chain"), *[f"t{i}" for i in range(5)])


def _chain_sql() -> str:
    parts = []
    for i in range(5):
        s = lambda j: f"CASE WHEN doc_id % 31 <> {j} THEN s{j}::DOUBLE END"
        before = "coalesce(" + ", ".join([*[s(j) for j in reversed(range(i))], "-1.0"]) + ")"
        parts += [f"CASE WHEN {i} = 2 AND doc_id % 23 = 0 THEN 'wrong_level_at_2,' ELSE '' END", f"CASE WHEN t{i} IS NULL OR NOT (t{i} LIKE '%？' AND length(t{i}) <= 80) THEN 'unnatural_query_format_at_{i},' ELSE '' END", f"CASE WHEN doc_id % 31 = {i} THEN 'missing_score_at_{i},' ELSE '' END", f"CASE WHEN {s(i)} <= {before} THEN 'non_monotonic_score_at_{i},' ELSE '' END"]
    last = "CASE WHEN length(coalesce(t4, '')) + 8 < length(coalesce(t3, '')) THEN 'l3_not_shorter_than_l4,' ELSE '' END"
    return f"SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'main_chain_not_5,' ELSE {' || '.join(parts)} || {last} END AS issues FROM ({plain(_CHAIN)})"


def _joined(c):
    return F.concat(F.array_join(c, ","), F.when(F.size(c) > 0, ",").otherwise(""))


@query("validate_chain", _chain_sql())
def validate_chain(spark, sf):
    return _chains(spark, sf).select("doc_id", V.chain_issues(F.col("chain")).alias("i")).select("doc_id", _joined("i").alias("issues"))


def _bad(t: str) -> str:
    return f"({t} IS NULL OR NOT ({t} LIKE '%？' AND length({t}) <= 80))"


@query("validate_rewrites", f"SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'missing_rewrites,' ELSE {' || '.join(f'CASE WHEN {_bad(f"t{i}")} THEN ' + repr(f'bad_rewrite_L{i},') + ' ELSE ' + repr('') + ' END' for i in range(5))} || CASE WHEN doc_id % 6 = 0 THEN 'missing_variants,' ELSE {' || '.join(f'CASE WHEN {_bad(f"t{i}")} THEN ' + repr(f'bad_variant_L{i},') + ' ELSE ' + repr('') + ' END' for i in (2, 3, 4))} END || CASE WHEN {_bad('t0')} THEN 'bad_hard_case_long_but_low_density,' ELSE '' END || 'bad_hard_case_short_but_high_density,' END AS issues FROM ({plain(_CHAIN)})")
def validate_rewrites(spark, sf):
    d = _chains(spark, sf)
    some = lambda ids: F.map_from_arrays(F.array(*[F.lit(f"L{i}") for i in ids]), F.array(*[F.col(f"t{i}") for i in ids]))
    r = F.when(F.col("doc_id") % 41 != 0, some(range(5)))
    v = F.when(F.col("doc_id") % 6 != 0, some((2, 3, 4)))
    return d.select("doc_id", V.rewrite_issues(r, v, F.create_map(F.lit(V.CASES[0]), F.col("t0"))).alias("i")).select("doc_id", _joined("i").alias("issues"))


@query("overlay_rewrites", f"SELECT doc_id, coalesce(t0, '') || '|' || 'new' || '|' || coalesce(t2, '') AS texts FROM ({plain(_CHAIN)}) WHERE doc_id % 37 <> 0")
def overlay_rewrites(spark, sf):
    d = _chains(spark, sf).where("doc_id % 37 <> 0").withColumn("c", V.overlay(F.col("chain"), F.create_map(F.lit("L1"), F.lit(" new "))))
    return d.select("doc_id", F.array_join(F.transform(F.slice("c", 1, 3), lambda x: F.coalesce(x["query_text"], F.lit(""))), "|").alias("texts"))


_X = f"x AS (SELECT doc_id, i, CASE WHEN i = 2 AND doc_id % 23 = 0 THEN 'L9' ELSE 'L' || i END AS level, CASE i WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END AS t, CASE WHEN doc_id % 31 <> i THEN CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END END AS s FROM ({plain(_CHAIN)}), range(5) r(i) WHERE doc_id % 37 <> 0)"


@query("check_chains", f"WITH {_X}, y AS (SELECT *, lag(s, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS p, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS k FROM x) SELECT level, count(*) AS n, count(*) FILTER (WHERE t NOT LIKE '%？') AS n_not_question, count(*) FILTER (WHERE length(t) > 90) AS n_too_long, count(*) FILTER (WHERE k > 1) AS n_duplicate, count(*) FILTER (WHERE s <= p) AS n_not_rising, min(length(t)) AS least, quantile_cont(length(t), 0.5) AS median, max(length(t)) AS most FROM y GROUP BY 1")
def check_chains(spark, sf):
    return V.chain_report(_chains(spark, sf).select(F.col("doc_id").alias("id"), "chain"))


@query("audit_summary", f"WITH {_X} SELECT level, CASE WHEN contains(t, '病变') THEN 'lesion_presence_or_type' WHEN t IS NULL THEN 'none' ELSE 'other_template_query' END AS kind, count(*) AS n FROM x GROUP BY 1, 2")
def audit_summary(spark, sf):
    x = _chains(spark, sf).where(F.size("chain") == 5).select(F.explode("chain").alias("c")).select("c.*")
    kind = F.when(F.col("query_text").isNull(), "none").otherwise(V.first_bucket(F.col("query_text"), GROUPS, "other_template_query"))
    return x.groupBy("level", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_RECORD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS text, CASE doc_id % 3 WHEN 0 THEN '12' WHEN 1 THEN 'x7' END AS block_raw, CASE WHEN doc_id % 7 = 0 THEN 'p1' ELSE '3' END AS page_raw FROM T_documents"


@query("validate_jsonl", f"WITH r AS ({plain(_RECORD)}) SELECT 'missing_text' AS name, count(*) AS n FROM r WHERE text = '' UNION ALL SELECT 'invalid_block_id', count(*) FROM r WHERE block_raw = 'x7' UNION ALL SELECT 'invalid_page_idx', count(*) FROM r WHERE page_raw = 'p1' UNION ALL SELECT 'key:' || k, count(*) FROM (SELECT unnest(['doc_id', 'text', 'page_raw']) AS k FROM r UNION ALL SELECT 'block_raw' FROM r WHERE block_raw IS NOT NULL) GROUP BY 1")
def validate_jsonl(spark, sf):
    r = fixture(spark, sf, _RECORD)
    errors = V.record_errors({"text": F.col("text"), "block_id_raw": F.col("block_raw"), "page_idx_raw": F.col("page_raw")})
    a = r.select(F.explode(errors).alias("name"))
    b = r.select(F.explode(V.key_counts(F.to_json(F.struct("*")))).alias("k")).select(F.concat(F.lit("key:"), "k").alias("name"))
    return a.unionByName(b).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _hit_sql(words: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(z, w))"


@query("route_query_types", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN len({_hit_sql(ANATOMY)}) >= 2 THEN 'anatomical_site_recognition' END, CASE WHEN len({_hit_sql(LESION)}) > 0 THEN 'lesion_or_finding_identification' END, CASE WHEN len({_hit_sql(PROCEDURE)}) > 0 THEN 'procedure_or_operation_recognition' END, CASE WHEN len({_hit_sql(SPATIAL)}) > 0 THEN 'spatial_region_understanding' END], lambda x: x IS NOT NULL), ',') AS routes, array_to_string({_hit_sql(LESION)}[1:8], ',') AS lesions FROM (SELECT doc_id, {ZH} AS z FROM documents)")
def route_query_types(spark, sf):
    """Types by how many words of a list a text holds (two for anatomy), with the words as reasons."""
    d = fixture(spark, sf, f"SELECT doc_id, {ZH} AS z FROM T_documents")
    n = {k: V.hits_of(F.col("z"), w) for k, w in zip(V.QUERY_TYPES, (ANATOMY, LESION, PROCEDURE, SPATIAL), strict=True)}
    routes = V.found([(F.size(h) >= (2 if k == V.QUERY_TYPES[0] else 1), k) for k, h in n.items()])
    return d.select("doc_id", F.array_join(routes, ",").alias("routes"), F.array_join(F.slice(n[V.QUERY_TYPES[1]], 1, 8), ",").alias("lesions"))


def _has(words: tuple[str, ...], z: str = "z") -> str:
    return "(" + " OR ".join(f"contains({z}, '{w}')" for w in words) + ")"


@query("keyword_bucket", f"SELECT doc_id, CASE {' '.join(f'WHEN {_has(w)} THEN ' + repr(n) for n, w in GROUPS)} ELSE 'other_template_query' END AS bucket FROM (SELECT doc_id, {ZH} AS z FROM documents)")
def keyword_bucket(spark, sf):
    return fixture(spark, sf, f"SELECT doc_id, {ZH} AS z FROM T_documents").select("doc_id", V.first_bucket(F.col("z"), GROUPS, "other_template_query").alias("bucket"))


_KIND = "CASE doc_id % 4 WHEN 0 THEN '病变特征' WHEN 1 THEN '检查操作' WHEN 2 THEN '解剖特征' ELSE '其他' END"
_LEGACY = f"SELECT *, CASE WHEN f AND n BETWEEN 12 AND 80 AND NOT s AND NOT c AND NOT m THEN 'direct_reuse' WHEN f AND n BETWEEN 20 AND 220 AND NOT c AND NOT s THEN 'rewrite_reuse' WHEN k IN ('检查操作', '治疗操作', '基础概念') OR s OR c OR m OR n > 220 THEN 'weak_or_discard' ELSE 'borderline' END AS bucket FROM (SELECT *, length(z) AS n, k IN ('病变特征', '诊断评估', '解剖特征') AS f, {_has(STEPS)} AS s, {_has(CONCEPTS)} AS c, {_has(SEVERAL)} AS m FROM (SELECT doc_id, {ZH} || CASE WHEN doc_id % 2 = 0 THEN '，血管纹理清晰' ELSE '' END AS z, {_KIND} AS k FROM documents))"


def _legacy(spark, sf):
    d = fixture(spark, sf, f"SELECT doc_id, concat({ZH}, CASE WHEN doc_id % 2 = 0 THEN '，血管纹理清晰' ELSE '' END) AS z, {_KIND} AS k FROM T_documents")
    return d.withColumn("bucket", V.reuse_bucket(F.col("z"), F.col("k"), FACTUAL, WEAK, STEPS, CONCEPTS, SEVERAL))


@query("legacy_bucket", f"SELECT doc_id, bucket FROM ({_LEGACY})")
def legacy_bucket(spark, sf):
    return _legacy(spark, sf).select("doc_id", "bucket")


@query("pick_legacy", f"SELECT doc_id FROM ({_LEGACY}) WHERE bucket <> 'weak_or_discard' AND doc_id % 3 > 0")
def pick_legacy(spark, sf):
    decision = F.when(F.col("doc_id") % 3 == 0, "discard").when(F.col("doc_id") % 3 == 1, " Keep").otherwise("rewrite_reuse")
    return _legacy(spark, sf).where(V.kept_for_reuse(F.col("bucket"), decision, ("weak_or_discard",))).select("doc_id")


@query("crc_include")
def crc_include(spark, sf):
    return fixture(spark, sf, "SELECT doc_id FROM T_documents").where(V.included(F.concat(F.lit("q"), F.col("doc_id")), 0.3))


_SP = "SELECT doc_id, doc_id % 3 AS i0, CAST(-(doc_id % 5) + 2 AS DOUBLE) AS v0, doc_id % 3 AS i1, CAST(1.5 AS DOUBLE) AS v1, doc_id % 7 - 1 AS i2, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 2.0 END AS v2 FROM T_documents"
_SP_SQL = f"p AS (SELECT doc_id, unnest([i0, i1, i2]) AS i, unnest([v0, v1, v2]) AS v, unnest([0, 1, 2]) AS k FROM ({plain(_SP)}))"


def _sparse(spark, sf):
    return fixture(spark, sf, _SP).select("doc_id", F.array("i0", "i1", "i2").alias("i"), F.array(*[F.col(f"v{k}").cast("double") for k in range(3)]).alias("v"))


def _entries(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"].cast("string"), F.format_number(e["value"], 2))), ",")


@query("sparse_validate", f"WITH {_SP_SQL}, s AS (SELECT doc_id, i, sum(v) AS v FROM p WHERE i >= 0 AND v <> 0 GROUP BY 1, 2) SELECT doc_id, string_agg(i || ':' || printf('%.2f', v), ',' ORDER BY i) AS vector FROM s GROUP BY 1")
def sparse_validate(spark, sf):
    d = _sparse(spark, sf).select("doc_id", V.sparse_clean(F.col("i"), F.col("v")).alias("m")).where("m is not null")
    return d.select("doc_id", _entries("m").alias("vector"))


@query("sparse_normalize", f"WITH {_SP_SQL}, s AS (SELECT doc_id, i, arg_max(v, k) AS v FROM p WHERE v <> 0 GROUP BY 1, 2) SELECT doc_id, string_agg(i || ':' || printf('%.2f', v), ',' ORDER BY i) AS vector FROM s GROUP BY 1")
def sparse_normalize(spark, sf):
    return _sparse(spark, sf).select("doc_id", _entries(V.sparse_map(F.col("i"), F.col("v"))).alias("vector"))


@query("lexical_weights", f"WITH {_SP_SQL} SELECT d.doc_id, coalesce(vector, '') AS vector FROM documents d LEFT JOIN (SELECT doc_id, string_agg(i || ':' || printf('%.2f', v), ',' ORDER BY i) AS vector FROM (SELECT doc_id, i, max(v) AS v FROM p WHERE v > 0 AND i <> 2 AND NOT (k = 1 AND doc_id % 2 = 0) GROUP BY 1, 2) GROUP BY 1) s ON d.doc_id = s.doc_id")
def lexical_weights(spark, sf):
    mask = F.array(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1), F.lit(1))
    d = _sparse(spark, sf).withColumn("mask", mask)
    return d.select("doc_id", _entries(V.lexical_weights(F.col("i"), F.col("mask"), F.col("v"), (2,))).alias("vector"))


@query("lexical_rebuild", f"WITH {_SP_SQL} SELECT doc_id, count(DISTINCT i) AS n_terms FROM p WHERE v > 0 AND i <> 2 GROUP BY 1")
def lexical_rebuild(spark, sf):
    """A table with one more column of lexical weights, written and read back; rows without any weight go."""
    from ..sources import io

    path = io.scratch(spark, "lexical")
    d = _sparse(spark, sf).select("doc_id", V.lexical_weights(F.col("i"), F.array(F.lit(1), F.lit(1), F.lit(1)), F.col("v"), (2,)).alias("lexical"))
    d.where(F.size("lexical") > 0).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.size("lexical").cast("long").alias("n_terms"))


@query("extract_best_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'sum ' || lang ELSE source || '-longest' END AS text FROM documents")
def extract_best_text(spark, sf):
    m = F.col("doc_id") % 3
    fields = {"text": F.when(m == 0, F.col("lang")).otherwise(" "), "summary": F.when(m == 1, F.concat(F.lit("sum "), "lang")), "other": F.concat("source", F.lit("-longest")), "short": F.lit("x")}
    record = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))
    return fixture(spark, sf, "SELECT doc_id, lang, source FROM T_documents").select("doc_id", V.best_text(record, TEXT_FIELDS).alias("text"))
