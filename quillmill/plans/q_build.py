"""Queries: records, samples, index rows, questions, pools, jobs, seeds, samplers and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import records as R
from . import q_search as QS
from .base import fixture, plain, query, table

c = F.col

PATHS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/store/book__ab' || doc_id || '/name' || doc_id || '/auto/images/p.jpg' WHEN 1 THEN 'x/y.jpg' ELSE 'r/plain/n1/auto/images/q.png' END AS path, lang, source, text, n_chars FROM T_documents"


@query("path_doc_info", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ab' || doc_id ELSE '' END AS doc, CASE doc_id % 3 WHEN 0 THEN 'name' || doc_id WHEN 1 THEN '' ELSE 'n1' END AS name, CASE doc_id % 3 WHEN 0 THEN '/store/book__ab' || doc_id || '/name' || doc_id WHEN 1 THEN 'x' ELSE 'r/plain/n1' END AS src FROM documents")
def path_doc_info(spark, sf):
    doc, name, src = B.path_info(c("path"))
    return fixture(spark, sf, PATHS).select("doc_id", doc.alias("doc"), name.alias("name"), src.alias("src"))


_DERIVE = "SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'given' END AS id0, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'My Name' END AS name0, CASE WHEN doc_id % 3 = 0 THEN '/o/the_book__0a1b2c3d/' ELSE '' END AS out_dir, CASE WHEN doc_id % 2 = 0 THEN '/o/the_book__0a1b2c3d/title_x/auto' ELSE '/o/loose_name' END AS parse_dir FROM T_documents"


@query("derive_doc_fields", f"SELECT k, CASE WHEN id0 IS NOT NULL THEN id0 WHEN out_dir <> '' THEN '0a1b2c3d' ELSE '' END AS doc, CASE WHEN name0 IS NOT NULL THEN name0 WHEN parse_dir LIKE '%auto' THEN 'title_x' WHEN out_dir <> '' THEN 'the book' ELSE 'loose name' END AS name FROM ({plain(_DERIVE)})")
def derive_doc_fields(spark, sf):
    doc, name = B.doc_fields(c("id0"), c("name0"), c("out_dir"), c("parse_dir"))
    return fixture(spark, sf, _DERIVE).select("k", doc.alias("doc"), name.alias("name"))


_JSON = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '["a", " b ", ""]' WHEN 1 THEN 'plain' WHEN 2 THEN '' WHEN 3 THEN '[broken' ELSE '{"k": "v", "n": 3}' END AS v FROM T_documents"""


@query("coerce_json", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN 'plain' WHEN 2 THEN '' WHEN 3 THEN '[broken' ELSE '{"k": "v", "n": 3}' END AS list, CASE WHEN doc_id % 5 = 4 THEN 'k=v,n=3' ELSE '' END AS map FROM documents""")
def coerce_json(spark, sf):
    m = F.array_join(F.transform(F.array_sort(F.map_entries(B.dict_of(c("v")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return fixture(spark, sf, _JSON).select("doc_id", F.array_join(B.list_of(c("v")), "|").alias("list"), m.alias("map"))


@query("pick_first_key", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS first_text, CASE doc_id % 3 WHEN 0 THEN 7 WHEN 1 THEN -1 ELSE n_chars END AS first_int FROM documents")
def pick_first_key(spark, sf):
    d = fixture(spark, sf, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '  ' END AS a, source AS b, CASE doc_id % 3 WHEN 0 THEN '7' WHEN 1 THEN 'x' END AS p, n_chars FROM T_documents")
    return d.select("doc_id", B.first_text(c("a"), c("b")).alias("first_text"), B.first_int(-1, c("p"), c("n_chars").cast("string")).alias("first_int"))


_RAW = "SELECT doc_id AS line, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS text, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE source END AS content, CASE WHEN doc_id % 5 = 0 THEN 'own' || doc_id END AS sample_id, CASE WHEN doc_id % 3 > 0 THEN 'd' || doc_id ELSE '' END AS doc_id, CASE doc_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE '' || doc_id END AS block_id, '3' AS page_idx, CASE WHEN doc_id % 6 = 0 THEN 'g1' END AS group_id, CAST(NULL AS VARCHAR(9)) AS source_type, CASE WHEN doc_id % 2 = 0 THEN 'hash' || doc_id || 'abcdefghijklmnop' END AS content_hash, CASE doc_id % 3 WHEN 0 THEN '[\"通用\", \"胃\"]' WHEN 1 THEN '[\"胃\", \"肠\"]' ELSE '胃' END AS organ_tags FROM T_documents"


@query("normalize_record", f"WITH r AS (SELECT *, trim(coalesce(text, content)) AS t, coalesce(content_hash, '') AS h, CASE WHEN block_id IS NULL THEN ('0x' || substr(sha1(CASE WHEN coalesce(content_hash, '') <> '' THEN content_hash WHEN trim(coalesce(text, content)) <> '' THEN trim(coalesce(text, content)) ELSE 'line_' || line END), 1, 15))::BIGINT WHEN block_id = 'bad' THEN -1 ELSE block_id::BIGINT END AS b FROM ({plain(_RAW)})), s AS (SELECT *, CASE WHEN sample_id IS NOT NULL THEN sample_id WHEN doc_id <> '' AND b >= 0 THEN 'txt_' || doc_id || '_' || b WHEN h <> '' THEN 'txt_append_' || substr(h, 1, 16) ELSE 'txt_append_' || md5(t) END AS sid FROM r) SELECT line, sid AS sample_id, coalesce(group_id, 'grp_' || sid) AS group_id, t AS text, b AS block_id, line % 3 = 0 AS is_general, line % 3 = 1 AS is_mixed, CASE WHEN line % 3 = 0 THEN '通用' ELSE '胃' END AS body_site_main, concat_ws(',', CASE WHEN t = '' THEN 'missing_text' END, CASE WHEN block_id = 'bad' THEN 'invalid_block_id' END) AS errors FROM s")
def normalize_record(spark, sf):
    n = B.normalized(fixture(spark, sf, _RAW))
    return n.select("line", "sample_id", "group_id", "text", "block_id", "is_general", "is_mixed", "body_site_main", F.array_join("errors", ",").alias("errors"))


@query("text_index_row", f"WITH r AS ({plain(_RAW)}) SELECT count(*) AS n, count(DISTINCT sample_id) FILTER (WHERE sample_id IS NOT NULL) AS own, count(*) FILTER (WHERE line % 3 = 0) AS general FROM r")
def text_index_row(spark, sf):
    """Index rows written as a table by their schema and read back."""
    from ..sources import io

    path = io.scratch(spark, "index")
    n = B.normalized(fixture(spark, sf, _RAW))
    n.where("sample_id is not null").select("sample_id", "group_id", "text", "source_type", "body_site_main", "organ_tags", "is_general", "is_mixed", "doc_id", "page_idx", "block_id").write.parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(c("sample_id").startswith("own"), c("sample_id"))).alias("own"), F.count_if("is_general").alias("general"))


_BLOCKS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'table' WHEN 3 THEN 'discarded' ELSE 'list' END AS kind, ' body ' || page_id AS text, url, page_id % 3 AS page FROM T_pages"


@query("build_assetpack", f"SELECT page_id, kind, CASE kind WHEN 'text' THEN text WHEN 'discarded' THEN text WHEN 'list' THEN trim(text) ELSE 'cap' || chr(10) || url END AS body, CASE WHEN kind IN ('image', 'table') THEN 'dir/img/' || page_id || '.jpg' END AS img, CASE WHEN kind = 'table' THEN '<table>' END AS html, kind = 'discarded' AS is_noise FROM ({plain(_BLOCKS)})")
def build_assetpack(spark, sf):
    b = fixture(spark, sf, _BLOCKS)
    img = F.when(c("kind").isin("image", "table"), F.concat(F.lit("img/"), c("page_id").cast("string"), F.lit(".jpg")))
    r = B.flat_block(c("kind"), c("text"), F.array(F.lit(" cap "), F.lit("")), F.array(c("url")), img, F.lit("<table>"), F.lit("dir"), c("page"))
    return b.select("page_id", "kind", r["text"].alias("body"), r["img_abs_path"].alias("img"), r["table_html"].alias("html"), r["is_noise"].alias("is_noise"))


@query("item_text", f"SELECT page_id, 'body ' || page_id || ' cap ' || url AS body FROM ({plain(_BLOCKS)})")
def item_text(spark, sf):
    """Text, captions and footnotes of a content item, blank ones left out."""
    parts = F.filter(F.transform(F.array(c("text"), F.lit(" cap "), F.lit(None).cast("string"), c("url"), F.lit(" ")), lambda x: T.normalize(x)), lambda x: x != "")
    return fixture(spark, sf, _BLOCKS).select("page_id", F.array_join(parts, " ").alias("body"))


@query("load_text_assetpack", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'b1' ELSE 'unknown' END AS doc FROM ({plain(_BLOCKS)}) WHERE kind = 'text'")
def load_text_assetpack(spark, sf):
    """Only text blocks that are not blank; the document from the folder's suffix."""
    b = fixture(spark, sf, _BLOCKS).withColumn("dir", F.when(c("page_id") % 2 == 0, "book__b1").otherwise("book"))
    doc = F.when(F.contains("dir", F.lit("__")), R.doc_id_of(c("dir"))).otherwise("unknown")
    return b.where((c("kind") == "text") & (F.trim("text") != "")).select("page_id", doc.alias("doc"))


_TB = "SELECT doc_id AS block_id, CASE WHEN doc_id % 9 = 0 THEN 'gone' ELSE source END AS doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '[\"通用\"]' ELSE '[\"胃\", \"胃\", \"肠\"]' END AS organ_tags, lang AS primary_type FROM T_documents"


@query("build_sample_text", f"SELECT 'txt_' || doc_id || '_' || block_id AS sample_id, CASE WHEN doc_id = 'gone' THEN '' ELSE 'name of ' || doc_id END AS doc_name, primary_type AS knowledge_type_main, CASE WHEN block_id % 3 = 0 THEN '通用' ELSE '胃' END AS body_site_main, block_id % 3 <> 0 AS is_mixed FROM ({plain(_TB)})")
def build_sample_text(spark, sf):
    docs = fixture(spark, sf, "SELECT DISTINCT source AS doc_id, 'name of ' || source AS doc_name, '/s/' || source AS source_path FROM T_documents")
    return B.text_sample(fixture(spark, sf, _TB), docs).select("sample_id", "doc_name", "knowledge_type_main", "body_site_main", "is_mixed")


@query("build_sample_image", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'imgtxt_ab' || doc_id ELSE 'imgtxt_unknown' END || '_' || lpad(doc_id::VARCHAR, 6, '0') AS sample_id, sha256(CASE doc_id % 3 WHEN 0 THEN '/store/book__ab' || doc_id || '/name' || doc_id || '/auto/images/p.jpg' WHEN 1 THEN 'x/y.jpg' ELSE 'r/plain/n1/auto/images/q.png' END || chr(10) || text) AS content_hash FROM documents")
def build_sample_image(spark, sf):
    return B.image_sample(fixture(spark, sf, PATHS).select(c("doc_id").alias("line"), c("path").alias("image_path"), "text")).select("sample_id", "content_hash")


@query("hit_normalize", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS text, CASE doc_id % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")
def hit_normalize(spark, sf):
    d = fixture(spark, sf, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS text, source AS content, CASE WHEN doc_id % 3 = 0 THEN CAST(2.5 AS DOUBLE) END AS w, CASE WHEN doc_id % 3 = 1 THEN CAST(1 AS DOUBLE) END AS r FROM T_documents")
    return d.select("doc_id", F.coalesce("text", "content").alias("text"), B.hit_score(c("w"), c("r"), F.lit(None).cast("double")).alias("score"))


@query("candidate_score", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value * 2 WHEN 2 THEN -value ELSE 0 END AS score FROM events")
def candidate_score(spark, sf):
    e = fixture(spark, sf, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value END AS w, CASE WHEN event_id % 4 = 1 THEN value * 2 END AS r, CASE WHEN event_id % 4 = 2 THEN -value END AS s FROM T_events")
    return e.select("event_id", B.hit_score(c("w"), c("r"), c("s")).alias("score"))


@query("candidate_key", "SELECT doc_id, md5(lang || '|' || doc_id || '||' || source) AS key FROM documents")
def candidate_key(spark, sf):
    return fixture(spark, sf, "SELECT doc_id, lang, source FROM T_documents").select("doc_id", B.candidate_key(c("lang"), c("doc_id"), F.lit(None).cast("string"), c("source")).alias("key"))


@query("export_pdf_mapping", "SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'missing_run_cmd' WHEN n.n_regionkey = 0 THEN 'missing_pdf' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE n.n_name || '.pdf' END AS pdf_name, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id % 4 + 1 END AS page_num FROM documents d LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 25")
def export_pdf_mapping(spark, sf):
    """Rows to the PDF they come from, with the status of the link; nations stand for documents' run records."""
    d = fixture(spark, sf, "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id % 25 END AS k, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 4 END AS page FROM T_documents")
    m = fixture(spark, sf, "SELECT n_nationkey AS k, n_name || '.pdf' AS pdf, n_regionkey > 0 AS there FROM T_nation")
    x = d.join(m, "k", "left")
    status = F.when(c("pdf").isNull(), "missing_run_cmd").when(~c("there"), "missing_pdf").otherwise("ok")
    return x.select("doc_id", status.alias("status"), F.coalesce("pdf", F.lit("")).alias("pdf_name"), F.when(c("page") >= 0, c("page") + 1).alias("page_num"))


@query("hybrid_row", "SELECT doc_id AS pk, length(t[1:8192]) AS n_text, md5(t[1:512]) AS summary, CASE WHEN en::DOUBLE / greatest(en, 1) >= 0.6 THEN 'en' ELSE 'mix' END AS lang FROM (SELECT doc_id, t, length(regexp_replace(t[1:8192], '[^A-Za-z]', '', 'g')) AS en FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents))")
def hybrid_row(spark, sf):
    """A parsed block as index row: text to 8192 and summary to 512 characters, its language."""
    t = F.substring(T.normalize(c("text")), 1, 8192)
    d = fixture(spark, sf, "SELECT doc_id, text FROM T_documents").select(c("doc_id").alias("pk"), t.alias("t"))
    return d.select("pk", F.length("t").cast("long").alias("n_text"), F.md5(F.substring("t", 1, 512)).alias("summary"), T.detect_lang(c("t")).alias("lang"))


@query("tokens_in_vocab", f"WITH {QS.STATS}, v AS (SELECT token FROM df WHERE df >= 3), q AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), k AS (SELECT item_id, CASE WHEN w IN (SELECT token FROM v) THEN w WHEN lower(w) IN (SELECT token FROM v) THEN lower(w) END AS token FROM q) SELECT item_id, count(*) AS n, count(DISTINCT token) AS d FROM k WHERE token IS NOT NULL GROUP BY 1")
def tokens_in_vocab(spark, sf):
    from ..operators import search as S
    from ..operators import validate as V

    _, df = S.corpus_stats(QS.terms(spark, sf), fixture(spark, sf, "SELECT doc_id FROM T_documents"))
    q = fixture(spark, sf, "SELECT item_id, text FROM T_benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return V.in_vocabulary(q, df.where("df >= 3")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("d"))


@query("sparse_rebuild", f"WITH {QS.POST} SELECT docid, count(*) AS n_terms, round(sum(weight), 4) AS total FROM post GROUP BY 1")
def sparse_rebuild(spark, sf):
    """Weights of an existing table computed anew and written as its sparse column; rows without any term go."""
    from ..operators import search as S
    from ..sources import io

    t = QS.terms(spark, sf)
    stats, w = QS.weights(spark, sf, t)
    path = io.scratch(spark, "sparse")
    v = S.bm25_vectors(t, w, stats).repartition("docid")
    v.groupBy("docid").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("sparse")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("docid", F.size("sparse").cast("long").alias("n_terms"), F.round(F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("tokenise_mixed", r"SELECT item_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9’''_\-]+')) + len(regexp_extract_all(lower(text), '[a-z0-9’''_\-]+')) AS n FROM (SELECT item_id, text || ' 胃镜ESD' AS text FROM benchmark)")
def tokenise_mixed(spark, sf):
    """English words count twice, once as they stand and once in lower case."""
    return fixture(spark, sf, "SELECT item_id, text || ' 胃镜ESD' AS text FROM T_benchmark").select("item_id", F.size(T.tokens_mixed(c("text"), None)).cast("long").alias("n"))


_ITEMS = "SELECT page_id, page_id % 3 = 0 AS is_image, 'img' || (page_id % 7) || '.jpg' AS name, page_id DIV 4 AS page FROM T_pages"
_ITEMS_SQL = plain(_ITEMS).replace(" DIV ", " // ")


@query("image_page", f"SELECT k, coalesce((SELECT arg_min(page, page_id) FROM ({_ITEMS_SQL}) WHERE is_image AND name = 'img' || k || '.jpg'), 99) AS page FROM range(10) t(k)")
def image_page(spark, sf):
    """The page of the first image item that has the image's file name, else the stored page."""
    items = fixture(spark, sf, _ITEMS).where("is_image").groupBy("name").agg(F.min_by("page", "page_id").alias("page"))
    want = spark.range(10).select(c("id").alias("k"), F.element_at(F.split(F.concat(F.lit("/a/img"), c("id").cast("string"), F.lit(".jpg")), "/"), -1).alias("name"))
    return want.join(items, "name", "left").select("k", F.coalesce("page", F.lit(99)).alias("page"))


@query("image_item_index", f"SELECT name, min(page_id) AS idx FROM ({_ITEMS_SQL}) WHERE is_image GROUP BY 1")
def image_item_index(spark, sf):
    return fixture(spark, sf, _ITEMS).where("is_image").groupBy("name").agg(F.min("page_id").alias("idx"))


_POOL = ("胃", "食管", "结肠", "直肠", "胰腺")
_POOL_SQL = "[" + ", ".join(f"'{x}'" for x in _POOL) + "]"
_MCQ = "SELECT doc_id AS sample_id, CASE doc_id % 6 WHEN 0 THEN '胃' WHEN 1 THEN '食管' WHEN 2 THEN '' ELSE '结肠' END AS answer_text FROM T_documents"


def _order(values: str, seed: str) -> str:
    return f"list_transform(list_sort(list_transform({values}, lambda v: sha1({seed} || ':' || v) || v)), lambda y: y[41:])"


_MCQ_SQL = f"WITH s AS (SELECT *, 's1:' || sample_id AS seed FROM ({plain(_MCQ)}) WHERE answer_text <> ''), d AS (SELECT *, {_order(f'list_filter({_POOL_SQL}, lambda v: v <> answer_text)', 'seed')}[1:3] AS ds FROM s), v AS (SELECT *, {_order('list_concat([answer_text], ds)', "(seed || ':o')")} AS vs FROM d) SELECT 'mcq_' || substr(sha1(seed), 1, 12) AS qid, vs[1] AS o1, vs[4] AS o4, chr(64 + list_position(vs, answer_text)::INT) AS answer, answer_text FROM v"


@query("mcq_build", _MCQ_SQL)
def mcq_build(spark, sf):
    q = B.mcq(fixture(spark, sf, _MCQ), F.array(*map(F.lit, _POOL)), "s1", "which organ is shown?")
    return q.select("qid", "o1", "o4", "answer", "answer_text")


@query("image_mcq_build", f"WITH m AS ({_MCQ_SQL}) SELECT answer, count(*) AS n FROM m GROUP BY 1")
def image_mcq_build(spark, sf):
    """Image questions with a page window as context; how often each letter is the answer."""
    s = fixture(spark, sf, _MCQ).where("answer_text <> ''")
    pages = fixture(spark, sf, "SELECT page_id, url FROM T_pages")
    q = B.mcq(s, F.array(*map(F.lit, _POOL)), "s1", "which organ is shown?")
    window = q.withColumn("p", F.col("sample_id") % 10).join(pages.groupBy((c("page_id") % 10).alias("p")).agg(F.min("url").alias("context")), "p", "left")
    return window.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


@query("option_shuffle", f"SELECT doc_id, array_to_string({_order("['w', 'x', 'y', 'z']", "doc_id::VARCHAR")}, '') AS o FROM documents")
def option_shuffle(spark, sf):
    return fixture(spark, sf, "SELECT doc_id FROM T_documents").select("doc_id", F.array_join(B.hash_shuffled(F.array(*map(F.lit, "wxyz")), c("doc_id").cast("string")), "").alias("o"))


@query("stable_pick", "SELECT doc_id, ['a', 'b', 'c'][(('0x' || substr(sha1(lang || doc_id), 1, 8))::BIGINT % 3) + 1] AS pick FROM documents")
def stable_pick(spark, sf):
    return fixture(spark, sf, "SELECT doc_id, lang FROM T_documents").select("doc_id", B.stable_pick(F.concat(c("lang"), c("doc_id").cast("string")), F.array(*map(F.lit, "abc"))).alias("pick"))


_SRC = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'i.jpg' END AS image, doc_id % 11 <> 0 AS there, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END AS src, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'o.pdf' END AS pdf, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'c.json' END AS content, CASE WHEN doc_id % 23 > 0 THEN 1 END AS page, CASE WHEN n_chars > 900 THEN 'long enough context' ELSE '' END AS context, CASE WHEN doc_id % 2 = 0 THEN 'cap' ELSE '' END AS caption FROM T_documents"


@query("source_pool", f"SELECT doc_id, CASE WHEN image = '' THEN 'no_image_path' WHEN NOT there THEN 'missing_image_file' WHEN src IS NULL THEN 'missing_source_path' WHEN pdf = '' THEN 'missing_origin_pdf' WHEN content = '' THEN 'missing_content_list' WHEN page IS NULL THEN 'cannot_infer_page_idx' WHEN context = '' AND caption = '' THEN 'empty_text_and_context' END AS reason FROM ({plain(_SRC)})")
def source_pool(spark, sf):
    return fixture(spark, sf, _SRC).select("doc_id", B.source_reason(c("image"), c("there"), c("src"), c("pdf"), c("content"), c("page"), c("context"), F.lit(""), c("caption"), 10).alias("reason"))


_CUTS = [sum(w for *_, w in B.PAIRS[: i + 1]) for i in range(len(B.PAIRS))]
_PAIR = " ".join(f"WHEN h < {cut} THEN '{p[0]}{p[1]}'" for cut, p in zip(_CUTS, B.PAIRS, strict=True))


@query("target_jobs", f"SELECT doc_id, CASE {_PAIR} END AS pair FROM (SELECT doc_id, ('0x' || substr(sha1('job' || doc_id), 1, 8))::BIGINT % {_CUTS[-1]} AS h FROM documents)")
def target_jobs(spark, sf):
    p = B.weighted_pair(F.concat(F.lit("job"), c("doc_id").cast("string")))
    return fixture(spark, sf, "SELECT doc_id FROM T_documents").select("doc_id", F.concat(p["level"], p["route"]).alias("pair"))


_JOBS = "SELECT doc_id AS job_id, 'L' || (doc_id % 5) AS level, 'R' || (doc_id % 3) AS route FROM T_documents"
_CASES = "SELECT item_id AS case_id, 'L' || (item_id % 4) AS level, 'R' || (item_id % 2) AS route FROM T_benchmark"


@query("alignment_cases", f"SELECT * FROM (SELECT job_id, case_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN j.level = k.level AND j.route = k.route THEN 0 WHEN j.route = k.route THEN 1 WHEN j.level = k.level THEN 2 ELSE 3 END, case_id) AS pos FROM ({plain(_JOBS)}) j, ({plain(_CASES)}) k) WHERE pos <= 6")
def alignment_cases(spark, sf):
    return B.alignment_cases(fixture(spark, sf, _JOBS), fixture(spark, sf, _CASES), 6)


@query("rank_signal", "WITH r AS (SELECT value AS score, 'L' || (user_id % 3) AS level FROM events WHERE event_id % 2 = 0), s AS (SELECT event_id AS id, value AS score FROM events WHERE event_id % 2 = 1), m AS (SELECT level, quantile_disc(score, 0.5) AS p50 FROM r GROUP BY 1), u AS (SELECT id, s.score, round(100.0 * (SELECT count(*) FROM r WHERE r.score <= s.score) / (SELECT count(*) FROM r), 4) AS percentile FROM s) SELECT id, percentile, arg_min(level, (abs(score - p50), level)) AS closest FROM u, m GROUP BY 1, 2")
def rank_signal(spark, sf):
    e = fixture(spark, sf, "SELECT event_id, user_id, value FROM T_events")
    ref = e.where("event_id % 2 = 0").select(c("value").alias("score"), F.concat(F.lit("L"), (c("user_id") % 3).cast("string")).alias("level"))
    return B.rank_signal(e.where("event_id % 2 = 1").select(c("event_id").alias("id"), c("value").alias("score")), ref)


_SEEDS = "SELECT conv_id AS qid, turn AS idx, CASE WHEN role = 'assistant' THEN 'P1' ELSE 'P2' END AS level, CAST(length(text) AS DOUBLE) AS rank_score, text FROM T_conversations"


@query("gold_seeds", f"SELECT qid, idx FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_score DESC, idx) AS r FROM ({plain(_SEEDS)}) WHERE level = 'P1') WHERE r <= 2")
def gold_seeds(spark, sf):
    return B.gold_seeds(fixture(spark, sf, _SEEDS), "P1", 2).select("qid", "idx")


# two seeds of each benchmark item, its words by halves, against the lines of documents; words and character triples are sets
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9’''_\\-]+'))"
_SEEDED = f"""p AS (SELECT doc_id * 100000 + i - 1 AS pk, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
pw AS (SELECT *, {_WORDS.format("text")} AS words FROM p), w AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[a-z0-9’''_\\-]+') AS w FROM benchmark),
seed AS (SELECT qid, seed, text, list_distinct(string_split(text, ' ')) AS words FROM (SELECT qid, 0 AS seed, array_to_string(w[1:len(w) // 2], ' ') AS text FROM w UNION ALL SELECT qid, 1, array_to_string(w[len(w) // 2 + 1:], ' ') FROM w) WHERE text <> ''),
met AS (SELECT qid, seed, pk, count(*) AS shared FROM (SELECT qid, seed, unnest(words) AS x FROM seed) JOIN (SELECT pk, unnest(words) AS x FROM pw) USING (x) GROUP BY 1, 2, 3),
pool AS (SELECT m.*, len(s.words) AS n, len(v.words) AS o, s.text AS a, v.text AS b FROM met m JOIN seed s USING (qid, seed) JOIN pw v USING (pk) WHERE m.shared >= ceil(len(s.words) * 0.35::DOUBLE - 1e-9))"""
_TRIPLES = "list_distinct(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) < 3 THEN [{0}] ELSE list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)) END)"
_SCORED = f"""{_SEEDED}, g AS (SELECT *, {_TRIPLES.format("x")} AS ga, {_TRIPLES.format("y")} AS gb FROM (SELECT *, regexp_replace(lower(a), '[^0-9a-z]', '', 'g') AS x, regexp_replace(lower(b), '[^0-9a-z]', '', 'g') AS y FROM pool)),
k AS (SELECT qid, seed, pk, round(shared / sqrt(n * o), 9) AS cosine, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 9) AS char3, round(shared / n, 9) AS contain FROM g)"""
_ALIGNED = f"""{_SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY qid, seed ORDER BY cosine DESC, char3 DESC, contain DESC, pk) AS place, cosine + 0.2 * char3 + 0.1 * contain AS joint, CASE WHEN cosine >= 0.92 AND char3 >= 0.2 THEN 'strict_cos+char3' WHEN cosine >= 0.88 AND char3 >= 0.3 AND contain >= 0.6 THEN 'soft_contain+cos+char3' END AS why FROM k),
seeds AS (SELECT qid, count(DISTINCT seed) AS seeds FROM k GROUP BY 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY joint DESC, pk, seed) AS r FROM x WHERE place = 1 AND why IS NOT NULL) WHERE r = 1),
v AS (SELECT qid, pk, count(DISTINCT seed) AS votes, count(*) FILTER (WHERE place = 1) AS firsts, avg(joint) AS mean, arg_max(cosine, joint) AS c, arg_max(contain, joint) AS t FROM x WHERE place <= 5 GROUP BY 1, 2),
one AS (SELECT v.* FROM v JOIN seeds USING (qid) WHERE seeds >= 2 AND firsts = seeds AND (c >= 0.78 OR t >= 0.35)),
many AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mean DESC, pk) AS r FROM v WHERE votes >= 2) WHERE r = 1 AND (c >= 0.78 OR t >= 0.35)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY joint DESC, pk, seed) AS r FROM x WHERE place = 1) WHERE r = 1)
SELECT qid, pk, 'A_threshold' AS stage, why AS reason FROM a UNION ALL SELECT qid, pk, 'B_consensus', 'top1' FROM one WHERE qid NOT IN (SELECT qid FROM a)
UNION ALL SELECT qid, pk, 'B_consensus', 'topk' FROM many WHERE qid NOT IN (SELECT qid FROM a UNION SELECT qid FROM one)
UNION ALL SELECT qid, pk, 'C_fallback', 'best_score' FROM f WHERE qid NOT IN (SELECT qid FROM a UNION SELECT qid FROM one UNION SELECT qid FROM many)"""


def passages(spark, sf):
    """Lines of documents: pk, text."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return d.select((c("doc_id") * 100000 + c("i")).alias("pk"), "text")


def seeds(spark, sf):
    """qid, seed, text: the words of each benchmark item, by halves."""
    w = table(spark, sf, "benchmark").select(c("item_id").alias("qid"), T.tokens_en(c("text"), None).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    both = F.posexplode(F.array(F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w")))).alias("seed", "w")
    return w.select("qid", both).select("qid", "seed", F.array_join("w", " ").alias("text")).where("text <> ''")


def seed_candidates(spark, sf):
    """Of each seed the lines with at least 0.35 of its words: whatever passes a later threshold is among them. cosine is that of word sets."""
    return B.seed_scores(seeds(spark, sf), passages(spark, sf))


@query("seed_candidates", f"WITH {_SCORED} SELECT qid, seed, pk, round(cosine, 6) AS cosine, round(char3, 6) AS char3, round(contain, 6) AS contain FROM k")
def seed_candidates_query(spark, sf):
    return seed_candidates(spark, sf).select("qid", "seed", "pk", *[F.round(x, 6).alias(x) for x in ("cosine", "char3", "contain")])


@query("align_seeds", f"WITH {_ALIGNED}")
def align_seeds(spark, sf):
    return B.align_seeds(seed_candidates(spark, sf))


@query("sort_consensus", f"WITH {_SCORED} SELECT qid, seed, pk, row_number() OVER (PARTITION BY qid, seed ORDER BY cosine DESC, char3 DESC, contain DESC, pk) AS place FROM k")
def sort_consensus(spark, sf):
    """Candidates of each seed in order of all three scores."""
    w = Window.partitionBy("qid", "seed").orderBy(F.desc("cosine"), F.desc("char3"), F.desc("contain"), "pk")
    return seed_candidates(spark, sf).select("qid", "seed", "pk", F.row_number().over(w).alias("place"))


@query("oracle_queries", "SELECT doc_id, trim('which?' || ' ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END) AS by_answer, trim(left(text, 200)) AS by_context FROM documents")
def oracle_queries(spark, sf):
    o = F.create_map(F.lit("A"), F.when(c("doc_id") % 2 == 0, c("lang")).otherwise(""))
    a, b = B.oracle_queries(F.lit("which?"), o, F.lit("A"), c("source"), c("text"))
    return fixture(spark, sf, "SELECT doc_id, lang, source, text FROM T_documents").select("doc_id", a.alias("by_answer"), b.alias("by_context"))


@query("make_queries", "SELECT item_id, 'eb_' || item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'A' ELSE 'A,B' END AS letters, CASE WHEN item_id % 2 = 0 THEN 'hint ' || item_id ELSE '' END AS hint FROM benchmark")
def make_queries(spark, sf):
    """Benchmark rows as agent queries: missing options removed (six spellings), the cached hint joined."""
    b = fixture(spark, sf, "SELECT item_id, text FROM T_benchmark")
    hints = b.where("item_id % 2 = 0").select("item_id", F.concat(F.lit("hint "), c("item_id").cast("string")).alias("hint"))
    o = F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.when(c("item_id") % 3 == 0, " - ").otherwise("y"), F.lit("C"), F.lit("NaN"))
    x = b.join(hints, "item_id", "left")
    return x.select("item_id", F.concat(F.lit("eb_"), c("item_id").cast("string")).alias("qid"), F.array_join(F.map_keys(R.real_options(o, R.NULL_OPTIONS_HARNESS)), ",").alias("letters"), F.coalesce("hint", F.lit("")).alias("hint"))


@query("load_result_arms", "SELECT doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN 'late' ELSE 'early' END AS arm FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def load_result_arms(spark, sf):
    """Result files laid over each other by key, the later one winning; only listed keys."""
    from ..sources import io

    d = fixture(spark, sf, "SELECT doc_id AS qid FROM T_documents")
    arms = io.last_record_wins([d.withColumn("arm", F.lit("early")), d.where("qid % 3 = 0").withColumn("arm", F.lit("late"))], "qid")
    return arms.join(fixture(spark, sf, "SELECT doc_id AS qid FROM T_labels"), "qid", "left_semi")


_MD = "SELECT doc_id, '# Pack' || chr(10) || chr(10) || '## Case 1' || chr(10) || '- sample_id: s' || doc_id || chr(10) || '- text: t' || chr(10) || '- annotation_template:' || chr(10) || '```json' || chr(10) || '{\"notes\": \"' || CASE WHEN doc_id % 2 = 0 THEN 'like L3 and R2' ELSE 'none' END || '\"}' || chr(10) || '```' || chr(10) AS md FROM T_documents"


@query("annotation_sync", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'L3' END AS level, CASE WHEN d.doc_id % 2 = 0 THEN 'R2' END AS route FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def annotation_sync(spark, sf):
    """Annotations read from review packs, levels and routes filled from the notes, joined to the samples that are known."""
    m = fixture(spark, sf, _MD).select("doc_id", F.explode(B.annotations_of(c("md"))).alias("a"))
    level, route = B.filled_from_notes(F.get_json_object("a.annotation", "$.density_level"), F.get_json_object("a.annotation", "$.routing"), F.get_json_object("a.annotation", "$.notes"))
    known = fixture(spark, sf, "SELECT DISTINCT 's' || doc_id AS sid FROM T_labels")
    return m.join(known, c("a.sample_id") == c("sid")).select("doc_id", level.alias("level"), route.alias("route"))


@query("audit_packs", "SELECT doc_id // 50 AS pack, md5('# Review' || chr(10) || chr(10) || string_agg('## Case ' || k || chr(10) || '- sample_id: ' || doc_id || chr(10) || '- text: ' || lang || chr(10), chr(10) ORDER BY k)) AS body FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents) GROUP BY 1")
def audit_packs(spark, sf):
    rows = fixture(spark, sf, "SELECT doc_id AS id, lang AS text FROM T_documents").withColumn("pack", F.floor(c("id") / 50))
    return B.review_pack(rows, "Review", 50).select("pack", F.md5("body").alias("body"))


@query("project_keys", "SELECT lang, count(*) AS n, count(source) AS with_source FROM documents GROUP BY 1")
def project_keys(spark, sf):
    """Fixed columns kept, with their distribution."""
    kept = fixture(spark, sf, "SELECT * FROM T_documents").select("doc_id", "lang", "source")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("source").alias("with_source"))


@query("class_infer_report", "SELECT CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'c0' WHEN embedding[2] >= embedding[3] THEN 'c1' ELSE 'c2' END AS label, count(*) AS n FROM embeddings GROUP BY 1")
def class_infer_report(spark, sf):
    """Three of the embedding's values stand for a classifier's logits: the label of the highest probability, counted."""
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    e = fixture(spark, sf, "SELECT vec_id, embedding FROM T_embeddings").select("vec_id", R.softmax(v).alias("p"))
    best = F.array_position("p", F.array_max("p")) - 1
    return e.select(F.concat(F.lit("c"), best.cast("string")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("run_eval_loop", "SELECT count(*) AS n, count(*) FILTER (WHERE p = 'A') AS parsed_a, count(*) FILTER (WHERE p = CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END) AS correct FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS p FROM documents)")
def run_eval_loop(spark, sf):
    """Replies parsed, compared with the answer and totalled."""
    m = (c("doc_id") % 4).cast("int")
    reply = F.when(m == 3, "no idea").otherwise(F.concat(F.lit("so\nAnswer: "), F.char(F.lit(65) + m)))
    d = fixture(spark, sf, "SELECT doc_id FROM T_documents").select("doc_id", T.last_line_answer(reply).alias("p"), F.when(c("doc_id") % 2 == 0, "A").otherwise("B").alias("gold"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p") == "A").alias("parsed_a"), F.count_if(c("p") == c("gold")).alias("correct"))


@query("eval_accuracy_csv", "SELECT 'run' || (event_id % 3) AS run, count(*) FILTER (WHERE value > 10) AS correct, count(*) AS total, round(avg((value > 10)::INT), 6) AS accuracy FROM events GROUP BY 1")
def eval_accuracy_csv(spark, sf):
    """Correct, total and accuracy of each run, from a CSV of results."""
    from ..sources import io

    path = io.scratch(spark, "results")
    fixture(spark, sf, "SELECT 'run' || (event_id % 3) AS run, event_id, value > 10 AS correct FROM T_events").write.option("header", "true").csv(path)
    r = spark.read.option("header", "true").schema("run string, event_id long, correct boolean").csv(path)
    return r.groupBy("run").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg(c("correct").cast("int")), 6).alias("accuracy"))


@query("win_first_per_key", f"WITH {QS.RUNS} SELECT qid, docid // 4 AS sample, arg_max(docid, (round(score, 9), -docid)) AS docid FROM a GROUP BY 1, 2")
def win_first_per_key(spark, sf):
    from ..operators import curate as K  # noqa: F401

    w = Window.partitionBy("qid", "sample").orderBy(F.desc(F.round("score", 9)), "docid")
    x = QS.run(spark, sf).withColumn("sample", F.floor(c("docid") / 4))
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("qid", "sample", "docid")


@query("dedup_candidates", f"WITH {QS.RUNS} SELECT qid, docid, min(side) AS side FROM (SELECT qid, docid, 'a' AS side FROM a WHERE rank <= 10 UNION ALL SELECT qid, docid, 'b' FROM b WHERE rank <= 10) GROUP BY 1, 2")
def dedup_candidates(spark, sf):
    """Candidates of two query variants, the first variant's kept."""
    a, b = QS.run(spark, sf, 10), QS.run(spark, sf, 10, part=16)
    return a.select("qid", "docid", F.lit("a").alias("side")).unionByName(b.select("qid", "docid", F.lit("b").alias("side"))).groupBy("qid", "docid").agg(F.min("side").alias("side"))


@query("shard_round_robin", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def shard_round_robin(spark, sf):
    from ..operators.running import running_total

    d = running_total(fixture(spark, sf, "SELECT doc_id, 1 AS one FROM T_documents"), "doc_id", "one", "r")
    return d.select("doc_id", ((c("r") - 1) % 4).alias("shard"))


@query("limit_global_counter", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE n_chars > 200) WHERE r <= 100 AND doc_id % 3 = 1")
def limit_global_counter(spark, sf):
    """The first 100 valid rows of the whole input, then this shard's share of them."""
    d = fixture(spark, sf, "SELECT doc_id FROM T_documents WHERE n_chars > 200").orderBy("doc_id").limit(100)
    return d.where("doc_id % 3 = 1")


_GS = "SELECT doc_id AS id, CASE WHEN n_chars < 60 THEN 'short' ELSE 'g' || (doc_id % 97) END AS grp, lang AS label FROM T_documents"


@query("split_group_stratified", f"WITH r AS ({plain(_GS)}), g AS (SELECT grp, count(*) AS n, arg_min(label, id) AS label, sha1('s:' || grp) AS h FROM r GROUP BY 1), s AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY h, grp) - n AS before, sum(n) OVER (PARTITION BY label) AS total FROM g) SELECT id, CASE WHEN before < round_even(total * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM r JOIN s USING (grp)")
def split_group_stratified(spark, sf):
    rows = fixture(spark, sf, _GS).withColumnRenamed("grp", "group")
    return B.group_split(rows, 0.1, "s").select("id", "split")


_KIND = "SELECT doc_id AS id, source AS kind, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'dev' END AS split FROM T_documents"


@query("sample_stratified", f"WITH i AS ({plain(_KIND)}), x AS (SELECT id, kind, sha1('z:' || id) AS h, row_number() OVER (PARTITION BY kind ORDER BY sha1('z:' || id), id) AS r FROM i) SELECT id, kind FROM (SELECT *, row_number() OVER (ORDER BY (r > greatest(1, 90 // (SELECT count(DISTINCT kind) FROM i)))::INT, h, id) AS p FROM x) WHERE p <= 90")
def sample_stratified(spark, sf):
    return B.stratified(fixture(spark, sf, _KIND).select("id", "kind"), 90, "z")


@query("sample_balanced_split", f"WITH i AS ({plain(_KIND)}), k AS (SELECT split, kind, row_number() OVER (PARTITION BY split ORDER BY kind) - 1 AS k, count(*) OVER (PARTITION BY split) AS n FROM (SELECT DISTINCT split, kind FROM i)), x AS (SELECT i.*, CASE split WHEN 'train' THEN 50 ELSE 17 END AS want, sha1('b:' || id) AS h, k, n FROM i JOIN k USING (split, kind)), y AS (SELECT *, row_number() OVER (PARTITION BY split, kind ORDER BY h, id) <= want // n + (k < want % n)::INT AS inside FROM x) SELECT id, split, kind FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY inside DESC, h, id) AS p FROM y) WHERE p <= want")
def sample_balanced_split(spark, sf):
    return B.balanced(fixture(spark, sf, _KIND), {"train": 50, "dev": 17}, "b")


@query("sample_task_quota")
def sample_task_quota(spark, sf):
    src = fixture(spark, sf, "SELECT doc_id AS source FROM T_documents")
    return B.task_quota(src, {"site": 20, "lesion": 15, "step": 10, "region": 5}, "t", 45)


@query("join_parent_meta", "SELECT p.page_id, p.page_id % 40 AS parent, d.lang, d.source FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id % 40")
def join_parent_meta(spark, sf):
    """Image rows with their parent sample's fields; an unknown parent keeps its row."""
    p = fixture(spark, sf, "SELECT page_id, page_id % 40 AS parent FROM T_pages")
    return p.join(fixture(spark, sf, "SELECT doc_id AS parent, lang, source FROM T_documents"), "parent", "left")


@query("join_block_mapping", "SELECT e.event_id, m.sample FROM events e LEFT JOIN (SELECT user_id, event_type, min(event_id) AS sample FROM events GROUP BY 1, 2) m ON m.user_id = e.user_id AND m.event_type = e.event_type")
def join_block_mapping(spark, sf):
    """Looked up on two keys; of several mappings the first stays."""
    e = fixture(spark, sf, "SELECT event_id, user_id, event_type FROM T_events")
    m = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("sample"))
    return e.join(m, ["user_id", "event_type"], "left").select("event_id", "sample")


@query("join_sample_mapping", "SELECT l.doc_id, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def join_sample_mapping(spark, sf):
    return fixture(spark, sf, "SELECT doc_id FROM T_labels").join(fixture(spark, sf, "SELECT doc_id, source FROM T_documents"), "doc_id", "left")


@query("join_bundle", f"WITH {QS.RUNS} SELECT x.qid, n_text, n_image FROM (SELECT qid, count(*) AS n_text FROM a WHERE rank <= 7 GROUP BY 1) x JOIN (SELECT qid, count(*) AS n_image FROM b WHERE rank <= 3 GROUP BY 1) y ON x.qid = y.qid")
def join_bundle(spark, sf):
    """Text and image candidates of one query bundled by its index."""
    a = QS.run(spark, sf, 7).groupBy("qid").agg(F.count(F.lit(1)).alias("n_text"))
    return a.join(QS.run(spark, sf, 3, part=16).groupBy("qid").agg(F.count(F.lit(1)).alias("n_image")), "qid")


@query("join_unified_strict", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_unified_strict(spark, sf):
    """Every line must have its order: a miss is an error, not a null."""
    li = fixture(spark, sf, "SELECT l_orderkey, l_linenumber FROM T_lineitem")
    return B.strict_join(li, fixture(spark, sf, "SELECT o_orderkey AS l_orderkey, o_orderpriority FROM T_orders"), "l_orderkey")


@query("join_tier_candidates", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'trivial' WHEN 1 THEN 'rewrite' ELSE 'bad' END AS tier FROM conversations")
def join_tier_candidates(spark, sf):
    """Observations and tiers aligned by key, not by position."""
    o = fixture(spark, sf, "SELECT conv_id, turn FROM T_conversations")
    t = fixture(spark, sf, "SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'trivial' WHEN 1 THEN 'rewrite' ELSE 'bad' END AS tier FROM T_conversations")
    return o.join(t, "conv_id")
