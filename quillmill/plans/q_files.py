"""Queries that write files and read them back: JSON of all shapes, runs, judgements, caches, packed and sharded text, paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vector_index as V
from ..sources import io, relational
from ..sources.sink import insert_rows
from . import q_search as QS
from .base import query, table

_REC = "doc_id long, lang string, n_chars long"


def _write_text(df, path):
    df.select("value").write.text(path)
    return path


def _json_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value"))


@query("scan_json_any", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0 ORDER BY doc_id")
def scan_json_any(spark, sf):
    """documents written as .jsonl lines, as lists and as objects of .json files, with broken lines among them."""
    d = _json_lines(spark, sf)
    path = io.scratch(spark, "any")
    _write_text(d.select(F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(F.col("value")).alias("value")).where("true"), path + "/raw")
    lines = spark.read.text(path + "/raw")
    keep = lines.withColumn("h", F.pmod(F.xxhash64("value"), F.lit(3)))
    # Spark names its text files .txt: each shape is written under the name that the reader looks for
    _named(keep.where("h = 0").select("value"), path + "/in/a", "jsonl")
    # a list is a file of its own, however many the writer's tasks have
    _named(keep.where("h = 1").groupBy(F.spark_partition_id()).agg(F.concat(F.lit("["), F.array_join(F.filter(F.collect_list("value"), lambda v: ~F.startswith(v, F.lit("{b"))), ",\n"), F.lit("]")).alias("value")).select("value"), path + "/in/b", "json", 1)
    _named(keep.where("h = 2").select("value"), path + "/in/deep/c", "json")
    return io.read_json_any(spark, path + "/in", _REC)


def _named(df, path, suffix, most=0):
    """Write text files with a suffix of their own, of at most so many rows (0: any)."""
    df.write.option("fileExtension", suffix).option("maxRecordsPerFile", most).text(path)
    fs_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(fs_path(path)):
        old = f.getPath()
        if old.getName().endswith(".txt"):
            fs.rename(old, fs_path(old.getParent(), old.getName()[:-4] + "." + suffix))


@query("scan_jsonl_strict", "SELECT doc_id, lang, n_chars FROM documents")
def scan_jsonl_strict(spark, sf):
    return io.read_json(spark, _write_text(_json_lines(spark, sf), io.scratch(spark, "strict")), _REC, bad="raise")


@query("scan_jsonl_lineno", "SELECT doc_id, doc_id AS line FROM documents")
def scan_jsonl_lineno(spark, sf):
    """Lines with their number; documents have ids from 0 on, written in their order to one file."""
    path = io.scratch(spark, "lines")
    _json_lines(spark, sf).coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    n = io.numbered_lines(spark, path)
    return n.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "line")


@query("scan_recursive", "SELECT doc_id, lang, n_chars FROM documents")
def scan_recursive(spark, sf):
    path = io.scratch(spark, "tree")
    _json_lines(spark, sf).withColumn("part", F.pmod("doc_id", F.lit(4))).select("value", "part").write.partitionBy("part").text(path)
    return io.read_json(spark, path, _REC, bad="count", recursive=False).where("_corrupt_record is null").select("doc_id", "lang", "n_chars")


@query("scan_find_jsonl", "SELECT doc_id, lang, n_chars FROM documents")
def scan_find_jsonl(spark, sf):
    path = io.scratch(spark, "find")
    _named(_json_lines(spark, sf).select("value"), path + "/x/y", "jsonl")
    return io.read_json_any(spark, path, _REC)


@query("sink_jsonl", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(n_chars) AS chars FROM documents")
def sink_jsonl(spark, sf):
    path = io.scratch(spark, "shards")
    written = io.write_shards(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, 500)
    back = io.read_json(spark, path, _REC)
    return written.agg(F.sum("n").alias("n")).crossJoin(back.agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("chars")))


@query("sink_trec", f"WITH {QS.RUNS} SELECT qid || ' Q0 ' || docid || ' ' || rank || ' ' || printf('%.6f', score) || ' base' AS value FROM a")
def sink_trec(spark, sf):
    return spark.read.text(_write_text(io.run_lines(QS.run(spark, sf), "base"), io.scratch(spark, "run")))


@query("scan_trec_run", f"WITH {QS.RUNS} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank::INT AS rank, printf('%.6f', score)::DOUBLE AS score, 'base' AS tag FROM a")
def scan_trec_run(spark, sf):
    return io.parse_run(spark.read.text(_write_text(io.run_lines(QS.run(spark, sf), "base"), io.scratch(spark, "run"))))


@query("scan_run_eligible", f"WITH {QS.RUNS} SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank::INT AS rank FROM a WHERE rank <= 20 AND qid IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def scan_run_eligible(spark, sf):
    """A run file restricted to queries of even label and to its first 20 ranks."""
    run = io.parse_run(spark.read.text(_write_text(io.run_lines(QS.run(spark, sf), "base"), io.scratch(spark, "run"))))
    ok = table(spark, sf, "embeddings").where("label % 2 = 0").select(F.col("vec_id").cast("string").alias("qid"))
    return run.where("rank <= 20").join(ok, "qid", "left_semi").select("qid", "docid", "rank")


@query("scan_qrels", "SELECT doc_id::VARCHAR AS qid, 'd' || doc_id AS docid, CASE doc_id % 3 WHEN 0 THEN 1 ELSE quality END AS rel FROM labels")
def scan_qrels(spark, sf):
    q, d, r = F.col("doc_id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("quality").cast("string")
    m = F.col("doc_id") % 3
    lines = table(spark, sf, "labels").select(F.when(m == 0, F.concat_ws(" ", q, d)).when(m == 1, F.concat_ws("\t", q, d, r)).otherwise(F.concat_ws(" ", q, F.lit("0"), d, r)).alias("value"))
    return io.parse_qrels(spark.read.text(_write_text(lines, io.scratch(spark, "qrels"))))


@query("scan_sev_cache", "SELECT doc_id::VARCHAR AS qid, 'd' || doc_id AS docid, quality::DOUBLE AS cls_prob, CASE WHEN doc_id % 2 = 0 THEN toxic::DOUBLE ELSE 0.0 END AS score_prob FROM labels")
def scan_sev_cache(spark, sf):
    nested = F.format_string('{"qid": "%d", "results": [{"pk": "d%d", "cls_prob": %d.0, "score": %d.0}]}', "doc_id", "doc_id", "quality", "toxic")
    flat = F.format_string('{"query_id": "%d", "docid": "d%d", "cls_prob": %d.0}', "doc_id", "doc_id", "quality")
    lines = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 2 == 0, nested).otherwise(flat).alias("value"))
    return io.parse_cache(spark.read.text(_write_text(lines, io.scratch(spark, "cache"))))


@query("scan_offset_page", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page FROM orders")
def scan_offset_page(spark, sf):
    return io.keyset_pages(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500).select("o_orderkey", "page")


@query("scan_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT max(k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 300)) ORDER BY o_orderkey LIMIT 200")
def scan_keyset_page(spark, sf):
    """The page after the first 300 keys."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    last = io.read_page(o, "o_orderkey", None, 300).agg(F.max("o_orderkey")).first()[0]
    return io.read_page(o, "o_orderkey", last, 200)


@query("scan_pk_range_bisect")
def scan_pk_range_bisect(spark, sf):
    return io.bisect_ranges(table(spark, sf, "orders"), "o_orderkey", 1000)


@query("scan_image_b64", "SELECT doc_id, octet_length(encode(left(text, 3000))) AS n_bytes, sha256(left(text, 3000)) AS sha FROM documents")
def scan_image_b64(spark, sf):
    """The first 3000 characters of a text stand for an image's bytes."""
    raw = F.substring("text", 1, 3000).cast("binary")
    b64 = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(raw))).otherwise(F.base64(raw))
    d = table(spark, sf, "documents").select("doc_id", io.decode_image(F.regexp_replace(b64, r"\s", "")).alias("b"))
    return d.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.sha2("b", 256).alias("sha"))


@query("scan_content_list", "SELECT source AS folder, count(*) AS n_items, sum(n_chars) AS chars FROM documents GROUP BY 1")
def scan_content_list(spark, sf):
    """Each source's parse output is a folder with a content list; found by name at any depth and loaded."""
    path = io.scratch(spark, "parsed")
    table(spark, sf, "documents").select("source", F.to_json(F.struct("doc_id", "n_chars")).alias("value")).write.partitionBy("source").text(path)
    items = spark.read.text(path).select("source", F.from_json("value", "doc_id long, n_chars long").alias("j"))
    return items.groupBy(F.col("source").cast("string").alias("folder")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("j.n_chars").alias("chars"))


@query("scan_text_store", "SELECT 'src__' || source AS doc, count(*) AS n_blocks FROM documents GROUP BY 1")
def scan_text_store(spark, sf):
    """Per-document parse folders; the document's id comes from the path."""
    path = io.scratch(spark, "store")
    table(spark, sf, "documents").select(F.concat(F.lit("src__"), F.col("source")).alias("doc"), F.to_json(F.struct("doc_id")).alias("value")).write.partitionBy("doc").text(path)
    files = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("f"))
    return files.groupBy(F.regexp_extract("f", "doc=([^/]+)/", 1).alias("doc")).agg(F.count(F.lit(1)).alias("n_blocks"))


@query("partition_by_lang", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def partition_by_lang(spark, sf):
    """Rows routed to one folder for each language; a language's summary reads its folder alone."""
    path = io.scratch(spark, "by-lang")
    table(spark, sf, "documents").select("doc_id", "n_chars", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("group_files_by_doc", "SELECT doc_id, source || '_p' || (doc_id // 20) || '_' || (row_number() OVER (PARTITION BY source, doc_id // 20 ORDER BY doc_id) - 1) AS block_id FROM documents")
def group_files_by_doc(spark, sf):
    """One folder for each source with its blocks, read back."""
    page = F.floor(F.col("doc_id") / 20)
    w = Window.partitionBy("source", page).orderBy("doc_id")
    b = table(spark, sf, "documents").select("doc_id", "source", F.concat(F.col("source"), F.lit("_p"), page.cast("string"), F.lit("_"), (F.row_number().over(w) - 1).cast("string")).alias("block_id"))
    path = io.scratch(spark, "grouped")
    b.repartition("source").write.partitionBy("source").json(path)
    return spark.read.schema("doc_id long, block_id string, source string").json(path).select("doc_id", "block_id")


@query("insert_bisect", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'missing_text' WHEN n_chars > 8192 THEN 'text_too_long' ELSE 'inserted' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def insert_bisect(spark, sf):
    """A store with constraints refuses whole batches; each is halved until the rows at fault are found, and all others are inserted."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    path, columns = io.scratch(spark, "inserted"), '"doc_id" INTEGER, "text" TEXT NOT NULL, "n_chars" INTEGER CHECK (n_chars <= 8192)'
    _, _, rejected = insert_rows(d, lambda partition, attempt: relational.relational_sink(path, "rows", columns, "doc_id", partition, attempt))
    there = relational.read_relational(spark, path, "rows", "doc_id", "doc_id long").select(F.lit("inserted").alias("outcome"))
    why = F.when(F.startswith("error", F.lit("NOT NULL")), "missing_text").otherwise("text_too_long")
    return there.unionByName(rejected.select(why.alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("batch_ingest", "SELECT CASE WHEN n_chars > 8192 THEN 'rejected' ELSE lang END AS part, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def batch_ingest(spark, sf):
    """Files of lines to prepared rows, routed by language; rejects to a log of their own."""
    raw = _write_text(_json_lines(spark, sf), io.scratch(spark, "ingest"))
    rows = io.read_json(spark, raw, _REC)
    good, bad = io.split_valid(rows, F.col("n_chars") <= 8192, F.lit("rejected"))
    path, log = io.scratch(spark, "table"), io.scratch(spark, "rejects")
    good.write.partitionBy("lang").parquet(path)
    bad.write.json(log)
    done = spark.read.parquet(path).select(F.col("lang").cast("string").alias("part"), "doc_id")
    back = spark.read.schema("doc_id long, reason string").json(log).select(F.col("reason").alias("part"), "doc_id")
    return done.unionByName(back).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("checkpoint_log", "SELECT doc_id // 100 AS batch, count(*) AS done, max(doc_id) AS last FROM documents GROUP BY 1")
def checkpoint_log(spark, sf):
    """A line for each batch that was written, appended to a log; the log says where to go on."""
    path = io.scratch(spark, "log")
    d = table(spark, sf, "documents")
    for half in ("doc_id % 200 < 100", "doc_id % 200 >= 100"):
        d.where(half).groupBy(F.floor(F.col("doc_id") / 100).alias("batch")).agg(F.count(F.lit(1)).alias("done"), F.max("doc_id").alias("last")).write.mode("append").json(path)
    return spark.read.schema("batch long, done long, last long").json(path)


@query("pack_split_merge", "SELECT source AS file, count(*) AS n, sum(n_chars) AS chars, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM documents GROUP BY 1")
def pack_split_merge(spark, sf):
    """Each source's lines packed into parts of at most 20 kB with a manifest, and merged again without loss."""
    lines = table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line"), F.to_json(F.struct("doc_id", "n_chars")).alias("value"))
    path = io.scratch(spark, "packed")
    manifest = io.write_packed(lines, path, 20_000)
    merged = io.merge_packed(spark, path).select("file", F.from_json("value", "doc_id long, n_chars long").alias("j"))
    whole = merged.groupBy("file").agg(F.sum("j.n_chars").alias("chars"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("j.doc_id")), lambda x: x.cast("string")), ",")).alias("ids"))
    return manifest.groupBy("file").agg(F.sum("n").alias("n")).join(whole, "file")


@query("merge_shards", "SELECT doc_id, max(doc_id % 7 + 10 * s) AS score FROM documents, (VALUES (0), (1), (2)) t(s) WHERE s = 0 OR doc_id % (s + 1) = 0 GROUP BY 1")
def merge_shards(spark, sf):
    """Three shard files; of records with one index that of the last shard stays."""
    path = io.scratch(spark, "shards")
    d = table(spark, sf, "documents")
    shards = []
    for k in range(3):
        own = d if k == 0 else d.where(F.col("doc_id") % (k + 1) == 0)
        own.select("doc_id", (F.col("doc_id") % 7 + 10 * k).alias("score")).write.json(f"{path}/{k}")
        shards.append(spark.read.schema("doc_id long, score long").json(f"{path}/{k}"))
    return io.last_record_wins(shards, "doc_id")


@query("resume_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_done(spark, sf):
    """What is left to do after the records of an output file."""
    path = io.scratch(spark, "out")
    table(spark, sf, "labels").where("quality = 1").select("doc_id").write.json(path)
    return table(spark, sf, "documents").select("doc_id").join(spark.read.schema("doc_id long").json(path), "doc_id", "left_anti")


@query("collection_create", "SELECT count(*) AS n, 64 AS dim FROM embeddings")
def collection_create(spark, sf):
    """An index is made, found again and checked: another width is refused."""
    path = io.scratch(spark, "collection")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("docid"), F.col("embedding").alias("vec"))
    V.ensure(e, path, 64)
    found = V.ensure(e, path, 64)
    try:
        V.ensure(e, path, 32)
    except ValueError:
        return found.rows(spark).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    raise AssertionError("another width was not refused")


@query("sink_csv_json_latex", f"WITH {QS.METRICS} SELECT 'base' AS run, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall FROM m")
def sink_csv_json_latex(spark, sf):
    """Metrics as CSV, per-query JSON and a LaTeX table; the CSV is read back."""
    from ..operators import evaluate as E

    m = E.ranking_metrics(QS.run(spark, sf), QS.qrels(spark, sf))
    path = io.scratch(spark, "metrics")
    cols = ["run", "ndcg", "mrr", "recall"]
    m.write.json(f"{path}/per_query")
    total = spark.read.schema("qid long, ndcg double, mrr double, recall double").json(f"{path}/per_query").agg(*[F.round(F.avg(c), 4).alias(c) for c in cols[1:]]).select(F.lit("base").alias("run"), *cols[1:])
    total.write.option("header", "true").csv(f"{path}/metrics")
    text = io.metrics_table([r.asDict() for r in total.collect()], cols)
    spark.createDataFrame([(text,)], "value string").write.text(f"{path}/latex")
    return spark.read.option("header", "true").schema("run string, ndcg double, mrr double, recall double").csv(f"{path}/metrics")


@query("scan_yaml_cfg", "SELECT 'min_len' AS key, 5 AS value UNION ALL SELECT 'max_len', 200")
def scan_yaml_cfg(spark, sf):
    path = io.scratch(spark, "config")
    spark.createDataFrame([('{"min_len": 5, "max_len": 200}',)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(sorted(io.read_config(spark, path).items()), "key string, value int")


@query("cached_translate", "SELECT item_id, 'x' || reverse(text) AS out, item_id % 3 = 0 AS cached FROM benchmark")
def cached_translate(spark, sf):
    """Only keys that the cache lacks are translated (here: reversed), and appended to it."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    path = io.scratch(spark, "cache")
    translate = lambda d: d.select("item_id", F.concat(F.lit("x"), F.reverse("text")).alias("out"))
    translate(b.where("item_id % 3 = 0")).withColumn("cached", F.lit(True)).write.parquet(path)
    known = spark.read.parquet(path)
    translate(b.join(known, "item_id", "left_anti")).withColumn("cached", F.lit(False)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
