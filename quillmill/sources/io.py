"""Reading and writing: JSON in several shapes, TREC runs, judgements, score caches, sharded text with a manifest."""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dataset import greedy_parts
from ..operators.running import running_total

SCHEMES = ("drop", "raise", "count")


def read_json(spark: SparkSession, path: str, schema: str, bad: str = "drop", recursive: bool = False) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped.

    bad: drop skips lines that do not parse, raise fails the read, count keeps them with their text in _corrupt_record.
    """
    if bad not in SCHEMES:
        raise ValueError(f"bad must be one of {SCHEMES}")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if recursive:
        reader = reader.option("pathGlobFilter", "*.json*")
    mode = {"mode": "FAILFAST" if bad == "raise" else "PERMISSIVE"}
    full = schema if bad == "raise" else f"{schema}, _corrupt_record string"
    rows = reader.text(path).where(F.trim("value") != "").select(F.from_json("value", full, mode).alias("j")).select("j.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record") if bad == "drop" else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: lines with their number from 0 in each file.

    Lines are counted in each split of a file; the splits before give a split's offset. Both passes read the same splits, and
    no task holds more than its own.
    """
    where = "file string, at long, line long, value string"
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    inside = raw.mapInArrow(_numbered, where)
    lines = inside.groupBy("file", "at").agg((F.max("line") + 1).alias("n"))
    before = lines.select("file", "at", (F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")).alias("before"))
    return inside.join(before, ["file", "at"]).select("file", (F.col("line") + F.col("before")).alias("line"), "value")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, which reads split after split, with their number in their split."""
    now, n = None, 0
    for b in batches:
        out = []
        for split in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = n + 1 if split == now else 0
            now = split
            out.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64()), b.column(2)], ["file", "at", "line", "value"])


def parse_run(lines: DataFrame) -> DataFrame:
    """qid, docid, rank, score, tag of TREC run lines (column value); lines of under six fields go."""
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 6)
    return p.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("docid"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag"))


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """TREC lines of qid, docid, rank, score."""
    return run.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docid").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag)).alias("value"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """qid, docid, rel of judgements in two (rel 1), three or four fields."""
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    n = F.size("p")
    return p.select(F.col("p")[0].alias("qid"), F.when(n >= 4, F.get("p", F.lit(2))).otherwise(F.col("p")[1]).alias("docid"), F.when(n >= 4, F.get("p", F.lit(3))).when(n == 3, F.get("p", F.lit(2))).otherwise("1").cast("int").alias("rel"))


def parse_cache(lines: DataFrame) -> DataFrame:
    """qid, docid, cls_prob, score_prob of score caches: one line a query with results, or one a pair."""
    item = "pk string, doc string, docid string, id string, cls_prob double, score_prob double, score double"
    x = lines.select(F.from_json("value", f"qid string, query_id string, q_id string, id string, results array<struct<{item.replace(' string', ': string').replace(' double', ': double')}>>, pk string, doc string, docid string, cls_prob double, score_prob double, score double").alias("j"))
    own = F.array(F.struct(*[F.col(f"j.{c}").alias(c) for c in ("pk", "doc", "docid")], F.lit(None).cast("string").alias("id"), *[F.col(f"j.{c}").alias(c) for c in ("cls_prob", "score_prob", "score")]))
    rows = x.select(F.coalesce("j.qid", "j.query_id", "j.q_id", "j.id").alias("qid"), F.explode(F.coalesce("j.results", own)).alias("r"))
    zero = F.lit(0.0)
    return rows.select("qid", F.coalesce("r.pk", "r.doc", "r.docid", "r.id").alias("docid"), F.coalesce("r.cls_prob", zero).alias("cls_prob"), F.coalesce("r.score_prob", "r.score", zero).alias("score_prob")).where("qid is not null and docid is not null")


def language_of(sample: Column) -> Column:
    """ja, ko, zh or en of a text sample, by its share of kana, hangul and CJK."""
    n = F.greatest(F.length(sample), F.lit(1))
    share = lambda cls: F.regexp_count(sample, F.lit(cls)) / n
    return F.when(share(r"[぀-ヿ]") > 0.05, "ja").when(share(r"[가-힯]") > 0.05, "ko").when(share(r"[一-鿿]") > 0.1, "zh").otherwise("en")


def replay(recorded: DataFrame, queries: DataFrame) -> DataFrame:
    """Recorded results of each query text, matched after normalising; the first recording (by pos) wins."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    w = Window.partitionBy("_k").orderBy("pos")
    first = recorded.withColumn("_k", key(F.col("query"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_k", "results")
    return queries.withColumn("_k", key(F.col("query"))).join(first, "_k", "left").drop("_k")


def write_shards(rows: DataFrame, path: str, per_file: int) -> DataFrame:
    """Write JSON lines, at most per_file a file; file, n, sha256 of what was written (files by name, lines in order)."""
    rows.write.option("maxRecordsPerFile", per_file).json(path)
    spark = rows.sparkSession
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return lines.select("file", F.regexp_count("value", F.lit("\n")).alias("n"), F.sha2("value", 256).alias("sha256"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir), or in a temporary folder on a single machine without one.

    What is written there goes when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/quillmill/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/data"


def written(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written to a fresh path of the shared folder and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all .json and .jsonl files under a folder, or of one file, at any depth.

    A .json file may hold lists, objects, or lines, one after another; it is held whole, so large corpora belong in .jsonl files,
    which are read by line and can be split. Lines and files that do not parse are skipped.
    """
    find = lambda glob, **k: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, **k)
    full = f"{schema}, _corrupt_record string"
    record = lambda x: F.from_json(x, full, {"mode": "PERMISSIVE"})
    # a line that ends a value, before one that begins another: inside a value a comma would stand between them
    values = F.explode(F.split("value", r"(?<=[\]}])\s*\n\s*(?=[\[{])"))
    whole = find("*.json", wholetext=True).select(values.alias("value")).where(F.trim("value") != "")
    rows = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    start = F.substring(F.ltrim("value"), 1, 1)
    items = F.when(start == "[", F.from_json("value", f"array<struct<{_inline(full)}>>"))
    whole = whole.withColumns({"items": items, "one": F.when(start == "{", record(F.col("value")))})
    # any line may be broken, the first too: what is neither a list nor one object is lines
    several = F.try_parse_json(F.get(rows, F.lit(0))).isNotNull() | F.col("one._corrupt_record").isNotNull()
    is_lines = F.when(start == "[", F.col("items").isNull()).when(start == "{", (F.size(rows) > 1) & several).otherwise(True)
    lines = whole.where(is_lines).select(F.explode(rows).alias("value")).unionByName(find("*.jsonl")).where(F.trim("value") != "")
    one = lines.unionByName(whole.where(~is_lines & (start == "{")).select("value"))
    listed = whole.where(~is_lines & (start == "[")).select(F.explode("items").alias("j"))
    both = one.select(record(F.col("value")).alias("j")).unionByName(listed)
    return both.where("j is not null and j._corrupt_record is null").select("j.*").drop("_corrupt_record")


def _inline(schema: str) -> str:
    """A list of columns as fields of a struct type."""
    from pyspark.sql.types import _parse_datatype_string

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in _parse_datatype_string(schema).fields)


def read_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows after a key, in its order; a range filter that reaches the scan."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def keyset_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with their page from 0: pages of `size` rows in order of the key, which has no equals.

    What a loop of page reads gives, without the loop.
    """
    marked = running_total(rows.withColumn("_one", F.lit(1)), key, "_one", "_r")
    return marked.withColumn("page", F.floor((F.col("_r") - 1) / size)).drop("_one", "_r")


def bisect_ranges(rows: DataFrame, key: str, most: int) -> DataFrame:
    """lo, hi, n: key ranges of at most `most` rows, found by halving ranges that are too full, in order of lo.

    A key's ranges at all depths follow from the ends, so a round halves all ranges that are too full many times at once: keys are counted by
    their deepest range, and the counts of the ranges above are sums. Further rounds are for ranges that even then are too full.
    """
    spark = rows.sparkSession
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"))
    lo, hi, fullest = keys.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if lo is None:
        return spark.createDataFrame([], "lo long, hi long, n long")
    out, depth = None, 0
    dealt = keys.withColumns({"lo": F.lit(lo).cast("long"), "hi": F.lit(hi).cast("long")})
    while True:
        steps = max(1, math.ceil(math.log2(fullest / most)) + 1) if most > 0 else 63
        cells = dealt.mapInArrow(_halved(steps), "top_lo long, top_hi long, lo long, hi long, n long")
        cells = cells.groupBy("top_lo", "top_hi", "lo", "hi").agg(F.sum("n").alias("n"))
        nodes = cells.mapInArrow(_ways(steps), "up_lo long, up_hi long, lo long, hi long, last boolean, n long").groupBy("up_lo", "up_hi", "lo", "hi", "last").agg(F.sum("n").alias("n"))
        nodes = written(nodes.withColumn("over", (F.col("n") > most) & (F.col("lo") < F.col("hi"))), "ranges")
        # the ranges that were halved are those too full, as all above them are; a range that is small enough ends its way
        above = nodes.where("over").select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
        ended = nodes.where("NOT over")
        done = ended.join(above, ["up_lo", "up_hi"], "left_semi").unionByName(ended.where("up_lo IS NULL")).select("lo", "hi", "n")
        out = done if out is None else out.unionByName(done)
        deeper = nodes.where("over AND last").select("lo", "hi", "n")
        fullest = deeper.agg(F.max("n")).first()[0]
        if fullest is None:
            return out.orderBy("lo")
        depth += steps
        start = keys.withColumns({"lo": F.lit(lo).cast("long"), "hi": F.lit(hi).cast("long")})
        dealt = start.mapInArrow(_placed(depth), "key long, lo long, hi long").join(deeper.select("lo", "hi"), ["lo", "hi"], "left_semi").select("key", "lo", "hi")


def _half(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half of each range that its key is in; a range of one key stays."""
    mid = (lo & hi) + ((lo ^ hi) >> 1)
    right = key > mid
    return np.where(right, mid + 1, lo), np.where(right, hi, mid)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _placed(steps: int):
    """key, lo, hi: the range of each key after so many halvings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, lo, hi = _columns(b)
            for _ in range(steps):
                lo, hi = _half(key, lo, hi)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lo), pa.array(hi)], ["key", "lo", "hi"])

    return run


def _halved(steps: int):
    """Of each batch of key, lo, hi the ranges after so many halvings, with their number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, top_lo, top_hi = _columns(b)
            lo, hi = top_lo, top_hi
            for _ in range(steps):
                lo, hi = _half(key, lo, hi)
            # ranges of a depth do not overlap, so their lower ends tell them apart
            _, at, n = np.unique(lo, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top_lo[at], top_hi[at], lo[at], hi[at], n.astype(np.int64))], ["top_lo", "top_hi", "lo", "hi", "n"])

    return run


def _ways(steps: int):
    """The ranges on the way to each cell, with the range above (null at the very top), whether they are the cell, and the cell's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, cell, end, n = _columns(b)
            up_lo = up_hi = None
            for _ in range(steps + 1):
                last = (lo == cell) & (hi == end)
                up = [pa.nulls(len(lo), pa.int64()) if x is None else pa.array(x) for x in (up_lo, up_hi)]
                yield pa.RecordBatch.from_arrays([*up, *map(pa.array, (lo, hi, last, n))], ["up_lo", "up_hi", "lo", "hi", "last", "n"])
                up_lo, up_hi, cell, end, n = (x[~last] for x in (lo, hi, cell, end, n))
                lo, hi = _half(cell, up_lo, up_hi)

    return run


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration file; YAML needs its package."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def split_valid(rows: DataFrame, valid: Column, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rejects with their reason): each row is judged by itself, so one bad row costs no batch."""
    judged = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    return judged.where("_ok").drop("_ok"), judged.where("not _ok").drop("_ok").withColumn("reason", reasons)


def write_packed(lines: DataFrame, path: str, most_bytes: int) -> DataFrame:
    """Write lines (file, line, value) in parts of at most most_bytes, cut at line ends; part, n, n_bytes, sha256 of each.

    A part takes lines until the next would not fit: a running sum that begins anew, done for each file by itself, in
    batches. A line longer than a part is a part of its own.
    """

    sized = lines.select("file", "line", "value", (F.octet_length("value") + 1).cast("long").alias("size"))
    placed = greedy_parts(sized, "file", "line", "size", most_bytes).drop("size")
    placed.repartition("file", "part").sortWithinPartitions("file", "part", "line").write.partitionBy("file", "part").parquet(path)
    back = lines.sparkSession.read.parquet(path)
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n"), F.lit("\n"))
    return back.groupBy(F.col("file").cast("string").alias("file"), F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("n_bytes"), F.sha2(body, 256).alias("sha256"))


def merge_packed(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of what write_packed wrote, whole."""
    return spark.read.parquet(path).select(F.col("file").cast("string").alias("file"), "line", "value")


def last_record_wins(shards: list[DataFrame], key: str) -> DataFrame:
    """Rows of all shards; of equal keys that of the last shard."""
    out = None
    for k, d in enumerate(shards):
        d = d.withColumn("_s", F.lit(k))
        out = d if out is None else out.unionByName(d)
    cols = [c for c in out.columns if c not in (key, "_s")]
    best = out.groupBy(key).agg(F.max_by(F.struct(*cols), "_s").alias("r"))
    return best.select(key, "r.*")


def decode_image(encoded: Column) -> Column:
    """Bytes of a base64 text, with or without a data prefix; null if it does not decode."""
    return F.try_to_binary(F.regexp_replace(encoded, r"^data:[^,]*,", ""), F.lit("base64"))


def metrics_table(rows: list[dict], columns: list[str]) -> str:
    """A LaTeX table of a few rows of metrics."""
    put = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = "\n".join(" & ".join(put(r[c]) for c in columns) + r" \\" for r in rows)
    head = " & ".join(c.replace("_", r"\_") for c in columns)
    return f"\\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}\n{head} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n"


def replay_requests(requests: DataFrame, search, valid: Column, reason: Column) -> DataFrame:
    """query_idx, error, hits of every request: a bad request gives an error row, the others their hits; aligned by query_idx."""
    marked = requests.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    good = search(marked.where("_ok").drop("_ok"))
    bad = marked.where("not _ok").select("query_idx", reason.alias("error"))
    return marked.select("query_idx").join(bad, "query_idx", "left").join(good, "query_idx", "left")
