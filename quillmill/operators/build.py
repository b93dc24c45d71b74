"""Building records: blocks to flat records, samples, index rows, questions, pools, jobs, seeds and their alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io
from .records import main_tag, tag_flags
from .running import running_total, same, total_by_hash
from .setjoin import SLACK, similar

#: The generic tag; pairs of level and route that go together, with their weights.
GENERIC = "通用"
PAIRS = (("L0", "R3", 10), ("L1", "R3", 12), ("L1", "R2", 8), ("L2", "R1", 9), ("L2", "R2", 10), ("L3", "R1", 10), ("L3", "R2", 12), ("L3", "R3", 4), ("L4", "R1", 9), ("L4", "R2", 12))

#: Seeds times their characters for which seeds are sent to tasks; above that they are joined.
SENT_CELLS = 50_000_000
#: Cells, texts and pairs that a task works on at a time; no character of a reduced text has a code from REDUCED on.
CELLS_HELD, TEXTS, PAIRS_HELD, REDUCED = 8_000_000, 65_536, 16_384, 0xA000


def text_of(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def first_present(*c: Column) -> Column:
    """The first value that is not null."""
    return F.coalesce(*c)


def first_text(*c: Column) -> Column:
    """The first value that is not blank, trimmed; empty without one."""
    return F.coalesce(*[F.when(text_of(x) != "", text_of(x)) for x in c], F.lit(""))


def first_int(default: int, *c: Column) -> Column:
    """The first value that is not blank as an integer; default if it is none or there is none."""
    return F.coalesce(first_text(*c).try_cast("long"), F.lit(default).cast("long"))


def path_info(path: Column) -> tuple[Column, Column, Column]:
    """doc_id, doc_name, source_path of an image's path: the name three folders up, and the last part, after a double underscore, of the folder above."""
    p = F.split(path, "/")
    n = F.size(p)
    name = F.when(n >= 4, F.get(p, n - 4)).otherwise("")
    doc = F.when(n >= 5, F.regexp_extract(F.get(p, n - 5), "__([^/_]+)$", 1)).otherwise("")
    up = lambda k: F.array_join(F.slice(p, 1, F.greatest(n - k, F.lit(0))), "/")
    return doc, name, F.when(n >= 4, up(3)).otherwise(up(1))


def doc_fields(doc_id: Column, doc_name: Column, out_dir: Column, parse_dir: Column) -> tuple[Column, Column]:
    """doc_id and doc_name as given, else from the folders' names (eight hex digits after a double underscore)."""
    given, named, out, parse = text_of(doc_id), text_of(doc_name), text_of(out_dir), text_of(parse_dir)
    parts = F.filter(F.split(F.when(out != "", out).otherwise(parse), "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    base = F.when((last == "auto") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)
    found = F.regexp_extract(base, "__([0-9a-f]{8})$", 1)
    own = F.filter(F.split(parse, "/"), lambda x: x != "")
    by_parse = F.when((F.size(own) >= 2) & (F.try_element_at(own, F.lit(-1)) == "auto"), F.try_element_at(own, F.lit(-2))).otherwise("")
    by_base = F.trim(F.replace(F.regexp_replace(base, "__[0-9a-f]{8}$", ""), F.lit("_"), F.lit(" ")))
    whole = (given != "") & (named != "")
    return F.when(whole | (given != ""), given).otherwise(found), F.when(named != "", named).when(by_parse != "", by_parse).otherwise(by_base)


def list_of(value: Column) -> Column:
    """A list of texts from a JSON list or a plain text; blank ones go."""
    v = text_of(value)
    listed = F.from_json(v, "array<string>")
    is_list = F.startswith(v, F.lit("[")) & F.try_parse_json(v).isNotNull()
    return F.when(v == "", F.array().cast("array<string>")).when(is_list, F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(v))


def dict_of(value: Column) -> Column:
    """A map of texts from a JSON object; empty for all else."""
    v = text_of(value)
    good = F.startswith(v, F.lit("{")) & F.try_parse_json(v).isNotNull()
    return F.coalesce(F.when(good, F.from_json(v, "map<string,string>")), F.create_map().cast("map<string,string>"))


def normalized(raw: DataFrame) -> DataFrame:
    """Index records of raw(text, content, sample_id, doc_id, block_id, page_idx, group_id, source_type, content_hash, organ_tags, line): synthesised ids and errors."""
    c = F.col
    text, h = T.normalize(first_present(c("text"), c("content"))), text_of(c("content_hash"))
    block = c("block_id").try_cast("long")
    given = text_of(c("block_id")) != ""
    seed = F.when(h != "", h).otherwise(text)
    block = F.when(given, F.coalesce(block, F.lit(-1))).otherwise(T.stable_int64(F.when(seed != "", seed).otherwise(F.concat(F.lit("line_"), c("line").cast("string")))))
    x = raw.withColumns({"_t": text, "_b": block, "_d": text_of(c("doc_id")), "_h": h, "_tags": list_of(c("organ_tags"))})
    made = F.when((c("_d") != "") & (c("_b") >= 0), F.concat_ws("_", F.lit("txt"), c("_d"), c("_b").cast("string"))).when(c("_h") != "", F.concat(F.lit("txt_append_"), F.substring(c("_h"), 1, 16))).otherwise(F.concat(F.lit("txt_append_"), F.md5(c("_t"))))
    x = x.withColumn("_s", F.when(text_of(c("sample_id")) != "", text_of(c("sample_id"))).otherwise(made))
    general, mixed = tag_flags(c("_tags"), GENERIC)
    group = text_of(c("group_id"))
    errors = F.array_compact(F.array(F.when(c("_t") == "", "missing_text"), F.when(given & (c("_b") == -1), "invalid_block_id"), F.when(F.length(c("_t")) > 32768, "text_too_long"), F.when(F.length(c("_s")) > 128, "sample_id_too_long")))
    return x.select(
        "line", c("_s").alias("sample_id"), F.when(group != "", group).otherwise(F.concat(F.lit("grp_"), c("_s"))).alias("group_id"), c("_t").alias("text"),
        F.when(text_of(c("source_type")) != "", text_of(c("source_type"))).otherwise("text_only").alias("source_type"), c("_d").alias("doc_id"), c("_b").alias("block_id"),
        first_int(-1, c("page_idx")).alias("page_idx"), c("_tags").alias("organ_tags"), general.alias("is_general"), mixed.alias("is_mixed"), main_tag(c("_tags"), GENERIC).alias("body_site_main"), errors.alias("errors"),
    )


def flat_block(kind: Column, text: Column, caption: Column, footnote: Column, image: Column, table: Column, folder: Column, page: Column) -> dict[str, Column]:
    """Text, image path, table and a stable hash of a parsed block: captions and footnotes (arrays) stand for text in images and tables."""
    lines = lambda a: F.array_join(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    both = F.array_join(F.filter(F.array(lines(caption), lines(footnote)), lambda x: x != ""), "\n")
    body = F.when(kind.isin("image", "table"), both).when(kind.isin("text", "equation", "discarded"), F.coalesce(text, F.lit(""))).otherwise(text_of(text))
    html = F.when(kind == "table", F.coalesce(table, F.lit("")))
    picture = F.when(kind.isin("image", "table", "equation"), image)
    named = F.to_json(F.struct(kind.alias("type"), page.alias("page_idx"), body.alias("text"), picture.alias("img_rel_path"), html.alias("table_html"), folder.alias("doc_parse_dir")))
    return {"text": body, "img_abs_path": F.when(picture.isNotNull() & (picture != ""), F.concat_ws("/", folder, picture)), "table_html": html, "is_noise": kind == "discarded", "content_hash": F.sha2(named, 256), "canonical_view": F.substring(body, 1, 200)}


def text_sample(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Samples of text blocks(block_id, doc_id, text, organ_tags (JSON), primary_type) with their document's name; a block without a document keeps empty names."""
    d = docs.select(F.col("doc_id").alias("_d"), "doc_name", "source_path")
    x = blocks.join(d, F.col("doc_id") == F.col("_d"), "left").withColumn("tags", F.array_distinct(list_of(F.col("organ_tags"))))
    general, mixed = tag_flags(F.col("tags"), GENERIC)
    sample = F.format_string("txt_%s_%s", F.col("doc_id").cast("string"), F.col("block_id").cast("string"))
    return x.select(sample.alias("sample_id"), F.concat(F.lit("grp_"), sample).alias("group_id"), F.lit("text_only").alias("source_type"), "doc_id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), F.coalesce("source_path", F.lit("")).alias("source_path"), "block_id", "text", "tags", F.coalesce("primary_type", F.lit("")).alias("knowledge_type_main"), main_tag(F.col("tags"), GENERIC).alias("body_site_main"), general.alias("is_general"), mixed.alias("is_mixed"))


def image_sample(pairs: DataFrame) -> DataFrame:
    """Samples of pairs(line, image_path, text): ids from the path and the line."""
    doc, name, source = path_info(F.col("image_path"))
    x = pairs.withColumns({"doc_id": doc, "doc_name": name, "source_path": source})
    key = F.format_string("%s_%06d", F.when(F.col("doc_id") == "", "unknown").otherwise(F.col("doc_id")), F.col("line"))
    return x.select(F.concat(F.lit("imgtxt_"), key).alias("sample_id"), F.concat(F.lit("img_"), key).alias("image_id"), "doc_id", "doc_name", "source_path", F.sha2(F.concat_ws("\n", "image_path", "text"), 256).alias("content_hash"), "text")


def image_rows(samples: DataFrame, images: str) -> DataFrame:
    """A row for each image (struct with image_id, image_path) of a sample, with its place; those without id or path go."""
    x = samples.select(*[c for c in samples.columns if c != images], F.posexplode(images).alias("pos", "_i"))
    return x.where((text_of(F.col("_i.image_id")) != "") & (text_of(F.col("_i.image_path")) != "")).select("*", F.col("_i.image_id").alias("image_id"), F.col("_i.image_path").alias("image_path")).withColumn("pos", F.col("pos").cast("long")).drop("_i")


def question_text(question: Column, options: Column) -> Column:
    """A question with its options, a line each."""
    return F.concat_ws("\n", question, F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n"))


def hit_score(weighted: Column, raw: Column, score: Column) -> Column:
    return F.coalesce(weighted, raw, score, F.lit(0.0))


def candidate_key(*fields: Column) -> Column:
    """md5 of fields joined by bars, null as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that fails where the right side has no row."""
    r = right.withColumn("_there", F.lit(True))
    x = left.join(r, key, "left")
    return x.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col("_there"))).where("_there").drop("_there")


def stable_pick(seed: Column, options: Column) -> Column:
    """One of the options by the first 8 hex digits of the seed's sha1."""
    return F.get(options, (F.conv(F.substring(F.sha1(seed), 1, 8), 16, 10).cast("long") % F.size(options)).cast("int"))


def hash_shuffled(values: Column, seed: Column) -> Column:
    """Values in order of the sha1 of the seed and the value."""
    marked = F.array_sort(F.transform(values, lambda v: F.struct(F.sha1(F.concat_ws(":", seed, v)).alias("h"), v.alias("v"))))
    return F.transform(marked, lambda x: x["v"])


def shuffled_options(answer: Column, distractors: Column, seed: Column) -> tuple[Column, Column]:
    """Options in hash order, and the letter of the answer."""
    values = hash_shuffled(F.concat(F.array(answer), distractors), seed)
    letter = F.char(F.lit(64) + F.array_position(values, answer))
    return values, letter


def distractors(answer: Column, pool: Column, seed: Column, n: int = 3) -> Column:
    """n distinct values of the pool that are not the answer, by hash; null if there are too few."""
    rest = F.filter(F.array_distinct(pool), lambda x: x.isNotNull() & (x != "") & (x != answer))
    return F.when(F.size(rest) >= n, F.slice(hash_shuffled(rest, seed), 1, n))


def mcq(samples: DataFrame, pool: Column, seed: str, question: str) -> DataFrame:
    """qid, question, o1..o4, answer, answer_text of template questions about samples(sample_id, answer_text); those without three distractors go."""
    s = F.concat_ws(":", F.lit(seed), F.col("sample_id").cast("string"))
    x = samples.withColumn("d", distractors(F.col("answer_text"), pool, s)).where("d is not null and answer_text <> ''")
    values, letter = shuffled_options(F.col("answer_text"), F.col("d"), F.concat_ws(":", s, F.lit("o")))
    x = x.withColumns({"v": values, "answer": letter})
    return x.select(F.concat(F.lit("mcq_"), F.substring(F.sha1(s), 1, 12)).alias("qid"), "sample_id", F.lit(question).alias("question"), *[F.get("v", F.lit(i)).alias(f"o{i + 1}") for i in range(4)], "answer", "answer_text")


def source_reason(image: Column, image_there: Column, source: Column, pdf: Column, content: Column, page: Column, context: Column, local: Column, caption: Column, least: int) -> Column:
    """Why a source cannot be used, by the first of seven rules; null if it can."""
    none = lambda c: text_of(c) == ""
    short = (F.length(text_of(context)) < least) & (F.length(text_of(local)) < least) & none(caption)
    return (
        F.when(none(image), "no_image_path").when(~image_there, "missing_image_file").when(none(source), "missing_source_path").when(none(pdf), "missing_origin_pdf")
        .when(none(content), "missing_content_list").when(page.isNull(), "cannot_infer_page_idx").when(short, "empty_text_and_context")
    )


def weighted_pair(key: Column) -> Column:
    """A pair of level and route by weight, chosen by hash of the key."""
    total = sum(w for *_, w in PAIRS)
    at = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % total
    out, upto = F.lit(None).cast("struct<level:string,route:string>"), total
    for level, route, w in reversed(PAIRS):
        upto -= w
        out = F.when(at < upto + w, F.struct(F.lit(level).alias("level"), F.lit(route).alias("route"))).otherwise(out)
    return out


def alignment_cases(jobs: DataFrame, cases: DataFrame, most: int) -> DataFrame:
    """job_id, case_id, pos: cases(case_id, level, route) for jobs(job_id, level, route): equal in both first, then in route, then in level, then others.

    A job needs at most `most` cases of each kind, so cases are cut to that many for each key before they meet the jobs.
    """
    cut = lambda keys: cases.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("case_id") if keys else Window.orderBy("case_id"))).where(F.col("_n") <= (3 * most + most if not keys else 2 * most)).drop("_n")
    out = None
    for tier, keys in enumerate((["level", "route"], ["route"], ["level"], [])):
        own = cut(keys).select(F.col("case_id"), F.col("level").alias("_l"), F.col("route").alias("_r"))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col("_" + k[0]))
        part = jobs.join(own, on) if keys else jobs.crossJoin(F.broadcast(own))
        part = part.select("job_id", "case_id", F.lit(tier).alias("tier"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("job_id", "case_id").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("job_id").orderBy("tier", "case_id")
    return best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("job_id", "case_id", "pos")


def rank_signal(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """id, percentile, closest: the share of reference(score, level) at or under each score(id, score), and the level with the nearest median (the first of equals)."""
    n = reference.count()
    med = reference.groupBy("level").agg(F.expr("percentile_disc(0.5) within group (order by score)").alias("m"))
    # a few levels
    levels = med.agg(F.sort_array(F.collect_list(F.struct("level", "m"))).alias("ls"))
    both = reference.select("score", F.lit(1).alias("n")).unionByName(scores.select("score", F.lit(0).alias("n")))
    upto = running_total(both.groupBy("score").agg(F.sum("n").alias("n")), "score", "n", "c")
    x = scores.join(upto.select("score", "c"), "score").crossJoin(F.broadcast(levels))
    gaps = F.transform("ls", lambda l: F.struct(F.abs(F.col("score") - l["m"]).alias("g"), l["level"].alias("level")))
    return x.select("id", F.round(100.0 * F.col("c") / max(n, 1), 4).alias("percentile"), F.array_min(gaps)["level"].alias("closest"))


def gold_seeds(passages: DataFrame, level: str, most: int) -> DataFrame:
    """qid, idx, text: of each query's passages(qid, idx, level, rank_score, text) of a level the best by rank score, ties by place."""
    w = Window.partitionBy("qid").orderBy(F.desc("rank_score"), "idx")
    return passages.where(F.col("level") == level).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("qid", "pos", "idx", "text")


def seed_scores(seeds: DataFrame, passages: DataFrame, least: float = 0.35, most: int = SENT_CELLS) -> DataFrame:
    """qid, seed, pk, cosine, char3, contain of seeds(qid, seed, text) and the passages(pk, text) with at least that share of a seed's words.

    Words and character triples are sets; cosine and contain are of words, char3 is the Jaccard similarity of triples, all to 9 decimals. Seeds that
    fit into `most` cells (seeds by their characters) are sent to the passages, which are read once and not shuffled; more seeds meet only in pairs
    that an exact similarity join has found. Both give the same rows.
    """
    words = lambda d: d.withColumn("items", T.tokens_en(F.col("text"), None)).withColumn("_s", T.reduced(F.col("text")))
    n, chars = seeds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    both = _sent_scores(words(seeds), words(passages), least) if n * chars <= most else _joined_scores(words(seeds), words(passages), least)
    char3 = F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_n") / F.col("_m"))
    scores = {"cosine": F.col("shared") / F.sqrt(F.col("left_n") * F.col("right_n").cast("double")), "char3": char3, "contain": F.col("shared") / F.col("left_n")}
    return both.select("qid", "seed", "pk", *[F.round(x, 9).alias(n) for n, x in scores.items()])


def _joined_scores(seeds: DataFrame, passages: DataFrame, least: float) -> DataFrame:
    """Pairs of seeds(qid, seed, items, _s) and passages(pk, items, _s) with their counts, by a join."""
    found = similar(seeds.select(F.struct("qid", "seed").alias("id"), "items"), passages.select(F.col("pk").alias("id"), "items"), least, "containment")
    met = found.select(F.col("left_id.qid").alias("qid"), F.col("left_id.seed").alias("seed"), F.col("right_id").alias("pk"), "shared", "left_n", "right_n")
    # triples are made once for each text that is in a pair
    triples = lambda d, out: d.withColumn(out, T.ngrams_of(F.col("_s"))).drop("_s")
    right = io.written(triples(passages.join(met.select("pk").distinct(), "pk", "left_semi").select("pk", "_s"), "b"), "triples")
    both = met.join(triples(seeds.select("qid", "seed", "_s"), "a"), ["qid", "seed"]).join(right, "pk")
    common = F.size(F.array_intersect("a", "b"))
    return both.withColumn("_n", common).withColumn("_m", F.size("a") + F.size("b") - F.col("_n"))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of a text and code of each of its distinct character triples (a shorter text is one), for at most 65,536 reduced texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
    code = np.append(code, [0, 0])
    # reduced texts have no character from REDUCED on; where a text ends, nothing follows
    packed = ((row * REDUCED + code[:-2]) * REDUCED + np.where(left > 1, code[1:-1], 0)) * REDUCED + np.where(left > 2, code[2:], 0)
    packed = np.sort(packed[(left > 2) | (left == np.repeat(sizes, sizes))])
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    return packed // REDUCED**3, packed % REDUCED**3


def _bits(row: np.ndarray, at: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    flags = np.zeros((rows, -(-max(width, 1) // 64) * 64), bool)
    flags[row, at] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def _sent_scores(seeds: DataFrame, passages: DataFrame, least: float) -> DataFrame:
    """What _joined_scores gives, by tables of all seeds in each task: words by seeds, and seeds by bits of triples."""
    kinds = dict(seeds.dtypes) | dict(passages.dtypes)
    got = seeds.where("qid IS NOT NULL AND seed IS NOT NULL").select("qid", "seed", F.array_distinct("items").alias("items"), "_s").where(F.size("items") > 0).toArrow().combine_chunks()
    sent = seeds.sparkSession.sparkContext.broadcast(got)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        items = own["items"].combine_chunks()
        n = pc.list_value_length(items).to_numpy()
        need = np.ceil(n * least - SLACK).astype(np.int64)
        known = pc.unique(items.flatten())
        has = np.zeros((len(known), len(n)), np.min_scalar_type(int(n.max(initial=0))))
        has[pc.index_in(items.flatten(), known).to_numpy(), np.repeat(np.arange(len(n)), n)] = 1
        strings = own["_s"].to_pylist()
        found = [_grams(strings[a : a + TEXTS]) for a in range(0, len(n), TEXTS)]
        row, code = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([r + TEXTS * i for i, (r, _) in enumerate(found)], [c for _, c in found]))
        codes, at = np.unique(code, return_inverse=True)
        theirs, sizes = _bits(row, at, len(n), len(codes)), np.bincount(row, minlength=len(n))
        step = max(1, CELLS_HELD // max(1, len(n)))
        for b in batches:
            words, reduced = b.column(1), b.column(2)
            counts = pc.list_value_length(words).to_numpy()
            of, word = np.repeat(np.arange(b.num_rows), counts), pc.index_in(words.flatten(), known)
            keep = word.is_valid().to_numpy(zero_copy_only=False)
            of, word = of[keep], word.drop_null().to_numpy()
            # so many passages at a time, and so many of their words
            ends = np.searchsorted(of, np.arange(b.num_rows), "right")
            a = 0
            while a < b.num_rows:
                first = ends[a - 1] if a else 0
                z = min(a + min(step, TEXTS), max(a + 1, int(np.searchsorted(ends, first + step, "right"))), b.num_rows)
                inside = slice(first, ends[z - 1])
                starts = np.flatnonzero(np.append(True, of[inside][1:] != of[inside][:-1])) if ends[z - 1] > first else np.zeros(0, int)
                if len(starts):
                    here = of[inside][starts]
                    shared = np.add.reduceat(has[word[inside]], starts, axis=0, dtype=has.dtype)
                    p, q = np.nonzero(shared >= need)
                    if len(p):
                        count, place = shared[p, q].astype(np.int32), here[p]
                        texts, which = np.unique(place, return_inverse=True)
                        r, code = _grams(reduced.take(pa.array(texts)).to_pylist())
                        many = np.bincount(r, minlength=len(texts))
                        spot = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                        hit = codes[spot] == code if len(codes) else np.zeros(len(code), bool)
                        ours = _bits(r[hit], spot[hit], len(texts), len(codes))
                        for c in range(0, len(p), PAIRS_HELD):
                            o, w = q[c : c + PAIRS_HELD], which[c : c + PAIRS_HELD]
                            common = np.bitwise_count(ours[w] & theirs[o]).sum(axis=1, dtype=np.int32)
                            total = (sizes[o] + many[w]).astype(np.int32) - common
                            seed, pk = pa.array(o), pa.array(place[c : c + PAIRS_HELD])
                            arrays = [own["qid"].combine_chunks().take(seed), own["seed"].combine_chunks().take(seed), b.column(0).take(pk), *map(pa.array, (count[c : c + PAIRS_HELD], n[o].astype(np.int32), counts[pk.to_numpy()].astype(np.int32), common, total))]
                            yield pa.RecordBatch.from_arrays(arrays, ["qid", "seed", "pk", "shared", "left_n", "right_n", "_n", "_m"])
                a = z

    rows = passages.where("pk IS NOT NULL").select("pk", F.array_distinct("items").alias("items"), "_s")
    return rows.mapInArrow(run, f"qid {kinds['qid']}, seed {kinds['seed']}, pk {kinds['pk']}, shared int, left_n int, right_n int, _n int, _m int")


def align_seeds(scored: DataFrame, consensus: int = 5) -> DataFrame:
    """qid, pk, stage, reason: the corpus text that each query's seeds stand for.

    scored: qid, seed, pk, cosine, char3, contain of each seed's candidates. A: of seeds whose best candidate passes strict or soft
    thresholds that with the highest joint score. B: a candidate that is among the best of two seeds (first if it
    is the best of all) and passes a floor. C: the best candidate of any seed.
    """
    order = Window.partitionBy("qid", "seed").orderBy(F.desc("cosine"), F.desc("char3"), F.desc("contain"), "pk")
    c = F.col
    x = scored.withColumn("place", F.row_number().over(order)).where(c("place") <= consensus)
    x = x.withColumn("joint", c("cosine") + 0.2 * c("char3") + 0.1 * c("contain"))
    strict = (c("cosine") >= 0.92) & (c("char3") >= 0.20)
    soft = (c("cosine") >= 0.88) & (c("char3") >= 0.30) & (c("contain") >= 0.60)
    # a few rows a seed, which all that follows reads; each seed with candidates has one that is first
    x = io.written(x.withColumn("why", F.when(strict, "strict_cos+char3").when(soft, "soft_contain+cos+char3")), "best")
    tops = x.where("place = 1")
    seeds = tops.groupBy("qid").agg(F.count_distinct("seed").alias("seeds"))
    best = lambda d, keys: d.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*keys, "pk", "seed"))).where("_n = 1")
    a = best(tops.where("why is not null"), [F.desc("joint")]).select("qid", "pk", F.lit("A_threshold").alias("stage"), c("why").alias("reason"))
    votes = x.groupBy("qid", "pk").agg(F.count_distinct("seed").alias("votes"), F.count_if(c("place") == 1).alias("firsts"), F.avg("joint").alias("mean"), F.max_by(F.struct("cosine", "contain"), "joint").alias("rep")).join(seeds, "qid")
    floor = (c("rep.cosine") >= 0.78) | (c("rep.contain") >= 0.35)
    one = votes.where((c("seeds") >= 2) & (c("firsts") == c("seeds"))).where(floor).select("qid", "pk", F.lit("B_consensus").alias("stage"), F.lit("top1").alias("reason"))
    many = votes.where("votes >= 2").withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("mean"), "pk"))).where("_n = 1").where(floor).select("qid", "pk", F.lit("B_consensus").alias("stage"), F.lit("topk").alias("reason"))
    last = best(tops, [F.desc("joint")]).select("qid", "pk", F.lit("C_fallback").alias("stage"), F.lit("best_score").alias("reason"))
    out = a
    for more in (one, many, last):
        out = out.unionByName(more.join(out.select("qid"), "qid", "left_anti"))
    return out


def oracle_queries(question: Column, options: Column, answer: Column, answer_text: Column, context: Column) -> tuple[Column, Column]:
    """A query by the answer's text, and one by the first 200 characters of the context."""
    by_letter = F.coalesce(F.try_element_at(options, answer), F.lit(""))
    gold = F.when(by_letter != "", by_letter).otherwise(F.coalesce(answer_text, F.lit("")))
    return F.trim(F.concat_ws(" ", F.coalesce(question, F.lit("")), gold)), F.trim(F.substring(F.coalesce(context, F.lit("")), 1, 200))


def annotations_of(markdown: Column) -> Column:
    """sample_id and annotation (JSON text) of each case of a review pack in markdown."""
    cases = F.filter(F.split(markdown, r"(?m)^## Case \d+\n"), lambda x: F.startswith(x, F.lit("- sample_id: ")))
    return F.transform(cases, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^- sample_id: ([^\n]+)", 1)).alias("sample_id"), F.regexp_extract(x, r"(?s)- annotation_template:\n```json\n(.*?)\n```", 1).alias("annotation")))


def filled_from_notes(level: Column, route: Column, notes: Column) -> tuple[Column, Column]:
    """Level and route as annotated, else as the notes name them."""
    named = lambda p: F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), rf"\b({p})\b", 1), F.lit(""))
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.coalesce(blank(level), named("L[0-4]")), F.coalesce(blank(route), named("R[1-3]"))


def review_pack(rows: DataFrame, title: str, size: int) -> DataFrame:
    """pack, body: rows(id, text) as markdown, `size` cases a pack in order of id."""
    w = Window.partitionBy("pack").orderBy("id")
    x = rows.withColumn("k", F.row_number().over(w)).withColumn("case", F.concat(F.lit("## Case "), F.col("k").cast("string"), F.lit("\n- sample_id: "), F.col("id").cast("string"), F.lit("\n- text: "), F.col("text"), F.lit("\n")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "case"))), lambda c: c["case"]), "\n")
    return x.groupBy("pack").agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("body"))


def balanced(items: DataFrame, per_split: dict[str, int], seed: str) -> DataFrame:
    """id, split: of each split the wanted number, equal by kind (first kinds take the rest), short kinds made up from what is left. items: id, split, kind."""
    want = F.lit(None).cast("int")
    for k, v in per_split.items():
        want = F.when(F.col("split") == k, v).otherwise(want)
    kinds = items.groupBy("split").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    mark = F.sha1(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    x = items.join(F.broadcast(kinds), "split").withColumn("want", want).where("want is not null").withColumn("_h", mark)
    k, n = F.array_position("kinds", F.col("kind")) - 1, F.size("kinds")
    quota = F.floor(F.col("want") / n) + (k < F.col("want") % n).cast("int")
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("split", "kind").orderBy("_h", "id"))).withColumn("inside", F.col("r") <= quota)
    order = Window.partitionBy("split").orderBy(F.desc("inside"), "_h", "id")
    return x.withColumn("p", F.row_number().over(order)).where(F.col("p") <= F.col("want")).select("id", "split", "kind")


def stratified(items: DataFrame, n: int, seed: str) -> DataFrame:
    """n of items(id, kind): equal by kind, made up from the rest by hash."""
    kinds = items.select("kind").distinct().count()
    per = max(1, n // kinds) if kinds else n
    h = F.sha1(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    x = items.withColumn("_h", h).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("_h", "id")))
    return x.withColumn("_o", (F.col("r") > per).cast("int")).orderBy("_o", "_h", "id").limit(n).select("id", "kind")


def group_split(rows: DataFrame, share: float, seed: str) -> DataFrame:
    """rows with split: whole groups (equal text) go to test, by label, in hash order, until the label's share of rows is reached. rows: id, group, label."""
    g = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min_by("label", "id").alias("label"))
    h = F.sha1(F.concat_ws(":", F.lit(seed), F.col("group")))
    upto = total_by_hash(g.withColumn("_h", h), "_h", ["group"], "n", "_upto", ["label"])
    totals = upto.groupBy("label").agg(F.sum("n").alias("_total"))
    both = upto.alias("x").join(totals.alias("t"), same("x", "t", ["label"])).select("x.*", "_total")
    done = both.withColumn("split", F.when(F.col("_upto") - F.col("n") < F.bround(F.col("_total") * share), "test").otherwise("train"))
    return rows.join(done.select("group", "split"), "group")


def task_quota(sources: DataFrame, quota: dict[str, int], seed: str, most: int) -> DataFrame:
    """task, source, kind: two different kinds a source, in hash order, so that no kind exceeds its quota and scarce ones are used.

    Kinds are laid out by quota, the largest first and then in turn, two to a source; a layout is a bounded list of tasks.
    """
    left, plan = dict(quota), []
    while len(plan) < most and any(left.values()):
        two = sorted((k for k in left if left[k] > 0), key=lambda k: (-left[k], k))[:2]
        for k in two:
            left[k] -= 1
            plan.append((len(plan), k, two))
    spark = sources.sparkSession
    slots, pair = [], 0
    for i, k, two in plan[:most]:
        slots.append((i, k, pair))
        pair += k == two[-1]
    t = spark.createDataFrame(slots, "task long, kind string, place long")
    h = F.sha1(F.concat_ws(":", F.lit(seed), F.col("source").cast("string")))
    s = sources.select("source", h.alias("_h")).orderBy("_h", "source").limit(max(1, len(slots)))
    s = s.withColumn("place", F.row_number().over(Window.orderBy("_h", "source")) - 1)
    return t.join(s, "place").select("task", "source", "kind")
