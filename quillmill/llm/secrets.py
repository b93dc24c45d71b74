"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers; both are bigram models over a fixed
alphabet, trained from labelled strings. A long token that no pattern covers is a secret when the
ratio of its likelihoods, per character, passes a threshold. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The patterns, in the order of their kinds, and the least length of what must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,m:string>>"
#: Matches laid at a time.
BLOCK = 128


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f evaluates it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans(text: Column, pattern: str, rank: int, kind: str, passes) -> Column:
    """Spans in code points of the pattern's matches, leftmost and not overlapping, that pass; m is the match itself.

    Matches are laid between the pieces that a split by the same pattern leaves, BLOCK at a time, so that
    the arrays which grow while they are laid stay short.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    piece = lambda s, m: F.struct((F.length(s) + F.coalesce(F.length(m), F.lit(0))).alias("n"), F.coalesce(F.length(m), F.lit(0)).alias("l"), F.coalesce(passes(m), F.lit(False)).alias("ok"), m.alias("m"))

    def step(a: Column, x: Column) -> Column:
        end = a["p"] + x["n"]
        span = F.array(F.struct((end - x["l"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.struct(end.alias("p"), F.when(x["ok"], F.concat(a["o"], span)).otherwise(a["o"]).alias("o"))

    def in_block(x: Column, begin: Column) -> Column:
        return F.aggregate(x, F.struct(begin.alias("p"), F.array().cast(_SPAN).alias("o")), step, lambda a: a["o"])

    def laid(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["n"]))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), in_block))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: F.slice(p, k * BLOCK + 1, F.lit(BLOCK)))
    whole = bound(bound(F.zip_with(F.split(text, pattern, -1), found, piece), cut), laid)
    # most texts hold no match that passes: those are not split
    return F.when(F.exists(found, passes), whole).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> list[Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]
    # a run of the class that is too short fails as a whole, so the least length may stand in the pattern
    access = F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1, "access", lambda m: F.length(m) >= LEAST["access"])).otherwise(F.array().cast(_SPAN))
    return [spans(text, ASSIGN, 0, "assign", value), access, spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", 2, "hex", lambda m: F.length(m) >= LEAST["hex"])]


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratios, in thousandths, of each pair of characters: rows (text string, secret boolean) in.

    Position (1 + index of the character) + (1 + index of the one before, 0 at the start) * (size + 1).
    Characters outside the alphabet, and null rows, are left out. At most (size + 1)^2 counts leave Spark.
    """
    size = len(ALPHABET) + 1
    clean = labelled.where("text is not null and secret is not null").select("secret", F.regexp_replace("text", "[^A-Za-z0-9+/_=-]", "").alias("t")).where(F.length("t") > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.instr(F.lit(ALPHABET), F.substring(F.col("t"), i, F.lit(1))) + size * F.when(i > 1, F.instr(F.lit(ALPHABET), F.substring(F.col("t"), i - 1, F.lit(1)))).otherwise(0))
    counts = clean.select("secret", F.explode(pairs).alias("at")).groupBy("at").agg(F.count_if("secret").alias("r"), F.count_if(~F.col("secret")).alias("o"))
    total = counts.withColumn("prev", F.floor(F.col("at") / size)).groupBy("prev").agg(F.sum("r").alias("tr"), F.sum("o").alias("to_"))
    ratio = [0.0] * (size * size)
    sums = {r["prev"]: (r["tr"], r["to_"]) for r in total.toLocalIterator()}
    seen = {r["at"]: (r["r"], r["o"]) for r in counts.toLocalIterator()}
    import math

    for at in range(size * size):
        (r, o), (tr, to) = seen.get(at, (0, 0)), sums.get(at // size, (0, 0))
        many = smoothing * (size - 1)
        ratio[at] = math.log((r + smoothing) / (tr + many)) - math.log((o + smoothing) / (to + many))
    return [round(1000 * x) for x in ratio]


def ratio_per_char(token: Column, model: Column) -> Column:
    """The log-likelihood ratio of a token per character, in thousandths; its characters are taken apart once."""
    size = len(ALPHABET) + 1
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = lambda c: F.zip_with(c, F.concat(F.array(F.lit(0)), F.slice(c, 1, F.size(c) - 1)), lambda x, before: F.get(model, x + size * before))
    return bound(codes, lambda c: F.aggregate(pairs(c), F.lit(0), lambda a, x: a + x) / F.size(c))


def labelled_strings(docs: DataFrame, most_docs: int = 400, randoms: int = 1500) -> DataFrame:
    """Labelled strings: digests in three alphabets, and words (alone, and joined as identifiers) of a
    bounded sample of documents, those with the smallest hash of doc_id."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("labelled-"), F.col("id").cast("string")), 256)
    shapes = F.array(digest, F.base64(F.unhex(digest)), F.substring(F.upper(F.base64(F.unhex(digest))), 1, 24), F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "abc"), 5, 30))
    secret = spark.range(randoms).select(F.explode(shapes).alias("text"), F.lit(True).alias("secret"))
    # ids alone are ordered, so that no task gathers texts
    wanted = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")
    words = F.regexp_extract_all(C.text_or_empty(), F.lit("[A-Za-z]{3,}"), F.lit(0))
    own = sample.select(words.alias("w")).select(F.explode(F.concat("w", F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b)))).alias("text"), F.lit(False).alias("secret"))
    return secret.unionByName(own)


def find_secrets(docs: DataFrame, model: list[int], threshold: int = 400) -> DataFrame:
    """docs packed as _row, with base and spans: arrays of (start, rank, end, kind) in order.

    Null and empty texts have no spans. Time grows with a text's length, also if it is one token or all matches. Each row is scanned alone. A markov span is a token of 20 or more characters of the
    alphabet whose ratio per character is above threshold thousandths and that touches no base span.
    An empty table gives an empty table.
    """
    rows = C.packed(docs).withColumn("_t", F.coalesce(F.col("_row.text").cast("string"), F.lit("")))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
    rows = rows.withColumn("base", F.sort_array(bare(F.concat(*base_spans(F.col("_t"))))))
    table = F.lit(model)
    rows = rows.withColumn("_more", spans(F.col("_t"), TOKEN, 3, "markov", lambda m: F.length(m) >= 20))
    judged = bare(F.filter("_more", lambda x: (ratio_per_char(x["m"], table) > threshold) & ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    return rows.select("_row", "base", C.held(F.sort_array(F.concat("base", judged))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    done = find_secrets(docs, train(labelled_strings(docs)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("_row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
