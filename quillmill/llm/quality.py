"""Quality rules whose cutoffs adapt to each language and source.

Every rule's measure is an integer. A quantile sketch is a histogram of a measure: counts by value,
which merge by addition in Spark's partial aggregation, and whose size is bounded because measures
are capped. Thresholds are fences around the quartiles of a (language, source) group; a group with
too few documents takes its language's, then everything's. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Measures are capped at CAP (shares of a thousand never reach it; a mean word length does at 200 characters): a fence above it rejects none.
CAP = 2000
#: Measures: name, lower fence wanted, least spread (the fence is q3 + factor * max(q3 - q1, spread)).
MEASURES = (("sym", False, 10), ("caps", False, 15), ("bang", False, 5), ("wlen", True, 8), ("dups", False, 12))
FACTOR = 4
LEAST_GROUP = 100
#: Groups (rows of thresholds, some 100 bytes each) up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: The characters that count as symbols, in a regex class.
SYMBOLS = "#*$%&|<>"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are in the regex class chars."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _measures(d: DataFrame) -> DataFrame:
    """Adds n_symbols, n_dup_lines, _lines and the capped measures m_* to _text; needs no words."""
    full = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(C.SPACES))) > 0)
    d = d.withColumn("_full", full)
    d = d.withColumns({"n_symbols": count_of(F.col("_text"), SYMBOLS), "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"), "_lines": F.size("_full").cast("long")})
    gaps = F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit("")))
    d = d.withColumns({"_len": F.length("_text").cast("long"), "_gaps": gaps.cast("long") + F.col("_lines"), "_caps": count_of(F.col("_text"), "A-Z"), "_bang": count_of(F.col("_text"), "!?")})
    per = lambda top, bottom, unit: F.least(F.lit(CAP), F.expr(f"({top}) * {unit} div greatest({bottom}, 1)"))
    return d.withColumns({"m_sym": per("n_symbols", "_len", 1000), "m_caps": per("_caps", "_len", 1000), "m_bang": per("_bang", "_len", 1000), "m_wlen": per("_len", "_gaps", 10), "m_dups": per("n_dup_lines", "_lines", 100)})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, C.SPACE_CLASS + "+", -1), "")


def repeated_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that the text holds twice or more.

    Windows are hashed, the hashes' low bits replaced by their positions and sorted; equal neighbours
    are candidates, whose words are then compared themselves. All of it stays in the row.
    """
    d = d.withColumn("_w", F.size("_words")).withColumn("_bits", F.length(F.bin(F.col("_w").cast("long"))))
    packed = F.expr("sort_array(transform(slice(_words, 1, greatest(_w - 2, 0)), (w, i) -> shiftleft(shiftright(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits), _bits) | cast(i as bigint)))")
    d = d.withColumn("_packed", packed)
    pair = "zip_with(_packed, slice(_packed, 2, size(_packed)), (a, b) -> if(shiftright(a ^ b, _bits) = 0, cast({} & (shiftleft(1L, _bits) - 1) as int), -1))"
    d = d.withColumn("_first", F.expr(f"array_remove({pair.format('a')}, -1)"))
    d = d.withColumn("_near", F.expr(f"if(size(_first) = 0, _first, array_union(_first, array_remove({pair.format('b')}, -1)))"))
    windows = F.expr("sort_array(transform(_near, p -> struct(concat_ws(' ', get(_words, p), get(_words, p + 1), get(_words, p + 2)) as w, p as p)))")
    d = d.withColumn("_windows", windows)
    same = F.expr("filter(_windows, (x, j) -> coalesce(get(_windows, j - 1).w = x.w, false) or coalesce(get(_windows, j + 1).w = x.w, false))")
    d = d.withColumn("_same", same)
    covered = F.expr("size(array_distinct(flatten(transform(_same, x -> array(x.p, x.p + 1, x.p + 2)))))")
    return d.withColumn("n_repeat_words", covered.cast("long"))


def thresholds(measured: DataFrame, factor: int = FACTOR, least_group: int = LEAST_GROUP) -> DataFrame:
    """_lang, _source and a low_/high_ fence for every measure, from histograms merged by addition."""
    names = [m for m, _, _ in MEASURES]
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"m_{m}").cast("int").alias("v")) for m in names])).alias("x")
    # staged: the text is measured once for all levels
    cells = C.stage(measured.select("_lang", "_source", points).groupBy("_lang", "_source", "x.m", "x.v").agg(F.count(F.lit(1)).alias("n")), "cells")
    by = ["m", "v"]
    levels = {"s": ["_lang", "_source"], "l": ["_lang"], "a": []}
    out = None
    groups = cells.select("_lang", "_source").distinct()
    for k, keys in levels.items():
        hist = cells.groupBy(*keys, *by).agg(F.sum("n").alias("n"))
        # a histogram has at most CAP + 1 cells for each group and measure
        folded = hist.groupBy(*keys, "m").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"))
        at = lambda q: f"aggregate(h, named_struct('c', 0L, 'r', cast(null as int)), (a, x) -> named_struct('c', a.c + x.n, 'r', coalesce(a.r, if((a.c + x.n) * 4 >= total * {q}, x.v, cast(null as int)))), a -> a.r)"
        quart = folded.select(*keys, "m", "total", F.expr(at(1)).alias("q1"), F.expr(at(3)).alias("q3"))
        wide = quart.groupBy(*keys).agg(F.max("total").alias(f"n_{k}"), *[F.max(F.when(F.col("m") == m, F.col(q))).alias(f"{q}_{m}_{k}") for m in names for q in ("q1", "q3")])
        out = groups if out is None else out
        cond = [F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys]
        right = [c for c in wide.columns if c not in keys]
        on = cond[0] if cond else F.lit(True)
        for c in cond[1:]:
            on = on & c
        out = out.alias("g").join(wide.alias("w") if keys else F.broadcast(wide.alias("w")), on, "left").select("g.*", *[F.col(f"w.{c}") for c in right])
    pick = lambda q, m: F.when(F.col("n_s") >= least_group, F.col(f"{q}_{m}_s")).when(F.col("n_l") >= least_group, F.col(f"{q}_{m}_l")).otherwise(F.col(f"{q}_{m}_a"))
    fences = []
    for m, low, spread in MEASURES:
        width = F.greatest(pick("q3", m) - pick("q1", m), F.lit(spread)) * factor
        fences.append((pick("q3", m) + width).alias(f"high_{m}"))
        fences.append((pick("q1", m) - width if low else F.lit(-1)).cast("int").alias(f"low_{m}"))
    return out.select("_lang", "_source", *fences)


def judge(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept as struct _q.

    A document fails the base rules if it has under 50 words or over half of them stand in repeated
    3-word windows; else it is kept if every measure lies within the fences of its language and
    source (nulls form a group of their own). Null text has no words and fails. Thresholds come from all rows, in
    a first pass over the text; a second pass measures and filters. An empty table gives an empty table.
    """
    first = docs.select(F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), C.text_or_empty().alias("_text"))
    fences = C.stage(thresholds(_measures(first).select("_lang", "_source", *[f"m_{m}" for m, _, _ in MEASURES]), **limits), "fences")
    if fences.count() <= MOST_BROADCAST:
        fences = F.broadcast(fences)
    rows = C.packed(docs).select("_row", F.col("_row.lang").cast("string").alias("_lang"), F.col("_row.source").cast("string").alias("_source"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("_text"))
    rows = _measures(rows.withColumn("_words", words_of(F.col("_text")))).drop("_full")
    rows = rows.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long")})
    j = repeated_words(rows).drop("_words", "_packed", "_first", "_near", "_windows", "_same", "_text").alias("d").join(fences.alias("f"), F.col("d._lang").eqNullSafe(F.col("f._lang")) & F.col("d._source").eqNullSafe(F.col("f._source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for m, _, _ in MEASURES:
        fits = fits & (F.col(f"m_{m}") <= F.col(f"high_{m}")) & (F.col(f"m_{m}") >= F.col(f"low_{m}"))
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return j.select("_row", C.held(F.struct(*facts, failed.alias("base_failed"), (~failed & fits).alias("kept"))).alias("_q"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return done.select("_row.doc_id", "_q.*")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return judge(docs).where("_q.kept").select("_row.*")


def _oracle() -> str:
    strip = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    plain = "regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g')"
    count = lambda cls: f"length(t) - length(regexp_replace(t, '{cls}', '', 'g'))"
    cuts = []
    for k, keys in (("s", "lang, source"), ("l", "lang"), ("a", "")):
        cols = ", ".join(f"quantile_disc({c}, {q}) AS {n}_{m}_{k}" for m, c in ((m, f"m_{m}") for m, _, _ in MEASURES) for n, q in (("q1", 0.25), ("q3", 0.75)))
        cuts.append(f"c{k} AS (SELECT {keys + ',' if keys else ''} count(*) AS n_{k}, {cols} FROM m {'GROUP BY ' + keys if keys else ''})")
    fits = []
    for m, low, spread in MEASURES:
        q = lambda n: f"CASE WHEN n_s >= {LEAST_GROUP} THEN {n}_{m}_s WHEN n_l >= {LEAST_GROUP} THEN {n}_{m}_l ELSE {n}_{m}_a END"  # noqa: B023, E731
        width = f"{FACTOR} * greatest(({q('q3')}) - ({q('q1')}), {spread})"
        fits.append(f"m_{m} <= ({q('q3')}) + {width}")
        if low:
            fits.append(f"m_{m} >= ({q('q1')}) - {width}")
    return rf"""
WITH t0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: {plain.format("x")} <> '') AS f FROM t0),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b2, c) AS n FROM (
      SELECT doc_id, i, w[i] AS a, w[i + 1] AS b2, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)))
  WHERE n > 1) GROUP BY doc_id),
n AS (SELECT b.doc_id, lang, source, len(w) AS n_words, length({plain.format("t")}) AS word_chars,
  {count("[#*$%&|<>]")} AS n_symbols, len(f) - len(list_distinct(f)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  {count("[A-Z]")} AS caps, {count("[!?]")} AS bang, len(f) AS nl, length(t) AS n_len, {count(" ")} + len(f) AS gaps
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id),
m AS (SELECT *, least({CAP}, n_symbols * 1000 // greatest(n_len, 1)) AS m_sym, least({CAP}, caps * 1000 // greatest(n_len, 1)) AS m_caps,
  least({CAP}, bang * 1000 // greatest(n_len, 1)) AS m_bang, least({CAP}, n_len * 10 // greatest(gaps, 1)) AS m_wlen,
  least({CAP}, n_dup_lines * 100 // greatest(nl, 1)) AS m_dups,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n),
{", ".join(cuts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(fits)} AS kept
FROM m JOIN cs ON m.lang IS NOT DISTINCT FROM cs.lang AND m.source IS NOT DISTINCT FROM cs.source
JOIN cl ON m.lang IS NOT DISTINCT FROM cl.lang CROSS JOIN ca
"""


ORACLE = {"op6_quality": _oracle()}
