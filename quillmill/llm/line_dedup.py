"""Line dedup with two Bloom filters.

A first pass over all lines builds two Bloom filters over line keys: one of hashes seen once, one of
hashes seen twice. Only lines whose key is in the second can be repeats; only those are shuffled,
with their whole key, for exact confirmation and for the choice of the first document. A false
positive costs a shuffled line, never a wrong result, so a filter at its size limit stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bits of a filter block; offsets in a block fit in 16 bits.
BLOCK = 1 << 16
SPACES = C.SPACES.encode()


def line_keys(text: bytes) -> list[bytes]:
    """Of each line: without ASCII white space at its ends, A-Z lower-cased."""
    return [line.strip(SPACES).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.uint64)
    m = np.uint64(bits - 1)
    return np.concatenate([h & m, (h >> np.uint64(32)) & m])


def _local_filters(bits: int, hashes):
    """Per partition: of each block of the filters, the offsets seen once, and those seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_positions(hashes(b.column(0).to_pylist()), bits) for b in C.parts(batches, 0)]
        if not sum(map(len, parts)):
            return
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        block = (at // BLOCK).astype(np.int32)
        once = (at % BLOCK).astype(np.uint16)
        ids, first = np.unique(block, return_index=True)
        ends = np.append(first[1:], len(at))
        rows = [(int(i), once[a:z].tobytes(), once[a:z][n[a:z] > 1].tobytes()) for i, a, z in zip(ids, first, ends, strict=True)]
        for k in range(0, len(rows), 4096):
            cut = list(zip(*rows[k : k + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cut[0], pa.int32()), pa.array(cut[1], pa.binary()), pa.array(cut[2], pa.binary())], ["block", "once", "twice"])

    return run


def _merge_block(group: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the once-seen filter of all partitions so far, and what it meets again."""
    once, twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
    for a, b in zip(group["once"], group["twice"], strict=True):
        new = np.frombuffer(a, np.uint16)
        twice[new[once[new]]] = True
        once[new] = True
        twice[np.frombuffer(b, np.uint16)] = True
    return pd.DataFrame({"block": [group["block"].iloc[0]], "twice": [np.packbits(twice).tobytes() if twice.any() else b""]})


def twice_seen(texts: DataFrame, hashes, bits: int) -> np.ndarray:
    """Packed bits of the twice-seen filter over hashes(texts), an array with each hash of a text once, of a column of texts.

    The result has `bits` bits, at most a parameter of the caller's.
    """
    local = texts.mapInArrow(_local_filters(bits, hashes), "block int, once binary, twice binary")
    merged = local.groupBy("block").applyInPandas(_merge_block, "block int, twice binary").where(F.length("twice") > 0)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["twice"], np.uint8)
    return out


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _positions(hashes, 8 * len(table))
    hit = ((table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)
    return hit[: len(hashes)] & hit[len(hashes) :]


def filter_bits(rows: int, per_row: int, most: int) -> int:
    """A power of two of at least per_row bits a row, between 2^20 and most."""
    return min(most, max(1 << 20, 1 << max(0, int(rows) * per_row - 1).bit_length()))


def deduped(docs: DataFrame, min_key: int = 10, bits_per_doc: int = 256, most_bits: int = 1 << 28) -> DataFrame:
    """_row (docs as a struct) and _k (n, dropped, kept): repeated lines stay only in the smallest doc_id.

    A text is split at \\n; null or empty text is one empty line. Keys of at least min_key code
    points found in two or more doc_ids lose all their lines but those of the smallest. Rows that
    share a doc_id are one document. All null doc_ids are one document that comes last. An empty table gives an
    empty table. Further columns, whatever their names, stay in _row. The filters' size follows the row count up
    to most_bits (32 MB), which bounds what is broadcast; beyond it more lines are shuffled.
    """
    texts = docs.select(C.id_or_last().alias("id"), C.text_or_empty().cast("binary").alias("text"))
    bits = filter_bits(docs.count(), bits_per_doc, most_bits)

    def keys_of(text: bytes) -> list[bytes]:
        return list({k for k in line_keys(text) if long_enough(k, min_key)})

    def hashes_of(texts: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for t in texts for k in keys_of(t)), np.uint64)

    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(texts.select("text"), hashes_of, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = keys_of(text)
                hit = in_filter(sent.value, np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                keys += [k for k, h in zip(own, hit.tolist(), strict=True) if h]
                ids += [i] * (len(keys) - len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    found = C.stage(texts.mapInArrow(suspects, "id long, key binary"), "lines")
    firsts = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    # staged, so that both sides of the join have an exchange of their own and a common line's rows can be split
    firsts = C.stage(firsts, "firsts")
    drops = found.join(firsts, "key").where("id > first").groupBy("id").agg(F.collect_set("key").alias("_drops"))
    rows = C.packed(docs).withColumn("_id", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(C.NO_ID)))
    joined = rows.join(drops.withColumnRenamed("id", "_id"), "_id", "left")

    @F.pandas_udf("n long, dropped long, kept binary")
    def keep(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, drops, strict=True):
            lines = t.split(b"\n")
            gone = set() if gone is None else set(gone)
            kept = [x for x in lines if x.strip(SPACES).lower() not in gone] if gone else lines
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept) if gone else t))
        return pd.DataFrame(out, columns=["n", "dropped", "kept"])

    done = joined.select("_row", keep(F.coalesce(F.col("_row.text").cast("string"), F.lit("")).cast("binary"), "_drops").alias("_k"))
    return done.select("_row", F.struct("_k.n", "_k.dropped", F.col("_k.kept").cast("string").alias("kept")).alias("_k"))


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept_text, as deduped() gives them; a column of docs of such a name gives way."""
    facts = {"n_lines": "_k.n", "n_dropped": "_k.dropped", "kept_text": "_k.kept"}
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in facts]
    return deduped(docs, **options).select(*own, *[F.col(c).alias(n) for n, c in facts.items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated lines; n_chars follows the text, all documents stay."""
    fresh = {"text": F.col("_k.kept"), "n_chars": F.when(F.col("_k.dropped") > 0, F.length("_k.kept").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return deduped(docs).select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = {
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.first < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.first IS NULL OR f.first >= l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY l.doc_id
""",
}
