"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of lower-cased words. Running Karp-Rabin hashes of the
document's words find the seeds it shares with an item; seeds on one diagonal make up maximal
matches; the longest match whose words are all unmarked is marked as a tile, again and again, until
none of the least length is left. The share of the item that tiles cover does not depend on their
order, so reordered passages count in full.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .line_dedup import filter_bits, in_filter, twice_seen

LEAST_TILE = 5
COVERAGE = 0.5
#: Characters of test items that are sent to the executors; more are joined by their seeds.
BLOCK_CHARS = 16_000_000
#: Seed pairs of a document held at once.
PAIRS = 1_000_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows: each is the last one times the base, less the word that left, plus the new one."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + ids[k : k + n].astype(np.uint64)
    return out


def tiles(matches: list[tuple[int, int, int]], least: int, full: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles among maximal matches (start in item, start in document, length).

    The longest first; of equal ones the first in the item, then in the document. What is left of a
    match beside marked words competes again by its own length. With full, the item's words, it ends once fewer
    than a tile's are left.
    """
    heap = [(-n, j, i) for j, i, n in matches]
    heapq.heapify(heap)
    in_item, in_doc, out = set(), set(), []
    while heap and (full is None or full - len(in_item) >= least):
        n, j, i = heapq.heappop(heap)
        free = [j + k not in in_item and i + k not in in_doc for k in range(-n)]
        if all(free):
            out.append((j, i, -n))
            in_item.update(range(j, j - n))
            in_doc.update(range(i, i - n))
            continue
        k = 0
        while k < -n:
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(heap, (k - e, j + k, i + k))
            k = max(e, k + 1)
    return out


class Tests:
    """A block of test items, ready to be held against documents."""

    def __init__(self, items: list[tuple[int | None, str]], least: int) -> None:
        words = [tokens(t) for _, t in items]
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for x in words for w in x))}
        self.ids = [i for i, _ in items]
        self.words = [np.fromiter(map(self.vocab.get, x), np.int64, len(x)) for x in words]
        self.flat = np.concatenate([*self.words, np.zeros(0, np.int64)])
        self.begin = np.cumsum([0, *map(len, self.words)])[:-1]
        self.least = least
        hashes = [running_hashes(x, least) for x in self.words]
        seeds = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]

    def against(self, text: str) -> list[tuple[int, int, int, int]]:
        """(index of item, tiles, words covered, words) of each item that shares a seed with the text."""
        words = tokens(text)
        ids = np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))
        if len(ids) < self.least or not len(self.seeds):
            return []
        known = np.append(0, np.cumsum(ids > 0))
        start = np.flatnonzero(known[self.least :] - known[: -self.least] == self.least)
        if not len(start):
            return []
        h = running_hashes(ids, self.least)[start]
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        n = hi - lo
        # in blocks of a bounded number of seed pairs: repetitive texts make up very many
        ends = np.append(0, np.cumsum(n))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PAIRS), "right") - 1, len(n)))
        runs = [self._runs(ids, start[x:y], lo[x:y], n[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        if not sum(map(len, runs)):
            return []
        run = np.concatenate(runs)  # item, diagonal, start in document, seeds
        run = run[np.lexsort(run.T[[2, 1, 0]])]
        new = np.flatnonzero(np.append(True, (np.diff(run[:, 0]) != 0) | (np.diff(run[:, 1]) != 0) | (run[1:, 2] != run[:-1, 2] + run[:-1, 3])))
        item, shift, first = run[new, 0], run[new, 1], run[new, 2]
        length = np.add.reduceat(run[:, 3], new) + self.least - 1
        out = []
        for k in np.unique(item):
            own = item == k
            test = len(self.words[k])
            found = tiles(list(zip((first - shift)[own].tolist(), first[own].tolist(), length[own].tolist(), strict=True)), self.least, test)
            out.append((int(k), len(found), sum(x[2] for x in found), test))
        return out

    def _runs(self, ids: np.ndarray, start: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows (item, document less item place, place in document, seeds) of the seeds at these places that follow each other on a diagonal."""
        pick = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        i, j, item = np.repeat(start, n), self.at[pick], self.item[pick]
        same = np.ones(len(i), bool)
        for x in range(self.least):
            same &= ids[i + x] == self.flat[self.begin[item] + j + x]
        i, j, item = i[same], j[same], item[same]
        order = np.lexsort((i, i - j, item))
        i, shift, item = i[order], (i - j)[order], item[order]
        new = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(i) != 1))) if len(i) else np.zeros(0, np.int64)
        return np.stack([item[new], shift[new], i[new], np.diff(np.append(new, len(i)))], axis=1)


def _seeds(text: str, least: int) -> np.ndarray:
    """Distinct Karp-Rabin hashes of a text's windows of `least` words, the words taken by their own hashes."""
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens(text)), np.uint64)
    return np.unique(running_hashes(words, least))


def _seeds_of(texts: list[str], least: int) -> np.ndarray:
    # given twice, each is in the filter of what was seen twice
    return np.repeat(np.concatenate([*(_seeds(t, least) for t in texts), np.zeros(0, np.uint64)]), 2)


def _seed_rows(least: int, sent=None):
    """(seed, key) of each distinct seed of a text; with a filter only of those in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.parts(batches):
            found = [_seeds(t, least) for t in b.column(1).to_pylist()]
            if sent is not None:
                found = [x[in_filter(sent.value, x)] for x in found]
            key = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(key)], ["seed", "key"])

    return run


def _tiled_pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, item, text, test in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(key, item, n, c, m) for _, n, c, m in Tests([(None, test)], least).against(text)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "item", "n_tiles", "covered", "item_words"])

    return run


def held_pairs(docs: DataFrame, items: DataFrame, least: int, coverage: float, most_bits: int = 1 << 28) -> DataFrame:
    """key, item, n_tiles, covered, item_words of each pair covered to at least `coverage`; docs and items: key, text.

    For a benchmark that is too large to send. Seeds of the items make up a Bloom filter (at most most_bits); document seeds
    that pass it are joined with the items' seeds, and each pair that shares one is tiled by itself. A seed that very
    many documents hold is split by Spark, for both sides of its join are staged.
    """
    words = items.select("text")
    bits = filter_bits(items.count(), 4096, most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(words, lambda texts: _seeds_of(texts, least), bits))
    mine = C.stage(docs.select("key", "text").mapInArrow(_seed_rows(least, sent), "seed long, key long"), "seeds")
    theirs = C.stage(items.select("key", "text").mapInArrow(_seed_rows(least), "seed long, key long").withColumnRenamed("key", "item"), "seeds")
    pairs = C.stage(mine.join(theirs, "seed").select("key", "item").distinct(), "pairs")
    both = pairs.join(docs.select("key", "text"), "key").join(items.select(F.col("key").alias("item"), F.col("text").alias("test")), "item")
    tiled = both.select("key", "item", "text", "test").mapInArrow(_tiled_pairs(least), "key long, item long, n_tiles long, covered long, item_words long")
    return tiled.where(F.col("covered") >= F.col("item_words") * coverage)


def keyed_rows(df: DataFrame, name: str) -> DataFrame:
    """_row (all columns), key, text, staged, so that a row's key stays its own."""
    packed = C.packed(df)
    return C.stage(packed.select("_row", F.monotonically_increasing_id().alias("key"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text")), name)


def small(benchmark: DataFrame, most_chars: int) -> bool:
    """Whether the items' texts are few enough to be sent to the executors."""
    return (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) <= most_chars


def collected(benchmark: DataFrame) -> list[tuple[int | None, str]]:
    """The items of a benchmark whose size was checked, in order."""
    return [(r["item_id"], r["text"] or "") for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, least_tile: int = LEAST_TILE, coverage: float = COVERAGE, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, item_words, coverage of each pair covered to at least `coverage`.

    Null and empty texts, and items of under least_tile words, match nothing. Each row of docs is
    judged alone, so rows with one doc_id give their own pairs; repeated items are items of their own. Very long texts are
    held as one array of words. Of equal matches the first in the item, then in the document, is marked. Empty tables give no pairs.
    A benchmark of at most most_chars characters goes to the executors, and documents are read once, without a shuffle; a larger one is joined by its seeds.
    """
    if not small(benchmark, most_chars):
        rows, items = keyed_rows(docs, "docs"), keyed_rows(benchmark, "items")
        found = held_pairs(rows, items, least_tile, coverage)
        ids = found.join(rows.select("key", F.col("_row.doc_id").cast("long").alias("doc_id")), "key").join(items.select(F.col("key").alias("item"), F.col("_row.item_id").cast("long").alias("item_id")), "item")
        return ids.select("doc_id", "item_id", "n_tiles", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, n_tiles long, covered long, item_words long, coverage double"
    sent = docs.sparkSession.sparkContext.broadcast(Tests(collected(benchmark), least_tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found += [(i, sent.value.ids[k], n, c, m, c / m) for k, n, c, m in sent.value.against(text) if c >= coverage * m]
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage"])

    return rows.mapInArrow(run, schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def _holds(sent):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([any(c >= COVERAGE * m for _, _, c, m in sent.value.against(t)) for t in texts], dtype=bool)

    return holds


def clean_rows(docs: DataFrame, benchmark: DataFrame, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no test item."""
    if not small(benchmark, most_chars):
        rows = keyed_rows(docs, "docs")
        gone = held_pairs(rows, keyed_rows(benchmark, "items"), LEAST_TILE, COVERAGE).select("key").distinct()
        return rows.join(gone, "key", "left_anti").select("_row.*")
    holds = _holds(docs.sparkSession.sparkContext.broadcast(Tests(collected(benchmark), LEAST_TILE)))
    return C.packed(docs).where(~holds(F.coalesce(F.col("_row.text").cast("string"), F.lit("")))).select("_row.*")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go. No shuffle while the benchmark is small enough to send: each text is judged in place."""
    return clean_rows(docs, C.read(spark, sf_dir, "benchmark"))
