"""Packing by cutting-stock column generation.

Documents become token ids; a document longer than a sequence is cut into whole sequences and a tail.
Lengths, rounded up to classes, form a histogram of at most 256 counts. Column generation solves the
linear program over patterns (how many pieces of each class share a sequence): a knapsack dynamic
program prices new patterns until none improves it. Rounded-down patterns take their share of the
pieces of each class, which carry a rank; the remainder, a bounded number of pieces, is
packed largest first. Only the histogram and the patterns are ever on the driver.
"""

from __future__ import annotations

import base64
import json
import os
import warnings
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LENGTH = 2048
CLASS = 8
END_ID = 1
#: Share by which the linear program's solution may exceed its bound.
GAP = 1e-3
TOKENIZER = "byte_bpe_50k.json"
#: Entries of a worker's memory of word pieces; the memory is emptied when full.
MEMORY = 600_000
#: Fixed value: the last Latin letter whose class, like those of all before it, no version of Unicode has changed.
LATIN = "\u024f"
_state: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Beside(Exception):
    """A text has white space beside a space: its words cannot be encoded one by one."""


class _Words(dict):
    """Ids of words, each after `before`; encodes a word when first asked for it."""

    def __init__(self, before: str, encode) -> None:
        super().__init__()
        self.before, self.encode = before, encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Beside
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = self.encode(self.before + word)
        return found


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary at a path as ranks of byte strings, if merging by rank gives the tokenizer's own ids; else None.

    Merging by rank joins any neighbours whose bytes make up a token, the tokenizer only pairs of its list. With
    ranks in the list's order, whatever stands between two cuts when a token is due has been merged by the lower
    ranks alone. So both agree on every text if each token's bytes, merged by the ranks below its own, end in
    just the pair the list has for it; that is held for every token here.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    of = byte_of()
    raw = lambda t: bytes(of[c] for c in t)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    listed = set()
    last = -1
    for pair in model["merges"]:
        a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
        rank = ranks.get(a + b, -1)
        if rank <= last or ranks.get(a, rank) >= rank and len(a) > 1 or ranks.get(b, rank) >= rank and len(b) > 1:
            return None
        now = [bytes([x]) for x in a + b]
        while True:
            due = min(((ranks.get(x + y, rank), k) for k, (x, y) in enumerate(zip(now, now[1:], strict=False))), default=(rank, 0))
            if due[0] >= rank:
                break
            now[due[1] : due[1] + 2] = [now[due[1]] + now[due[1] + 1]]
        if now != [a, b]:
            return None
        listed.add(a + b)
        last = rank
    return ranks if all(len(t) == 1 or t in listed for t in ranks) and len(ranks) == 256 + len(listed) else None


class Encoder:
    """Ids of whole texts by the tokenizer at a path, little-endian 32-bit, remembering single words.

    The byte-level pre-tokenizer always cuts before a space between two characters that are not white
    space, so such a text is the sequence of its words, each with its space. Words not yet known, and
    texts with other white space beside a space, are encoded by merge ranks, if any are given, which is
    several times as fast and gives the same ids (see merge_ranks). That holds where pre-tokenizers agree on classes of
    characters, up to LATIN; all else, and texts that spell a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_ranks = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.by_ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.known = _Words("", self.whole), _Words(" ", self.whole)

    def by_tokenizer(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def whole(self, text: str) -> bytes:
        if self.by_ranks is None or max(text, default="") > LATIN or any(s in text for s in self.special):
            return self.by_tokenizer(text)
        return array("I", self.by_ranks(text)).tobytes()

    def encode(self, text: str) -> bytes:
        head, *words = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.known.__getitem__, words))
        except _Beside:
            return self.whole(text)


def encoder(path: str, ranks: dict[bytes, int] | None = None) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path, ranks)
    return _state[path]


def _pieces(path: str, length: int, end_id: int, sent):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.parts(batches):
            own = encoder(path, sent.value)
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = own.encode(text) + end
                n = len(ids) // 4
                out += [(i, at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most value of classes 1..room (value[c - 1] each, size c) that fit in room, and how many of each."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for r in range(1, room + 1):
        got = best[r - 1 :: -1] + value[:r]
        c = int(np.argmax(got))
        best[r], last[r] = (got[c], c + 1) if got[c] > best[r - 1] else (best[r - 1], 0)
    count, r = np.zeros(room, int), room
    while r > 0:
        if last[r]:
            count[last[r] - 1] += 1
            r -= last[r]
        else:
            r -= 1
    return float(best[room]), count


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row exchange, in elementwise operations alone.

    A linear algebra library's threads can wait for ever in a process that has started a JVM, so the
    driver calls none.
    """
    n = len(a)
    m = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if m[p, k] == 0:
            raise ValueError("singular basis")
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        factor = m[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        m[rows] -= factor[rows, None] * m[k]
    return m[:, n:]


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x in elementwise operations."""
    return (a * x).sum(axis=1)


def solve(demand: np.ndarray, room: int, gap: float = GAP, most: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows: pieces of each class), how often each is used in the linear program's solution, and the gap reached.

    Ends when no pattern prices out, when the solution is within `gap` of the best bound (what the pieces fill, or what any round's duals
    gave), or after `most` rounds: then the gap reached is larger, the patterns are still whole and every piece is placed.
    """
    rows = np.flatnonzero(demand)
    need = demand[rows].astype(float)
    basis = np.diag(room // (rows + 1)).astype(float)
    bound, found = float((need * (rows + 1)).sum() / room), 1.0  # at least what the pieces fill
    for k in range(most):
        if k % 100 == 0:
            inverse = inverted(basis)
        used = np.maximum(times(inverse, need), 0)
        value = np.zeros(room)
        value[rows] = np.maximum(inverse.sum(axis=0), 0)
        worth, count = knapsack(value, room)
        column = count[rows]
        bound = max(bound, (need * value[rows]).sum() / max(worth, 1))
        found = 1 - bound / used.sum()
        if worth <= 1 + 1e-9 or found <= gap:
            break
        step = times(inverse, column)
        ratio = np.full(len(rows), np.inf)
        up = step > 1e-9
        ratio[up] = used[up] / step[up]
        out = int(np.argmin(ratio))
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= step[:, None] * pivot
        inverse[out] = pivot
    patterns = np.zeros((len(rows), room), int)
    patterns[:, rows] = basis.T.round().astype(int)
    return patterns, used, max(0.0, found)


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that place every piece of the histogram: rounded-down patterns, then largest first."""
    out: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    if left.any():
        patterns, used, reached = solve(demand, room)
        if reached > GAP:
            warnings.warn(f"the linear program ended {reached:.2%} above its bound", stacklevel=2)
        for pattern, x in zip(patterns, used, strict=True):
            uses = int(x + 1e-6)
            if pattern.any():
                uses = min(uses, int(np.min(left[pattern > 0] // pattern[pattern > 0])))
            if uses > 0:
                out.append((pattern, uses))
                left -= uses * pattern
    while left.any():
        pattern, free = np.zeros(room, int), room
        for c in np.flatnonzero(left)[::-1]:
            n = min(left[c], free // (c + 1))
            pattern[c] += n
            free -= n * (c + 1)
        times = int(np.min(left[pattern > 0] // pattern[pattern > 0]))
        out.append((pattern, times))
        left -= times * pattern
    return out


def assignment(plans: list[tuple[np.ndarray, int]], room: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Of each class: where each plan's ranks begin, its pieces a sequence, and its first sequence."""
    rank, sequence = np.zeros(room, np.int64), 0
    found: dict[int, list] = {}
    for pattern, times in plans:
        for c in np.flatnonzero(pattern):
            found.setdefault(int(c) + 1, []).append((int(rank[c]), int(pattern[c]), sequence))
            rank[c] += times * pattern[c]
        sequence += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in found.items()}, sequence


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, per_rank_group: int = 2_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are documents of the end id alone; a very long text is encoded whole and cut into full sequences and a tail. Rows are packed one by one, so
    repeated rows give repeated pieces; equal pieces are interchangeable. An empty table gives no pieces.
    """
    room = length // CLASS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    path = path or tokenizer_path()
    sent = docs.sparkSession.sparkContext.broadcast(_state.setdefault(("ranks", path), merge_ranks(path)))
    pieces = C.stage(texts.mapInArrow(_pieces(path, length, end_id, sent), schema), "pieces")
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / CLASS).cast("int"))
    histogram = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    demand = np.array([histogram.get(c, 0) for c in range(1, room + 1)], np.int64)
    table, _ = assignment(plan(demand, room), room)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    # ranks within a class: places of a hash group, after all rows of the groups before it
    groups = max(1, int(demand.sum()) // per_rank_group)
    classed = classed.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    sizes = classed.groupBy("_class", "_group").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("_class").orderBy("_group")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("_class", "_group").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "length"))
    ranked = classed.withColumn("_place", place).join(before, ["_class", "_group"]).withColumn("_rank", F.col("_before") + F.col("_place") - 1)

    @F.pandas_udf("long")
    def sequence(c: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(c), np.int64)
        c, rank = c.to_numpy(), rank.to_numpy()
        for k in np.unique(c):
            begins, each, first = sent.value[int(k)]
            own = c == k
            at = np.searchsorted(begins, rank[own], "right") - 1
            out[own] = first[at] + (rank[own] - begins[at]) // each[at]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence("_class", "_rank"))
    inside = Window.partitionBy("sequence_id").orderBy("_class", "_rank")
    offset = F.sum("length").over(inside) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that are left, each in its sequence."""
    return pack(docs)
