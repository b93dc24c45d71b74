"""Spelling variants of the words of a corpus: words one edit apart, and the form that each goes back to.

Two words one edit apart agree in a half: either the first half of the one begins the other, or the second half ends it. Words meet by that half.
Each task holds minimal acyclic automata of its words, read forward and backward, whose transitions carry
the number of words before them, so that a path's sum is the word's number. A search walks the exact half, then completes the word with one error.
A pair found forward is not counted backward, so sums over directions need no list of pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run loses a character where this divides its hash.
DROPPED = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Words an automaton has at most; a half with more is split. Distinct words a task counts before it hands them on.
TILE, HELD = 50_000, 200_000
MOST_ROUNDS = 64


def variant(run: str, start: int) -> str:
    """The run, or the run without one character where its hash, continued from start, says so."""
    h = zlib.crc32(run.encode(), start)
    if h % DROPPED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for b in C.parts(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for own, n in Counter(RUN.findall(text.lower().decode())).items():
                    word = variant(own, start)
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) >= HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of docs(doc_id, text) of so many code points and occurrences. Null texts have none; a null doc_id hashes as an empty one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), C.text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(_count(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of distinct words in code-point order; next(state) maps a character to (state, words before)."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        #: of the word before: of each depth the transitions so far, and whether a word ends there
        open_: list[list] = [[[], False]]

        def closed(node: list) -> int:
            key = (node[1], tuple(node[0]))
            found = known.get(key)
            if found is None:
                known[key] = found = len(self.next)
                below, before = {}, int(node[1])
                for c, child in node[0]:
                    below[c] = (child, before)
                    before += self.size[child]
                self.next.append(below)
                self.final.append(node[1])
                self.size.append(before)
            return found

        last = ""
        for word in [*words, ""]:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for k in range(len(last), same, -1):
                open_[k - 1][0].append((last[k - 1], closed(open_.pop())))
            open_ += [[[], False] for _ in range(len(word) - same)]
            open_[-1][1] |= bool(word)
            last = word
        self.start = closed(open_[0])

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """The state and the sum after a text, from a state and a sum."""
        for c in text:
            found = self.next[state].get(c)
            if found is None:
                return None
            state, number = found[0], number + found[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The word's place in order from 0; None if it is not there."""
        found = self.walk(self.start, 0, word)
        return found[1] if found and self.final[found[0]] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that are one edit away and begin like the word's first `exact` characters."""
        found: set[int] = set()
        here = self.walk(self.start, 0, word[:exact])
        for k in range(exact, len(word) + 1):
            if here is None:
                break
            state, number = here
            rest = word[k:]
            tries = [(state, number, rest[1:])] if rest else []  # without this character
            for c, (after, before) in self.next[state].items():
                tries.append((after, number + before, rest))  # with one more
                if rest and c != rest[0]:
                    tries.append((after, number + before, rest[1:]))  # with another
            for s, n, text in tries:
                end = self.walk(s, n, text)
                if end is not None and self.final[end[0]]:
                    found.add(end[1])
            here = self.walk(state, number, rest[0]) if rest else None
        return found


def halves(word: str) -> int:
    """Characters of the first half; the second has as many, or one more."""
    return len(word) // 2


class _Group:
    """The words that are there in a group, and answers to those that ask. Backward groups hold words from their ends on."""

    def __init__(self, forward: bool) -> None:
        self.forward, self.there, self.own = forward, [], None

    def add(self, word: str, n: int) -> None:
        self.there.append((word, n))

    def answer(self, word: str) -> tuple[str, int, int, str] | None:
        """The word, how many near ones are there, and n and text of the best of them."""
        if self.own is None:
            self.there.sort()
            self.own = Automaton([w for w, _ in self.there])
        half = halves(word) if self.forward else len(word) - halves(word)
        found = self.own.near(word, half)
        if not self.forward:  # those that begin with the first half too are found forward
            found = {k for k in found if not self.there[k][0].endswith(word[half:])}
        if not found:
            return None
        turned = (lambda w: w) if self.forward else (lambda w: w[::-1])
        n, best = min((-self.there[k][1], turned(self.there[k][0])) for k in found)
        return turned(word), len(found), -n, best


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the words that ask, group by group (a half, a length, a tile).

    Rows are forward, group, tile, absent, text, n, asks, in this order: those that are there come first, so
    a task holds one tile of words and their automaton, and those that only ask pass by.
    """
    key: tuple | None = None
    out: list[tuple] = []
    waiting: list[str] = []
    group = _Group(True)

    def answered(words: list[str]) -> None:
        out.extend(x for x in map(group.answer, words) if x)
        words.clear()

    def taken() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

    for b in batches:
        for forward, name, tile, absent, text, n, asks in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (forward, name, tile) != key:
                answered(waiting)
                key, group = (forward, name, tile), _Group(forward)
            if absent:
                answered(waiting)
                answered([text])
            else:
                group.add(text, n)
                if asks:
                    waiting.append(text)
        if out:
            yield taken()
    answered(waiting)
    yield taken()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, form_n, form (of largest n, then first in code-point order) of each of words(word, n) that has near ones.

    words are distinct and staged. A word asks where its own half and length are, and is there for all lengths that can be near: a group
    has all that can be near by that half. A group with more than a tile of words is dealt to tiles, and its words ask in each.
    """
    text, size = F.col("text"), F.length("word")
    both = words.select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("forward"), F.col("word").alias("text")), F.struct(F.lit(False).alias("forward"), F.reverse("word").alias("text")))).alias("d")).select("word", "n", "d.*")
    asked = F.explode(F.sequence(size - 1, size + 1)).alias("asked")
    # the exact part: forward half the asking length, backward the rest of it
    half = F.when(F.col("forward"), F.expr("asked div 2")).otherwise(F.col("asked") - F.expr("asked div 2"))
    dealt = both.select("forward", "text", "n", size.alias("size"), asked).withColumn("group", F.struct(F.substring(text, F.lit(1), half).alias("half"), "asked"))
    dealt = dealt.where(F.length("group.half") == half).withColumn("asks", F.col("asked") == F.col("size"))
    counts = C.stage(dealt.groupBy("forward", "group").agg(F.count(F.lit(1)).alias("many"), F.max("asks").alias("asked")).where("asked AND many > 1").select("forward", "group", F.ceil(F.col("many") / tile).cast("int").alias("tiles")), "groups")
    placed = dealt.join(counts, ["forward", "group"]).withColumn("own", F.pmod(F.xxhash64("text"), F.col("tiles")).cast("int"))
    tiles = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
    rows = placed.withColumn("tile", F.explode(tiles)).select("forward", "group", "tile", "text", "n", "asks", (F.col("tile") != F.col("own")).alias("absent"))
    keyed = rows.select("forward", F.concat_ws(":", "group.asked", "group.half").alias("group"), "tile", "absent", "text", "n", "asks")
    found = keyed.repartition("forward", "group", "tile").sortWithinPartitions("forward", "group", "tile", "absent").mapInArrow(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each row of forms(word, form): the last word that following forms leads to. Each round doubles the steps taken."""
    now = C.stage(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")), "roots")
    for _ in range(MOST_ROUNDS):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        after = C.stage(now.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNull().alias("ended")), "roots")
        left = after.where("NOT ended").limit(1).count()
        C.unstage(now)
        now = after
        if not left:
            return now.select("word", "root")
    raise RuntimeError("forms go in a circle")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, root, n_near, form_n of words(word, n).

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties:
    smallest in code-point order), if that n is at least `ratio` times its own; the root is the last of its forms, or the word
    itself. Words are distinct texts; a null word is left out. No words give an empty table. Other columns are not read.
    """
    own = C.stage(words.where("word IS NOT NULL").select("word", "n"), "words")
    near = C.stage(near_words(own), "near")
    kept = F.col("form_n") >= ratio * F.col("n")
    all_ = C.stage(own.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(all_.where("form IS NOT NULL"))
    return all_.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(C.read(spark, sf_dir, "documents").select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE: dict[str, str] = {}
