"""Words of text that is written without spaces, by a lexicon learned from the text itself.

Candidates are the short runs of characters that are frequent, that hold together (they occur far more often than their parts by chance), and
that have many different neighbours on both sides. A text is cut along the most probable path through the graph of its
words; stretches of single characters that are not words are cut by the most probable sequence of tags (begin, middle, end, single).
Counting, entropies and re-estimation are Spark jobs; what is sent to tasks is bounded: so many words, and the characters of a script.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from ..sources import io

#: Characters of a word at most, words of a lexicon at most, and rounds of re-estimation.
LONGEST, MOST_WORDS, ROUNDS = 4, 200_000, 2
#: Of a candidate: occurrences, entropy of its neighbours (the lesser side) and cohesion, at least.
LEAST_COUNT, LEAST_ENTROPY, LEAST_COHESION = 5, 0.7, 1.5
#: Distinct runs a task counts before it hands them on.
HELD = 400_000
#: Characters that a task works on at a time, and cells of a table of words of one length; longer tables are searched.
CHARS, CELLS = 2_000_000, 4_000_000
#: Logarithms of words are multiples of this: their sums are exact, so equal paths are equal wherever a sum begins. What is no word is worth so much.
GRAIN, NO_WORD = 2.0**-30, -(1 << 60)
#: Characters of a stretch that is parted, if it can be.
LONG = 256
#: Characters of a text whose tags are kept at most.
SHORT = 16
#: Stand before and after a stretch, so that its ends count as neighbours.
BEFORE, AFTER = "\x02", "\x03"
STRETCH = re.compile(f"[{CJK}]+")
LEAST_CJK, MOST_CJK = (int(c.removeprefix(r"\u"), 16) for c in CJK.split("-"))
OTHER = re.compile(r"[a-z0-9’'_\-]+")
#: By code point: whether OTHER has it. Two capitals beside A to Z have a lower case, or a part of it, that OTHER has.
OTHER_CODES = np.array([bool(OTHER.fullmatch(chr(c))) for c in range(0x2100)])
KELVIN, DOTTED = "\u212a", "\u0130"
TAGS = "BMES"
#: Tags that may follow a tag.
AFTER_TAG = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


@dataclass(frozen=True)
class Lexicon:
    """Logarithms of probabilities: words, and of tags their starts, steps and characters."""

    words: dict[str, float]
    unknown: float
    start: dict[str, float]
    step: dict[str, float]
    emit: dict[str, float]
    rare: dict[str, float]
    longest: int


def path(text: str, own: Lexicon) -> list[str]:
    """The most probable cut of a stretch into words and unknown single characters; of equals that with the longest first word."""
    n = len(text)
    best, size = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = own.words.get(text[i], own.unknown) + best[i + 1]
        for m in range(2, min(own.longest, n - i) + 1):
            p = own.words.get(text[i : i + m])
            if p is not None and p + best[i + m] >= best[i]:
                best[i], size[i] = p + best[i + m], m
    out, i = [], 0
    while i < n:
        out.append(text[i : i + size[i]])
        i += size[i]
    return out


def tagged(text: str, own: Lexicon) -> list[str]:
    """The words of the most probable tags of a stretch, which starts with B or S and ends with E or S."""
    emit = lambda t, c: own.emit.get(t + c, own.rare[t])
    score = {t: own.start[t] + emit(t, text[0]) for t in "BS"}
    back: list[dict[str, str]] = []
    for c in text[1:]:
        came: dict[str, str] = {}
        after: dict[str, float] = {}
        for t in TAGS:
            p, a = max(((score[a] + own.step[a + t], a) for a in score if t in AFTER_TAG[a]), default=(None, ""))
            if p is not None:
                after[t], came[t] = p + emit(t, c), a
        score = after
        back.append(came)
    t = max((x for x in score if x in "ES"), key=lambda x: (score[x], x), default="S")
    tags = [t]
    for came in reversed(back):
        t = came[t]
        tags.append(t)
    out, word = [], ""
    for c, t in zip(text, reversed(tags), strict=True):
        word += c
        if t in "ES":
            out.append(word)
            word = ""
    return out


def cut(text: str, own: Lexicon) -> list[str]:
    """The words of a stretch: along the most probable path; single characters in a row are tagged anew if one of them is no word."""
    out: list[str] = []
    loose = ""
    for word in [*path(text, own), ""]:
        if len(word) == 1:
            loose += word
            continue
        if len(loose) > 1 and any(c not in own.words for c in loose):
            out += tagged(loose, own)
        else:
            out += loose
        loose = ""
        if word:
            out.append(word)
    return out


def _laid(stretches: list[str]) -> np.ndarray:
    """Code points of all stretches with a zero after each."""
    return np.frombuffer("\0".join([*stretches, ""]).encode("utf-32-le"), np.uint32)


def _bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch begins, and the place after its end: stretches stand between zeros."""
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = code != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _within(code: np.ndarray) -> np.ndarray:
    """Code points with zeros for all that is in no stretch."""
    return np.where(code - np.uint32(LEAST_CJK) <= np.uint32(MOST_CJK - LEAST_CJK), code, np.uint32(0))


def _keys(ids: np.ndarray, at: np.ndarray, base: int, m: int) -> np.ndarray:
    """The runs of m ids that begin at the places, as numbers."""
    key = ids[at].astype(np.int64)
    for k in range(1, m):
        key = key * base + ids[at + k]
    return key


def _spelled(keys: np.ndarray, base: int, m: int, letters: np.ndarray) -> list[str]:
    """The runs of m letters that the numbers stand for."""
    digits = np.empty((len(keys), m), np.uint32)
    for k in range(m - 1, -1, -1):
        keys, d = np.divmod(keys, base)
        digits[:, k] = letters[d]
    flat = digits.tobytes().decode("utf-32-le")
    return [flat[i : i + m] for i in range(0, len(flat), m)]


def _least_ids(base: int) -> type:
    return np.uint8 if base <= 1 << 8 else np.uint16 if base <= 1 << 16 else np.uint32


class Paths:
    """path for many stretches at a time: all of them step back from their ends together, the longest first, so that each step is over plain slices.

    Worths are whole numbers of GRAIN with the length of the word in their lowest bits: the greatest is the best, and of equals the longest.
    """

    def __init__(self, own: Lexicon) -> None:
        self.own = own
        self.longest = max(1, own.longest)
        self.bits = self.longest.bit_length()
        used = sorted({ord(c) for w in own.words for c in w})
        self.letters = np.array([0, *used], np.uint32)
        self.base = len(self.letters)
        self.of = np.zeros(max(used, default=0) + 2, _least_ids(self.base))
        self.of[self.letters] = np.arange(self.base)
        self.single = np.array([chr(c) in own.words for c in self.letters.tolist()])
        self.seen: dict[str, np.ndarray] = {}
        self.fits = self.base**self.longest < 2**62 and self.longest < 256
        self.tables = {}
        for m in range(1, self.longest + 1) if self.fits else ():
            words = [w for w in own.words if len(w) == m]
            ids = self.of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
            keys = _keys(ids, np.arange(0, len(ids), m), self.base, m)
            worth = np.array([self._worth(own.words[w], m) for w in words], np.int64)
            if self.base**m <= CELLS:
                dense = np.full(self.base**m, self._worth(own.unknown, 1) if m == 1 else NO_WORD)
                dense[keys] = worth
                self.tables[m] = (None, dense)
            else:
                order = np.argsort(keys)
                self.tables[m] = (keys[order], worth[order])

    def _worth(self, log: float, m: int) -> int:
        return (round(log / GRAIN) << self.bits) + m

    def _worths(self, keys: np.ndarray, m: int) -> np.ndarray:
        known, worth = self.tables[m]
        if known is None:
            return worth.take(keys)
        other = self._worth(self.own.unknown, 1) if m == 1 else NO_WORD
        if not len(known):
            return np.full(len(keys), other)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, worth[at], other)

    def ids(self, code: np.ndarray) -> np.ndarray:
        return self.of.take(code, mode="clip")

    def _parted(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Long stretches parted wherever no word reaches across: the paths of the parts are the path of the whole."""
        begins, ends = [begin], [end]
        for k in np.flatnonzero(end - begin > LONG).tolist():
            own = ids[begin[k] : end[k]].astype(np.int64)
            crossed = np.zeros(len(own), bool)
            key = own
            for m in range(2, self.longest + 1):
                key = key[:-1] * self.base + own[m - 1 :]
                known = self._worths(key, m) > NO_WORD
                for i in range(1, m):
                    crossed[i : i + len(key)] |= known
            free = np.flatnonzero(~crossed[1:]) + 1 + begin[k]
            begins.append(free)
            ends.append(free)
        if len(begins) == 1:
            return begin, end
        return np.sort(np.concatenate(begins)), np.sort(np.concatenate(ends))

    def sizes(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The length of the word where one begins on the paths of the stretches, and 0 elsewhere."""
        out = np.zeros(len(ids), np.uint8)
        begin, end = self._parted(ids, begin, end)
        if not len(begin):
            return out
        lengths = end - begin
        most = int(lengths.max())
        order = np.argsort((most - lengths).astype(_least_ids(most + 1)), kind="stable")
        last = end[order]
        # so many have a character at each distance from the end
        having = [0, *(len(begin) - np.cumsum(np.bincount(lengths, minlength=most + 1)[:-1])).tolist(), 0]
        low = (1 << self.bits) - 1
        runs: list[np.ndarray] = []
        bests = [np.zeros(len(last), np.int64)]
        taken: list[np.ndarray] = []
        for j in range(1, most + 1):
            n = having[j]
            c = ids.take(last[:n] - j).astype(np.int64)
            runs = [c, *(c * self.base**m + r[:n] for m, r in enumerate(runs[: self.longest - 1], 1))]
            best = self._worths(c, 1)
            best += bests[0][:n]
            for m in range(2, len(runs) + 1):
                other = self._worths(runs[m - 1], m)
                other += bests[m - 1][:n]
                np.maximum(best, other, out=best)
            size = best & low
            best -= size
            taken.append(size.astype(np.uint8))
            bests = [best, *bests[: self.longest - 1]]
            if j % LONG == 0:  # only differences count; sums stay small
                bests = [b[:n] - best for b in bests]
        later: list[np.ndarray] = []
        for j in range(most, 0, -1):
            begun = np.zeros(having[j], bool)
            begun[having[j + 1] :] = True
            for m, own in enumerate(later, 1):
                begun[: len(own)] |= own == m
            own = taken[j - 1] * begun
            out[last[: having[j]] - j] = own
            later = [own, *later[: self.longest - 1]]
        return out

    def counted(self, code: np.ndarray) -> Iterator[tuple[list[str], list[int]]]:
        """Words on the paths of stretches laid out between zeros, and how often they are there."""
        ids = self.ids(code)
        size = self.sizes(ids, *_bounds(code))
        at = code[size == 1]  # also characters that no word has
        n = np.bincount(at) if len(at) else np.zeros(0, np.int64)
        found = np.flatnonzero(n)
        yield [chr(c) for c in found.tolist()], n[found].tolist()
        for m in range(2, self.longest + 1):
            keys = _keys(ids, np.flatnonzero(size == m), self.base, m)
            if self.base**m <= CELLS:
                n = np.bincount(keys, minlength=1)
                keys = np.flatnonzero(n)
                n = n[keys]
            else:
                keys, n = np.unique(keys, return_counts=True)
            yield _spelled(keys, self.base, m, self.letters), n.tolist()

    def counts(self, stretches: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Words on the paths and how often they are there."""
        if self.fits:
            yield from self.counted(_laid(stretches))
        else:
            found = Counter(w for s in stretches for w in path(s, self.own))
            yield list(found), list(found.values())

    def starts(self, code: np.ndarray) -> np.ndarray:
        """Whether a word that cut gives begins at each place of stretches laid out between zeros."""
        begin, end = _bounds(code)
        if not self.fits:
            out = np.zeros(len(code), bool)
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                out[b + _begins(cut(_text(code[b:e]), self.own))] = True
            return out
        ids = self.ids(code)
        size = self.sizes(ids, begin, end)
        out = size > 0
        # single characters in a row are tagged anew if one of them is no word
        one = np.zeros(len(code) + 2, bool)
        one[1:-1] = size == 1
        edges = np.flatnonzero(one[1:] != one[:-1])
        begin, end = edges[::2], edges[1::2]
        loose = np.unique(np.searchsorted(end, np.flatnonzero(one[1:-1] & ~self.single[ids]), "right"))
        loose = loose[end[loose] - begin[loose] > 1]
        for b, e in zip(begin[loose].tolist(), end[loose].tolist(), strict=True):
            out[b:e] = False
            out[b + self._tagged(_text(code[b:e]))] = True
        return out

    def _tagged(self, text: str) -> np.ndarray:
        """Where the words of tagged begin; short texts come again and again."""
        found = self.seen.get(text)
        if found is None:
            found = _begins(tagged(text, self.own))
            if len(text) <= SHORT and len(self.seen) < HELD:
                self.seen[text] = found
        return found

    def cuts(self, stretches: list[str]) -> list[list[str]]:
        """What cut gives for each stretch."""
        code = _laid(stretches)
        at = np.flatnonzero(self.starts(code))
        whole = _text(code)
        out, a = [], 0
        for s, k in zip(stretches, np.searchsorted(at, np.flatnonzero(code == 0)).tolist(), strict=True):
            own = at[a:k].tolist()
            out.append([whole[i:j] for i, j in zip(own, [*own[1:], own[0] + len(s)], strict=True)] if own else [])
            a = k
        return out


def _text(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le")


def _begins(words: list[str]) -> np.ndarray:
    return np.cumsum([0, *map(len, words)])[:-1]


class Runs:
    """How often runs of up to longest + 1 characters are in the stretches added, ends marked: the longest are sorted, the shorter are what they begin with."""

    def __init__(self, longest: int) -> None:
        self.most = longest + 1
        self.letters = np.zeros(0, np.int64)
        self.keys = self.n = np.zeros(0, np.int64)

    def add(self, code: np.ndarray) -> Iterator[tuple[list[str], list[int]]]:
        """Take up stretches laid out between zeros; yields what was held if that cannot be held on."""
        begin, end = _bounds(code)
        if not len(begin):
            return
        size = end - begin
        first = np.cumsum(size + 3) - size - 3
        laid = np.zeros(first[-1] + size[-1] + 3 + self.most, np.uint32)
        inner = np.zeros(len(laid), bool)
        inner[: -self.most] = True
        inner[first] = inner[first + size + 1] = inner[first + size + 2] = False
        laid[inner] = code[code != 0]
        laid[first], laid[first + size + 1] = ord(BEFORE), ord(AFTER)
        seen = np.zeros(int(laid.max()) + 1, bool)
        seen[laid] = True
        letters = np.flatnonzero(seen)
        base = len(letters)
        if base**self.most >= 2**62:
            whole = (BEFORE + _text(code[b:e]) + AFTER for b, e in zip(begin, end, strict=True))
            found = Counter(s[i : i + m] for s in whole for m in range(1, self.most + 1) for i in range(len(s) - m + 1))
            yield list(found), list(found.values())
            return
        if not np.array_equal(letters, self.letters):
            yield from self.out()
            self.letters = letters
        ids = (np.cumsum(seen) - 1).astype(np.int32 if base**self.most < 2**31 else np.int64)[laid]
        key = ids[: -self.most]
        for k in range(1, self.most):
            key = key * ids.dtype.type(base) + ids[k : k - self.most]
        key.sort()
        key = key[np.searchsorted(key, base ** (self.most - 1)) :]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys, n = key[at].astype(np.int64), np.diff(np.append(at, len(key)))
        if len(self.keys):
            keys, n = np.append(self.keys, keys), np.append(self.n, n)
            order = np.argsort(keys, kind="stable")
            keys, n = _merged(keys[order], n[order])
        self.keys, self.n = keys, n
        if len(keys) >= HELD:
            yield from self.out()

    def out(self) -> Iterator[tuple[list[str], list[int]]]:
        """Runs and how often they are there, which are held no longer."""
        base, keys, n = len(self.letters), self.keys, self.n
        self.keys = self.n = np.zeros(0, np.int64)
        for m in range(self.most, 0, -1) if len(keys) else ():
            whole, rest = np.ones(len(keys), bool), keys
            for _ in range(m):  # a zero is the end of a stretch
                rest, d = np.divmod(rest, base)
                whole &= d > 0
            yield _spelled(keys[whole], base, m, self.letters.astype(np.uint32)), n[whole].tolist()
            keys, n = _merged(keys // base, n)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, and the sums of n."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(n, at)


def _run_counts(stretches: list[str], longest: int) -> Iterator[tuple[list[str], list[int]]]:
    """Runs of up to longest + 1 characters of all stretches, ends marked, and how often they are there."""
    runs = Runs(longest)
    yield from runs.add(_laid(stretches))
    yield from runs.out()


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS characters."""
    a = n = 0
    for z, t in enumerate(texts, 1):
        n += len(t or "")
        if n >= CHARS or z == len(texts):
            yield a, z
            a, n = z, 0


def _counted(texts: DataFrame, counter) -> DataFrame:
    """word, n over all texts(text) of what add(code) and at last out() of a counter give for many stretches: lists of words and of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()

        def out(parts) -> Iterator[pa.RecordBatch]:
            for words, n in parts:
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for b in batches:
            some = b.column(0).to_pylist()
            for a, z in portions(some):
                yield from out(own.add(_within(_laid([t or "" for t in some[a:z]]))))
        yield from out(own.out())

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _entropy(counts: DataFrame, word, out: str) -> DataFrame:
    """word and the entropy of what stands beside it, from the counts of the runs that are one character longer."""
    n = F.sum("n").cast("double")
    return counts.groupBy(word.alias("word")).agg((F.log(n) - F.sum(F.col("n") * F.log("n")) / n).alias(out))


def candidates(texts: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, entropy: float = LEAST_ENTROPY, cohesion: float = LEAST_COHESION) -> DataFrame:
    """word, n of single characters, and of runs of texts(text) that pass all three tests. Null texts have none.

    Cohesion is the least, over all cuts in two, of the log of how much more often the run occurs than its parts would together by chance.
    """

    counts = io.written(_counted(texts, lambda: Runs(longest)), "runs")
    inner = counts.where(~F.col("word").contains(BEFORE) & ~F.col("word").contains(AFTER))
    size = F.length("word")
    total = inner.where(size == 1).agg(F.sum("n")).first()[0] or 1
    own = inner.where((size > 1) & (size <= longest) & (F.col("n") >= least))
    longer = counts.where(size > 1)
    right = _entropy(longer, F.expr("substring(word, 1, length(word) - 1)"), "right")
    left = _entropy(longer, F.expr("substring(word, 2)"), "left")
    free = io.written(own.join(right, "word").join(left, "word").where(F.least("left", "right") >= entropy).select("word", "n"), "free")
    parts = free.select("word", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = parts.select("word", "n", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    known = inner.where(size < longest)
    with_a = parts.join(known.select(F.col("word").alias("a"), F.col("n").alias("na")), "a")
    with_b = with_a.join(known.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    held = with_b.groupBy("word", "n").agg(F.min(F.log(F.col("n") * F.lit(float(total)) / F.col("na") / F.col("nb"))).alias("held"))
    return held.where(F.col("held") >= cohesion).select("word", "n").unionByName(inner.where(size == 1))


def lexicon(words: DataFrame, most: int = MOST_WORDS) -> Lexicon:
    """The most frequent of words(word, n), at most so many, and the tags' probabilities from them, with one more of each allowed step."""
    kept = words.where("n > 0").orderBy(F.desc("n"), "word").limit(most).toArrow()
    found = dict(zip(kept["word"].to_pylist(), kept["n"].to_pylist(), strict=True))
    total = sum(found.values()) or 1
    single = sum(n for w, n in found.items() if len(w) == 1)
    several = total - single
    inside = sum(n * (len(w) - 2) for w, n in found.items() if len(w) > 1)
    log = lambda a, b: math.log(a / b)
    start = {"B": log(several + 1, total + 2), "S": log(single + 1, total + 2)}
    further = {"M": log(inside + 1, inside + several + 2), "E": log(several + 1, inside + several + 2)}
    step = {a + t: (start if t in "BS" else further)[t] for a in TAGS for t in AFTER_TAG[a]}
    seen: dict[str, Counter[str]] = {t: Counter() for t in TAGS}
    for w, n in found.items():
        for c, t in zip(w, "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E", strict=True):
            seen[t][c] += n
    sums = {t: sum(c.values()) + len(c) + 1 for t, c in seen.items()}
    emit = {t + c: log(n + 1, sums[t]) for t, own in seen.items() for c, n in own.items()}
    rare = {t: log(1, sums[t]) for t in TAGS}
    even = lambda a, b: round(log(a, b) / GRAIN) * GRAIN
    return Lexicon({w: even(n, total) for w, n in found.items()}, even(1, 2 * total), start, step, emit, rare, max(map(len, found), default=1))


_PATHS: dict[int, Paths] = {}


def paths_of(sent) -> Paths:
    """The tables of a lexicon that was broadcast, made once in each worker for the lexicon in use."""
    if sent.value is not getattr(_PATHS.get(0), "own", None):
        _PATHS[0] = Paths(sent.value)
    return _PATHS[0]


class Words:
    """How often words are on the best paths of the stretches added, by a lexicon that was broadcast."""

    def __init__(self, sent) -> None:
        self.paths = paths_of(sent)
        self.seen: Counter[str] = Counter()

    def add(self, code: np.ndarray) -> Iterator[tuple[list[str], list[int]]]:
        parts = self.paths.counted(code) if self.paths.fits else self.paths.counts(STRETCH.findall(_text(code)))
        for words, n in parts:
            self.seen.update(dict(zip(words, n, strict=True)))
        if len(self.seen) >= HELD:
            yield from self.out()

    def out(self) -> Iterator[tuple[list[str], list[int]]]:
        yield list(self.seen), list(self.seen.values())
        self.seen.clear()


def learn(texts: DataFrame, rounds: int = ROUNDS, most: int = MOST_WORDS, **limits: float) -> Lexicon:
    """A lexicon of texts(text): candidates, whose counts are then those of the words on the paths, so many times over.

    Single characters that never stand alone on a path keep no count of their own, and are unknown. The texts are read rounds + 1 times.
    """
    own = lexicon(candidates(texts, **limits), most)
    for _ in range(rounds):
        sent = texts.sparkSession.sparkContext.broadcast(own)
        own = lexicon(_counted(texts, lambda sent=sent: Words(sent)), most)
    return own


def tokens(text: str, own: Lexicon) -> list[str]:
    """The words of all stretches of a text, in order, then the lower-cased runs of Latin letters and digits."""
    return [w for s in STRETCH.findall(text) for w in cut(s, own)] + OTHER.findall(text.lower())


def _others(code: np.ndarray) -> np.ndarray:
    """Code points in lower case with zeros for all that is in no run of Latin letters and digits."""
    lower = np.where((code >= ord("A")) & (code <= ord("Z")), code + np.uint32(32), np.where(code == ord(KELVIN), np.uint32(ord("k")), code))
    return np.where(OTHER_CODES.take(lower, mode="clip"), lower, np.uint32(0))


def _tokens(texts: list[str | None], paths: Paths) -> tuple[np.ndarray, pa.StringArray]:
    """What tokens gives for each text: how many, and all of them one after another."""
    # the one character that is two in lower case, of which one is Latin
    texts = [(t or "").replace(DOTTED, DOTTED.lower()) for t in texts]
    code = _laid(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    own, other = _within(code), _others(code)
    begun = paths.starts(own)
    at, also = np.flatnonzero(own), np.flatnonzero(other)
    each = _each(np.flatnonzero(begun), ends)
    flat, begun = own[at], begun[at]
    if len(also):
        starts = other[also - 1] == 0
        starts[0] |= also[0] == 0
        each += _each(also[starts], ends)
        # after the words of the same text, before those of the next
        n, m = _each(at, ends), _each(also, ends)
        to = np.arange(len(at)) + np.repeat(np.cumsum(m) - m, n)
        to_also = np.arange(len(also)) + np.repeat(np.cumsum(n), m)
        both, marks = np.empty(len(at) + len(also), np.uint32), np.empty(len(at) + len(also), bool)
        both[to], both[to_also], marks[to], marks[to_also] = flat, other[also], begun, starts
        flat, begun = both, marks
    # characters have one byte or three
    ascii_before = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(flat < 0x80, out=ascii_before[1:])
    offsets = np.append(np.flatnonzero(begun), len(flat))
    offsets = (3 * offsets - 2 * ascii_before[offsets]).astype(np.int32)
    return each, pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_text(flat).encode()))


def _each(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the places, in order, lie before each end and after the one before."""
    return np.diff(np.searchsorted(at, ends), prepend=0)


def _mapped(texts: DataFrame, own: Lexicon, rows, schema: str) -> DataFrame:
    """What rows(docids, how many tokens each has, tokens) gives for many of texts(docid, text) at a time."""
    sent = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(1).to_pylist()
            for a, z in portions(some):
                yield rows(b.column(0).slice(a, z - a), *_tokens(some[a:z], paths_of(sent)))

    return texts.select("docid", "text").mapInArrow(run, f"docid {dict(texts.dtypes)['docid']}, {schema}")


def segmented(texts: DataFrame, own: Lexicon) -> DataFrame:
    """texts(docid, text) with tokens, an array, in place of text: what term counts and BM25 statistics take once exploded.

    Null and empty texts have no tokens; very long ones are cut whole. An empty table gives an empty table.
    """

    def rows(docid: pa.Array, each: np.ndarray, found: pa.StringArray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), found)
        return pa.RecordBatch.from_arrays([docid, lists], ["docid", "tokens"])

    return _mapped(texts, own, rows, "tokens array<string>")


def segmented_lines(texts: DataFrame, own: Lexicon) -> DataFrame:
    """docid, n, line: how many tokens a text has, and all of them with a space between; a line costs less to hand over than an array."""

    def rows(docid: pa.Array, each: np.ndarray, found: pa.StringArray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), found)
        return pa.RecordBatch.from_arrays([docid, pa.array(each, pa.int64()), pc.binary_join(lists, " ")], ["docid", "n", "line"])

    return _mapped(texts, own, rows, "n long, line string")


def segmented_counts(texts: DataFrame, own: Lexicon) -> DataFrame:
    """docid, token, tf: the term counts of segmented, counted in each text before they are dealt out."""

    def rows(docid: pa.Array, each: np.ndarray, found: pa.StringArray) -> pa.RecordBatch:
        coded = found.dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        pairs, n = np.unique(np.repeat(np.arange(len(each)), each) * kinds + coded.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(pairs, kinds)
        return pa.RecordBatch.from_arrays([docid.take(pa.array(text)), coded.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], ["docid", "token", "tf"])

    return _mapped(texts, own, rows, "token string, tf long").groupBy("docid", "token").agg(F.sum("tf").alias("tf"))
