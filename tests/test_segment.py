"""Word segmentation against enumeration, on planted words and on odd texts; BM25 statistics over its tokens."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import search as S
from quillmill.operators import segment as G
from quillmill.plans import q_search as QS
from quillmill.plans.registry import QUERIES
from quillmill.sources import io

HAN = [chr(0x4E00 + k) for k in range(40)]
WIDE = [chr(0x4E00 + k) for k in range(200)]


def lexicon(spark, words):
    return G.lexicon(spark.createDataFrame(list(words.items()), "word string, n long"))


@pytest.fixture(scope="module")
def small(spark):
    a, b, c, d = HAN[:4]
    return lexicon(spark, {a: 5, b: 2, a + b: 7, b + c: 7, a + b + c: 2, c + c: 9, b + b + b + b: 1, d: 4})


def cuts(text):
    for k in range(1 << (len(text) - 1)):
        ends = [i for i in range(1, len(text)) if k >> (i - 1) & 1]
        yield [text[a:z] for a, z in zip([0, *ends], [*ends, len(text)], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.text(HAN[:5], min_size=1, max_size=9))
def test_path_is_the_best_of_all(small, text):
    worth = lambda words: sum(small.words.get(w, small.unknown if len(w) == 1 else -math.inf) for w in words)
    got = G.path(text, small)
    assert "".join(got) == text
    assert worth(got) == pytest.approx(max(map(worth, cuts(text))))


@settings(max_examples=100, deadline=None)
@given(st.text(HAN[:5], min_size=1, max_size=6))
def test_tags_are_the_best_of_all(small, text):
    def worth(tags):
        if tags[0] not in "BS" or tags[-1] not in "ES" or any(t not in G.AFTER_TAG[a] for a, t in itertools.pairwise(tags)):
            return -math.inf
        emit = [small.emit.get(t + c, small.rare[t]) for t, c in zip(tags, text, strict=True)]
        return small.start[tags[0]] + sum(emit) + sum(small.step[a + t] for a, t in itertools.pairwise(tags))

    words = G.tagged(text, small)
    assert "".join(words) == text
    got = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
    assert worth(got) == pytest.approx(max(worth(t) for t in itertools.product("BMES", repeat=len(text))))


@pytest.fixture(scope="module")
def planted():
    """Sentences of random words of two to four characters, and their true cuts."""
    r = random.Random(4)
    words = ["".join(r.sample(WIDE, r.choice([2, 2, 3, 4]))) for _ in range(120)]
    weights = [1 / (k + 5) for k in range(120)]
    return words, [r.choices(words, weights, k=r.randint(3, 12)) for _ in range(1500)]


def marks(words):
    return set(itertools.accumulate(map(len, words)))


def test_learned_words(spark, planted):
    words, sentences = planted
    texts = spark.createDataFrame([("".join(s) + "。",) for s in sentences], "text string").repartition(4)
    own = G.learn(texts)
    right = found = want = 0
    for s in sentences[:300]:
        got, true = marks(G.cut("".join(s), own)), marks(s)
        right, found, want = right + len(got & true), found + len(got), want + len(true)
    assert right / found > 0.9 and right / want > 0.9
    assert sum(w in own.words for w in words) > 0.8 * len(words)


def test_candidates_are_those_of_plain_counts(spark, planted):
    texts = ["".join(s) for s in planted[1][:200]]
    runs = Counter(("\x02" + t + "\x03")[i : i + m] for t in texts for m in range(1, 6) for i in range(len(t) + 3 - m))
    total = sum(n for w, n in runs.items() if len(w) == 1 and w not in "\x02\x03")

    def entropy(counts):
        n = sum(counts)
        return -sum(x / n * math.log(x / n) for x in counts)

    beside: dict[tuple, list[int]] = {}
    for w, n in runs.items():
        beside.setdefault(("right", w[:-1]), []).append(n)
        beside.setdefault(("left", w[1:]), []).append(n)
    want = {}
    for w, n in runs.items():
        if "\x02" in w or "\x03" in w or len(w) > 4:
            continue
        if len(w) == 1:
            want[w] = n
        elif n >= 5 and min(entropy(beside[("right", w)]), entropy(beside[("left", w)])) >= G.LEAST_ENTROPY - 1e-12:
            if min(math.log(n * total / runs[w[:k]] / runs[w[k:]]) for k in range(1, len(w))) >= G.LEAST_COHESION:
                want[w] = n
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {r.word: r.n for r in G.candidates(frame).collect()} == want


def test_unknown_characters_are_tagged(small):
    x, y = HAN[30:32]
    assert G.cut(HAN[0] + HAN[1] + x, small) == [HAN[0] + HAN[1], x]
    assert "".join(G.cut(x + y, small)) == x + y
    assert G.tokens(f"{HAN[0]}{HAN[1]} ESD-2 {HAN[2]}{HAN[2]}!", small) == [HAN[0] + HAN[1], HAN[2] * 2, "esd-2"]


def test_odd_texts(spark, small):
    long = (HAN[0] + HAN[1]) * 100_000
    rows = [(1, None), (2, ""), (3, "plain"), (4, long), (4, long), (None, HAN[3])]
    got = sorted(((r.docid or 0, len(r.tokens)) for r in G.segmented(spark.createDataFrame(rows, "docid long, text string"), small).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (4, 100_000), (4, 100_000)]
    none = G.learn(spark.createDataFrame([], "text string"))
    assert none.words == {} and G.cut(HAN[0], none) == [HAN[0]] and G.cut(HAN[0] + HAN[1], none)
    assert G.segmented(spark.createDataFrame([], "docid long, text string"), none).collect() == []


def test_statistics_of_the_given_texts(spark):
    """The query's statistics are those of its own cuts, counted plainly."""
    rows = QUERIES["segmented_stats"](spark, SF).collect()
    texts = QS.unspaced(spark, SF)
    own = QS.words_of(spark, SF)
    df: Counter[str] = Counter()
    for r in texts.collect():
        df.update(set(G.tokens(r.text or "", own)))
    assert {r.token: r.df for r in rows} == dict(df)
    n = texts.count()
    assert all(abs(r.idf - max(math.log((n - r.df + 0.5) / (r.df + 0.5)), 0)) < 1e-5 for r in rows)
    terms = io.written(S.term_counts(G.segmented(texts, own).select("docid", F.explode("tokens").alias("token"))), "terms")
    assert terms.agg(F.sum("tf")).first()[0] == sum(r.n for r in QUERIES["segmented_texts"](spark, SF).collect())


@pytest.mark.parametrize(("kinds", "cells"), [(6, 4_000_000), (26, 10), (20_000, 10)])
def test_many_stretches_at_a_time(monkeypatch, kinds, cells):
    """Paths, cuts and runs of many stretches together are those of each by itself, by tables, by search and without either."""
    import random
    from collections import Counter

    monkeypatch.setattr(G, "CELLS", cells)
    rng = random.Random(kinds)
    han = [chr(0x4E00 + i) for i in range(kinds)]
    words = {"".join(rng.choice(han) for _ in range(rng.randint(1, 4))): -rng.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(300)}
    own = G.Lexicon(words, -9.0, {"B": -0.5, "S": -0.7}, {a + t: -0.3 for a in "BMES" for t in G.AFTER_TAG[a]}, {}, dict.fromkeys("BMES", -5.0), 4)
    stretches = ["".join(rng.choice(list(words)) if rng.random() < 0.7 else rng.choice([*han, "鿾"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    total = lambda parts: sum((Counter(dict(zip(w, n, strict=True))) for w, n in parts), Counter())
    many = G.Paths(own)
    assert total(many.counts(stretches)) == Counter(w for s in stretches for w in G.path(s, own))
    assert many.cuts(stretches) == [G.cut(s, own) for s in stretches]
    marked = [G.BEFORE + s + G.AFTER for s in stretches]
    assert total(G._run_counts(stretches, 4)) == Counter(s[i : i + m] for s in marked for m in range(1, 6) for i in range(len(s) - m + 1))


def test_long_stretches_are_parted(monkeypatch):
    """A long stretch takes as many steps as its longest part, and its path and cut are the same."""
    monkeypatch.setattr(G, "LONG", 8)
    rng = random.Random(5)
    words = {"".join(rng.choice(HAN[:6]) for _ in range(rng.randint(1, 4))): -rng.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(60)}
    own = G.Lexicon(words, -9.0, {"B": -0.5, "S": -0.7}, {a + t: -0.3 for a in "BMES" for t in G.AFTER_TAG[a]}, {}, dict.fromkeys("BMES", -5.0), 4)
    stretches = ["".join(rng.choice(HAN[:9]) for _ in range(n)) for n in (1, 7, 8, 9, 40, 3000)]
    many = G.Paths(own)
    code = G._laid(stretches)
    begin, end = many._parted(many.ids(code), *G._bounds(code))
    assert (end - begin).max() < 100 and (end - begin).sum() == sum(map(len, stretches))
    assert many.cuts(stretches) == [G.cut(s, own) for s in stretches]
    counts = sum((Counter(dict(zip(w, n, strict=True))) for w, n in many.counts(stretches)), Counter())
    assert counts == Counter(w for s in stretches for w in G.path(s, own))


def test_of_equal_paths_the_longest_first(spark):
    """Equal paths stay equal however long the text behind them is."""
    a = HAN[0]
    for n in range(3, 12):
        own = lexicon(spark, {a: 3, a * 2: n, HAN[1]: 1})
        for size in (3, 5, 7, 31, 99, 501):
            want = [a * 2] * (size // 2) + [a]
            assert G.path(a * size, own) == want and G.Paths(own).cuts([a * size]) == [want]


ODD = ["", None, "A’b-C_9 KELVIN İx", f"{HAN[0]}{HAN[1]}\x00{HAN[2]}{HAN[2]}a\x00b", f"é{HAN[30]}{HAN[31]}\U0001f600{HAN[3]}z", f"x{HAN[0]}", f"{HAN[1]}y", f"Y{HAN[33]}", HAN[1] + HAN[34] * 20]


def test_counts_of_each_text(spark, small):
    """Tokens of odd texts, and their counts in each docid, are the plain ones."""
    rows = [(k // 2 if k < 6 else None, t) for k, t in enumerate(ODD)]
    texts = spark.createDataFrame(rows, "docid long, text string")
    want = [(d, G.tokens(t or "", small)) for d, t in rows]
    key = lambda r: (r[0] is None, *map(str, r))
    for n in (1, 3):
        assert sorted(((r.docid, r.tokens) for r in G.segmented(texts.repartition(n), small).collect()), key=key) == sorted(want, key=key)
        counts = {(r.docid, r.token): r.tf for r in G.segmented_counts(texts.repartition(n), small).collect()}
        assert counts == Counter((d, w) for d, words in want for w in words)
    assert G.segmented_counts(texts.limit(0), small).collect() == []


def test_lines_are_the_tokens(spark, small):
    texts = spark.createDataFrame(list(enumerate(ODD)), "docid long, text string")
    want = [(k, len(w), " ".join(w)) for k, w in enumerate(G.tokens(t or "", small) for t in ODD)]
    assert sorted(map(tuple, G.segmented_lines(texts, small).collect())) == want


def test_texts_are_read_once(spark, monkeypatch):
    """Both queries make their texts without spaces once, whatever the number of passes over them."""
    made = []
    monkeypatch.setattr(QS, "unspaced", lambda *a, f=QS.unspaced: made.append(1) or f(*a))
    n = QUERIES["segmented_texts"](spark, SF).count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() and len(made) == 1
    QUERIES["segmented_stats"](spark, SF).count()
    assert len(made) == 2


def test_unspaced_texts(spark, tmp_path, monkeypatch):
    """Texts without spaces are those of plain expressions, and are dealt out though they lie in one piece."""
    monkeypatch.setattr(G, "CHARS", 40)
    rows = [(k, t) for k, t in enumerate([*ODD, "Ab c\td\x0b\x0c\r\ne　f\xa0", " \n", *(f"Text {k}, of WORDS." for k in range(200))])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QS.unspaced(spark, str(tmp_path))
    text = F.regexp_replace(F.translate(F.lower("text"), QS.LETTERS, QS.HAN), r"\s+", "")
    plain = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", text)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
