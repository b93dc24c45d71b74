"""Spelling variants against brute force, on the given table, on planted words and on odd tables."""

from __future__ import annotations

import bisect
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import registry, spelling


def lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words: dict[str, int], ratio: int = 2) -> dict[str, tuple]:
    """Near words by what is left when a character is deleted or replaced by a mark."""
    marks: dict[str, set[str]] = {}
    for w in words:
        for k in range(len(w) + 1):
            marks.setdefault(w[:k] + "*" + w[k:], set()).add(w)
            if k < len(w):
                marks.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
    near: dict[str, set[str]] = {w: set() for w in words}
    for group in marks.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df) -> dict[str, tuple]:
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: tuple(r)[1:] for r in found}


def test_query(spark):
    words: Counter[str] = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    kept = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    got = rows(registry.QUERIES["op13_spelling"](spark, SF))
    assert got == brute(kept)
    assert sum(x[0] is not None for x in got.values()) > 20 and len(got) > 300


def planted(seed: int) -> dict[str, int]:
    r = random.Random(seed)
    base = ["".join(r.choices("abcé", k=r.randint(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "ÿaaaa", "x" * 3000, "x" * 3001]
    for w in list(base):
        for _ in range(4):
            k = r.randrange(len(w))
            base.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abcé") + w[k + 1 :]]))
    return {w: r.choice([3, 3, 4, 6, 12, 12, 50, 100]) for w in base if len(w) >= 5}


@pytest.mark.parametrize("tile", [7, 50_000])
def test_planted_words(spark, tile, monkeypatch):
    words = planted(tile)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling.near_words, "__defaults__", (tile,))
    assert rows(spelling.group_variants(frame.repartition(3))) == brute(words)


def test_a_chain_of_forms(spark):
    chain = {"a" * 5 + "b" * k: 3 * 2**k for k in range(20)}
    got = rows(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {x[1] for x in got.values()} == {"a" * 5 + "b" * 19}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=60), st.text("abé", min_size=1, max_size=7))
def test_automaton(words, word):
    order = sorted(words)
    own = spelling.Automaton(order)
    for k, w in enumerate(order):
        assert own.number(w) == k
    if word not in words:
        assert own.number(word) is None
    for exact in range(len(word) + 1):
        want = {w for w in words if w[:exact] == word[:exact] and one_edit(w, word)}
        assert {order[k] for k in own.near(word, exact)} == want
    assert own.size[own.start] == len(order)


def test_automaton_is_minimal():
    words = sorted({a + b + c for a in "abc" for b in ("xyz", "x", "") for c in ("ing", "ed", "")})
    own = spelling.Automaton(words)
    right = {frozenset(w[k:] for w in words[bisect.bisect_left(words, p) :] if w.startswith(p)) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(own.next) <= len(right)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "Straße Straße straße"), (1, None), (2, ""), (3, "word " * 50_000 + "abcdefgh"), (3, "abcdefgh"), (3, "abcdefgh"), (4, "1234 ÀÀÀÀÀ-ààààà")], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    want: Counter[str] = Counter()
    for i, text in [("", "Straße Straße straße"), (3, "abcdefgh"), (3, "abcdefgh"), (3, "abcdefgh")]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            want[spelling.variant(lower(run), zlib.crc32(f"{i}:".encode()))] += 1
    assert got == {w: n for w, n in want.items() if n >= 3}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long, form int")).collect() == []
    alone = spark.createDataFrame([("alone", 3, "x"), (None, 9, "y")], "word string, n long, root string")
    assert rows(spelling.group_variants(alone)) == {"alone": (None, "alone", 3, 0, None)}
