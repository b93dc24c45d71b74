"""The training-text operators: against SQL, against brute force, and on nulls, empty and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from quillmill.llm import common, decontaminate, line_dedup, lm_scoring, packing, preferences, pseudonyms, quality, registry, secrets, simhash, substring_dedup
from quillmill.llm.gru import Model

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, "a", None), (None, "null id text with words", "en", "s", 3, None, "k"), (2, "", "en", None, 0, "b", "k"), (3, " \n\t ", "en", "s", 1, "c", "k"),
        (4, long, "en", "s", len(long), "d", "k"), (4, long, "en", "s", len(long), "d", "k"), (5, "A line of text\nA line of text\nother line here", "de", "s", 9, "e", "k"), (6, "a LINE of text \nsomething else", "de", "s", 9, "f", "k"),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_odd_tables(spark, odd, empty):
    turns = lambda d: d.select(F.col("doc_id").alias("pair_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text")
    bench = spark.createDataFrame([(1, None), (None, "something else entirely not there at all")], "item_id long, text string")
    model = [0] * (len(secrets.ALPHABET) + 1) ** 2
    runs = {
        "preferences": lambda d: preferences.format_pairs(turns(d), turns(d)), "packing": packing.pack, "passages": substring_dedup.passages, "simhash": simhash.simhash_groups, "lines": line_dedup.dedup_lines,
        "quality": quality.judge, "secrets": lambda d: secrets.find_secrets(d, model), "pseudonyms": lambda d: pseudonyms.pseudonymise(d, "k"), "decontaminate": lambda d: decontaminate.contaminated(d, bench), "lm": lm_scoring.score_documents,
    }
    for name, run in runs.items():
        assert not run(empty).collect(), name
        n = len(run(odd).collect())
        if name in ("simhash", "lines", "quality", "secrets", "pseudonyms", "lm"):
            assert n == 8, name
    assert decontaminate.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert line_dedup.dedup_lines(odd).columns[: len(odd.columns)] == odd.columns


def test_line_dedup_cases(odd):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(odd).where("doc_id in (1, 5, 6)").collect()}
    assert got == {1: (1, 0, ""), 5: (3, 0, "A line of text\nA line of text\nother line here"), 6: (2, 1, "something else")}
    full = line_dedup.dedup_lines(odd, most_bits=1 << 20, bits_per_doc=1)
    assert full.agg(F.sum("n_dropped")).first()[0] == line_dedup.dedup_lines(odd).agg(F.sum("n_dropped")).first()[0]


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = registry.QUERIES["op2_packing"](spark, SF).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(corpus)
    for d, pieces in by_doc.items():
        ids, at = np.array([*tok.encode(corpus[d], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padding < 0.05 * sum(r.length for r in rows)


def test_plans_place_every_piece():
    rng = np.random.default_rng(3)
    for size in (0, 1, 50, 5000):
        demand = np.bincount(rng.integers(0, 64, size), minlength=64)
        plans = packing.plan(demand, 64)
        assert (sum((t * p for p, t in plans), np.zeros(64, int)) == demand).all()
        assert all(p @ np.arange(1, 65) <= 64 for p, _ in plans)
    assert sum(t for _, t in plans) <= 1.02 * (demand @ np.arange(1, 65) / 64) + 2


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a\n b", "don't stop's", "x y z", "<|endoftext|> a", "é ß 中文 123 45", "a" * 3000, "Zk9/" * 500 + " tail"])
def test_encoder_is_the_tokenizer(text):
    path = packing.tokenizer_path()
    for ranks in (packing.merge_ranks(path), None):
        e = packing.Encoder(path, ranks)
        assert e.encode(text) == e.by_tokenizer(text)


def test_ranks_agree_on_latin_characters():
    path = packing.tokenizer_path()
    e = packing.Encoder(path, packing.merge_ranks(path))
    for c in map(chr, [*range(1, 0x260), 0x3B1, 0x416, 0x4E2D, 0x1F600]):
        for text in (f"a{c}a", f"1{c}1", f"x {c} y", f"{c}{c}'s", f"a{c} {c}b", f".{c}. {c}1"):
            assert e.encode(text) == e.by_tokenizer(text), (text, c)


def test_merge_ranks_are_proven(tmp_path):
    import json

    path = packing.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    assert len(packing.merge_ranks(path)) == 50256
    spec["model"]["merges"][300], spec["model"]["merges"][9000] = spec["model"]["merges"][9000], spec["model"]["merges"][300]
    with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert packing.merge_ranks(str(tmp_path / "t.json")) is None


def test_solver_needs_no_linear_algebra_library():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((60, 60))
    assert np.allclose(packing.inverted(a) @ a, np.eye(60), atol=1e-8)
    demand = np.bincount(np.minimum(rng.lognormal(3.5, 1.2, 20_000), 254).astype(int), minlength=256)
    patterns, used, gap = packing.solve(demand, 256)
    assert gap <= packing.GAP and np.allclose(used @ patterns, demand, atol=1e-6)


def test_simhash_brute_force(spark, corpus):
    import xxhash

    def print_(text: str) -> int:
        w = WORDS.findall(lower(text))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(corpus)
    fp = [print_(corpus[i]) for i in ids]
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = {d: (f"{f:016x}", ids[r]) for d, f, r in zip(ids, fp, root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op4_simhash"](spark, SF).collect()} == want


def test_search_trees_and_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for b in base for _ in range(60)], np.uint64)
    fp = np.unique(np.concatenate([base, near, rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    label = np.arange(len(fp))
    u, v = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    simhash.unite(label, u, v)
    assert (simhash.linked(fp, np.zeros(len(fp), int), 4) == label).all()
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    parts = {r.node: r.component for r in common.connected_components(simhash.link_fingerprints(df, tile=16)).collect()}
    groups = collections.defaultdict(set)
    for x, k in zip(fp.view(np.int64).tolist(), label.tolist(), strict=True):
        groups[k].add(parts.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 130)] + [(7, x) for x in range(200, 230)] + [(1, 2)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got[130] == 100 and got[229] == 7 and got[2] == 1 and len(got) == 31 + 31 + 2
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def word_lists(corpus):
    return {d: re.findall(r"\w+", (t or "").lower()) for d, t in corpus.items()}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_passages_find_all_shared_runs(spark, corpus):
    words, n = word_lists(corpus), substring_dedup.LEAST
    at = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].add((d, i))
    runs = {x for places in at.values() if len({d for d, _ in places}) > 1 for x in places}
    got = collections.defaultdict(list)
    for r in registry.QUERIES["op3_substring_dedup"](spark, SF).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert 0 <= r.start_word < r.end_word <= len(words[r.doc_id]) and r.removed == (r.doc_id > r.first_doc_id)
    assert runs
    assert all(any(a <= i and i + n <= z for a, z in got[d]) for d, i in runs)
    # all else is held by a paragraph that is similar to one of another document
    grams = {}
    for d, t in corpus.items():
        for line in t.lower().split("\n"):
            w = re.findall(r"\w+", line)
            grams.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    for d in set(got) - {d for d, _ in runs}:
        assert any(x and y and jaccard(x, y) >= 0.5 for x in grams[d] for e in grams if e != d for y in grams[e]), d


def test_recall_on_edited_paragraphs(spark):
    rng = np.random.default_rng(8)
    texts, lists = [], []
    for k in range(300):
        w = [f"q{x}" for x in rng.integers(0, 5000, int(rng.integers(52, 140)))]
        lists.append(w)
        edited = list(w)
        for at in rng.choice(len(w), int(rng.integers(1, 4)), replace=False):
            edited[at] = f"new{at}"
        lists.append(edited)
    for d, w in enumerate(lists):
        texts.append((d, "\n".join([f"head{d} own{d}", " ".join(w), f"tail{d} more{d}"])))
    found = substring_dedup.suspects(spark.createDataFrame(texts, "doc_id long, text string"))
    by = collections.defaultdict(set)
    for r in substring_dedup.similar_paragraphs(found).collect():
        by[r.class_id].add(r.id)
    linked = {d: k for k, x in by.items() for d in x}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lists]
    true = {(i, j) for i in range(len(lists)) for j in range(i) if jaccard(grams[i], grams[j]) >= 0.8}
    hit = sum(i in linked and linked[i] == linked.get(j) for i, j in true)
    assert len(true) > 100 and hit >= 0.95 * len(true)
    assert all(any(jaccard(grams[i], grams[j]) >= 0.8 for j in x if j != i) for x in by.values() for i in x)


def test_features_match_the_plain_words():
    texts = ["", "Ünï Çode_x 12 \n b", "a " * 40 + "\n" + "z", " ".join(f"W{i}" for i in range(100)), "x" * 3_000_000 + " y"]
    for t in texts:
        hashes, lines = substring_dedup.words_of(t)
        words = [(m[0], t.lower()[: m.start()].count("\n")) for m in re.finditer(r"\w+", t.lower())] if len(t) < 1000 else t.lower().split()
        if len(t) < 1000:
            assert lines.tolist() == [x for _, x in words]
            assert len({w: h for (w, _), h in zip(words, hashes.tolist(), strict=True)}) == len({w for w, _ in words}) == len(set(hashes.tolist()))
        assert len(hashes) == len(words)
    one, many = substring_dedup.Features(texts[2:4]), [substring_dedup.Features([t]) for t in texts[2:4]]
    assert one.window_at.tolist() == [x for f in many for x in f.window_at.tolist()] and one.whole.tolist() == [x for f in many for x in f.whole.tolist()]
    assert (one.keys == np.concatenate([f.keys for f in many])).all()


def test_similar_paragraphs_are_linked(spark):
    w = [f"word{i}" for i in range(60)]
    texts = [(1, " ".join(w)), (2, " ".join([*w[:30], "changed", *w[31:]])), (3, " ".join(f"other{i}" for i in range(60)))]
    got = substring_dedup.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.removed) for r in got) == [(1, 0, 60, 1, False), (2, 0, 60, 1, True)]


def test_secrets_brute_force(spark, corpus):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in registry.QUERIES["op7_secrets"](spark, SF).collect():
        x = corpus[r.doc_id]
        s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(x) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
        assert (r.base_sha256, r.n_assign, r.n_hex) == (hashlib.sha256(text.encode()).hexdigest(), sum(x[1] == 0 for x in s), sum(x[1] == 2 for x in s))
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_markov_separates_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.train(secrets.labelled_strings(docs, 60, 300))
    digest = F.sha2(F.concat(F.lit("held-out-"), F.col("id").cast("string")), 256)
    random = spark.range(200).select(F.substring(F.base64(F.unhex(digest)), 1, 32).alias("t"), F.lit(1).alias("y"))
    words = spark.range(200).select(F.concat(F.lit("the_value_of_"), F.translate(F.col("id").cast("string"), "0123456789", "aeioutnsrl"), F.lit("_setting_name")).alias("t"), F.lit(0).alias("y"))
    both = random.unionByName(words).select("y", (secrets.ratio_per_char(F.col("t"), F.lit(model)) > 400).cast("int").alias("p"))
    assert both.where("y = p").count() >= 390
    t = "x = Zk9Qw3LmT0pXv7RbN2sYc8HdJ4f; see token=abc"
    r = secrets.find_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).select(secrets.joined("base"), secrets.joined("spans")).first()
    assert r[0] == "" and r[1] == "markov:4:31"


def luhn(s: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    text = "mail Ann.b7@mail1.example.com card 4111 1111 1111 1111 bad 4111 1111 1111 1112 ip 10.2.3.4 no 300.1.1.1 date 2020-02-29 or 31/12/1999 not 2021-02-29 phone +1 (743) 555-3824 ssn 123-45-6789 iban GB82WEST12345698765432."
    rows = [(1, text), (2, "again 4111111111111111 and 10.2.3.4"), (3, None), (4, "no digits")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").select("_row.doc_id", "new_text", "found.k").collect()}
    assert got[1].k == ["email", "card", "ip", "date", "date", "phone", "ssn", "iban"]
    new = got[1].new_text
    card = re.search(r"card ([0-9 ]{19})", new)[1]
    assert luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    for gone in ("Ann.b7@", "4111 1111 1111 1111", "10.2.3.4", "2020-02-29", "31/12/1999", "555-3824", "123-45-6789", "GB82WEST"):
        assert gone not in new
    for stays in ("4111 1111 1111 1112", "300.1.1.1", "2021-02-29", "@mail1.example.com", "+1 ("):
        assert stays in new
    iban = re.search(r"iban (GB[0-9A-Z]+)", new)[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert card.replace(" ", "") in got[2].new_text and re.search(r"ip ([0-9.]+) no", new)[1] in got[2].new_text
    assert got[3].new_text is None and got[4].new_text == "no digits"


def test_feistel_permutes(spark):
    parts = F.array(F.struct(F.floor(F.col("id") / 10).cast("int").alias("v"), F.lit(10).alias("m")), F.struct((F.col("id") % 10).cast("int").alias("v"), F.lit(10).alias("m")))
    out = spark.range(100).select(pseudonyms.feistel(parts, "k").alias("x")).select(F.col("x")[0]["v"] * 10 + F.col("x")[1]["v"]).collect()
    assert sorted(r[0] for r in out) == list(range(100))


def test_decontamination_finds_reordered_passages(spark):
    a, b = " ".join(f"alpha{i}" for i in range(12)), " ".join(f"beta{i}" for i in range(12))
    docs = [(1, f"before {a}. {b} after"), (2, f"x {b.upper()}, then {a} y"), (3, f"only {' '.join(a.split()[:5])} here"), (4, None), (5, "clean text")]
    bench = spark.createDataFrame([(9, f"{a} {b}"), (8, "tiny"), (None, None)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, most_chars=10).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.covered) for r in got) == [(1, 9, 1, 24), (2, 9, 2, 24)]


def test_tiles_do_not_overlap():
    got = decontaminate.tiles([(0, 0, 10), (5, 20, 10), (0, 40, 4)], 5)
    assert got == [(0, 0, 10), (10, 25, 5)]


def naive_cover(doc: list[str], item: list[str], least: int) -> tuple[int, int]:
    """Greedy string tiling as it is defined: the longest common run of unmarked words, again and again."""
    in_doc, in_item, n, covered = set(), set(), 0, 0
    while True:
        best, last = (0, 0, 0), {}
        for i, w in enumerate(doc):
            now = {}
            for j, x in enumerate(item):
                if w == x and i not in in_doc and j not in in_item:
                    now[j] = last.get(j - 1, 0) + 1
                    key = (now[j], -(j - now[j] + 1), -(i - now[j] + 1))
                    best = max(best, key) if best[0] else key
            last = now
        if best[0] < least:
            return n, covered
        size, j, i = best[0], -best[1], -best[2]
        in_doc.update(range(i, i + size))
        in_item.update(range(j, j + size))
        n, covered = n + 1, covered + size


def test_decontamination_brute_force(spark, corpus):
    bench = {r.item_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = {d: decontaminate.tokens(t) for d, t in corpus.items()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own = {i: grams(w) for i, w in bench.items()}
    want = set()
    for d, w in words.items():
        g = grams(w)
        for i, x in bench.items():
            if g & own[i]:
                n, covered = naive_cover(w, x, 5)
                if covered >= 0.5 * len(x):
                    want.add((d, i, n, covered, len(x)))
    got = {(r.doc_id, r.item_id, r.n_tiles, r.covered, r.item_words) for r in registry.QUERIES["op9_decontaminate"](spark, SF).collect()}
    assert want and got == want
    # a benchmark that is too large to send gives the same by a join of seeds
    docs, tests = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    joined = {(r.doc_id, r.item_id, r.n_tiles, r.covered, r.item_words) for r in decontaminate.contaminated(docs, tests, most_chars=10).collect()}
    assert joined == want
    assert {r.doc_id for r in decontaminate.clean_rows(docs, tests, most_chars=10).collect()} == set(corpus) - {d for d, *_ in want}


def test_tiling_by_blocks_and_on_repetitive_texts(monkeypatch):
    rng = np.random.default_rng(6)
    items = [" ".join(rng.choice(["a", "b", "c"], 14)) for _ in range(6)]
    tests = decontaminate.Tests(list(enumerate(items)), 3)
    docs = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(8)]
    whole = [tests.against(d) for d in docs]
    for d, found in zip(docs, whole, strict=True):
        for k, n, covered, size in found:
            assert (n, covered, size) == (*naive_cover(d.split(), items[k].split(), 3), 14)
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    assert [tests.against(d) for d in docs] == whole
    monkeypatch.setattr(decontaminate, "PAIRS", 1_000_000)
    same = decontaminate.Tests([(0, "a " * 300)], 5).against("a " * 30_000)
    assert same == [(0, 1, 300, 300)]


def test_gru_gradients():
    m = Model(np.array([5.0, 2, 9, 4, 3, 2]), np.array([0, 1, 2, 4, 6]), 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["wo"] += np.random.default_rng(0).standard_normal(m.p["wo"].shape)
    rng = np.random.default_rng(1)
    target = rng.integers(0, 6, (4, 3))
    ids, valid, h = rng.integers(0, 6, (4, 3)), np.ones((4, 3), bool), np.zeros((3, 3))
    grad, _, _ = m.backward(ids, target, valid, h)
    for name, at in (("embed", (2, 1)), ("wx", (0, 4)), ("wh", (1, 7)), ("b", (5,)), ("wc", (2, 1)), ("wo", (3, 0)), ("bo", (4,))):
        eps, keep = 1e-5, m.p[name][at]
        loss = []
        for d in (eps, -eps):
            m.p[name][at] = keep + d
            loss.append(m.backward(ids, target, valid, h)[2])
        m.p[name][at] = keep
        assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=1e-2, abs=1e-4), name


def test_gru_scores_are_probabilities_and_carry_state():
    m = Model(np.array([5.0, 2, 9, 4, 3, 2]), np.array([0, 1, 2, 4, 6]), 4)
    m.p["wo"] += np.random.default_rng(0).standard_normal(m.p["wo"].shape).astype(np.float32)
    two = [np.array([a, b]) for a in range(6) for b in range(6)]
    assert np.exp(m.score(two, 1)).sum() == pytest.approx(1, abs=1e-4)
    doc = np.random.default_rng(2).integers(0, 6, 100)
    assert m.score([doc], 1)[0] == pytest.approx(m.score([doc], 1, window=7)[0], rel=1e-5)
    assert m.score([doc[:3], doc, doc[:50]], 1, lanes=2)[1] == pytest.approx(m.score([doc], 1)[0], rel=1e-5)


@pytest.mark.parametrize("most_words", [lm_scoring.MOST_WORDS, 50])
def test_lm_base_scores(spark, corpus, most_words):
    rows = lm_scoring.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), most_words=most_words, tokens=64, classes=8, width=8).collect()
    words = {d: [*WORDS.findall(lower(t)), None] for d, t in corpus.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in corpus}
    counts = collections.Counter(w for d, x in words.items() if not held[d] for w in x)
    total, many = sum(counts.values()), len(counts)
    for r in rows:
        x = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(counts[w] > 0 for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + many + 1)) for w in x), rel=1e-9)
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.judge(docs).select("_row.doc_id", "_q.*").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed")
    assert got.where("kept <> (quality = 1)").count() == 0


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, d = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        d = common.stage(stage(spark, d, SF), name)
        sizes.append(d.count())
        if name != "packing":
            assert d.columns == docs.columns
            assert d.count() == d.select("doc_id").distinct().count()
            last = d
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
    assert {r[0] for r in d.select("doc_id").distinct().collect()} == {r[0] for r in last.select("doc_id").collect()}
    assert decontaminate.contaminated(last, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_simhash_stage_removes_rows_not_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(0), "a"), (None, text(1), "b"), (None, None, "c"), (5, text(0), "d"), (None, text(2), "e"), (None, text(2), "f"), (7, text(3), "g"), (7, text(3), "h"), (7, text(4), "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = simhash.stage_simhash(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = {(5, text(0)), (None, text(1)), (None, None), (None, text(2)), (7, text(3)), (7, text(4))}
    assert len(got) == 6 and set(got) == want


def test_gru_trains_on_all_tokens_and_carries_state():
    counts, bounds = np.array([5.0, 2, 9, 4, 3, 2]), np.array([0, 1, 2, 4, 6])
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, n).astype(np.uint16) for n in (300, 0, 1, 40, 7, 90, 33)]
    seen, real = [], Model.backward

    def spy(self, ids, target, valid, h, fresh=None):
        seen.append((ids, target, valid, h.copy(), fresh))
        return real(self, ids, target, valid, h, fresh)

    m = Model(counts, bounds, 4)
    m.backward = spy.__get__(m)
    assert m.train(docs, 1, lanes=2) == sum(map(len, docs))
    got = collections.Counter(int(x) for _, t, v, _, _ in seen for x in t[v])
    assert got == collections.Counter(np.concatenate(docs).tolist())
    starts = sum(int((f & v).sum()) for _, _, v, _, f in seen)
    assert starts == sum(len(d) > 0 for d in docs)
    assert all(np.abs(h).sum() > 0 for *_, h, _ in seen[1:])
    # two documents in one lane have the gradient of two lanes
    a, b = docs[4].astype(np.int64), docs[3][:7].astype(np.int64)
    zero = lambda n: np.zeros((n, 4), np.float32)
    ids = lambda x: np.append(1, x[:-1])
    fresh = np.zeros((14, 1), bool)
    fresh[[0, 7]] = True
    m = Model(counts, bounds, 4)
    one = m.backward(np.append(ids(a), ids(b))[:, None], np.append(a, b)[:, None], np.ones((14, 1), bool), zero(1), fresh)[0]
    two = m.backward(np.stack([ids(a), ids(b)], 1), np.stack([a, b], 1), np.ones((7, 2), bool), zero(2))[0]
    assert all(np.allclose(one[k], two[k], atol=1e-5) for k in one)


def test_lm_training_reads_whole_documents(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 700))) for i in range(12)]
    sums = []
    fit = lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda encoded, *a: sums.append(encoded.agg(F.sum(F.length(encoded.columns[1]))).first()[0] // 2) or fit(encoded, *a))
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokens=64, classes=8, width=8).collect()
    assert sums == [got[0].train_tokens] and sums[0] == 701 * sum(not r.held_out for r in got)


def test_passages_keep_every_place(spark):
    own = lambda d, n: " ".join(f"d{d}x{i}" for i in range(n))
    shared = " ".join(f"shared{i}" for i in range(60))
    texts = [(1, shared), (2, " ".join([shared, own(2, 60), shared, own(3, 60), shared])), (3, own(4, 80)), (None, None), (None, f"{own(5, 30)} {shared}"), (1, shared)]
    got = substring_dedup.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.start_word, r.end_word, r.first_doc_id, r.removed) for r in got) == [
        (1, 0, 60, 1, False), (2, 0, 60, 1, True), (2, 120, 180, 1, True), (2, 240, 300, 1, True), (99, 30, 90, 1, True),
    ]


def test_secrets_in_one_long_token(spark):
    import time

    rng = np.random.default_rng(9)
    token = "".join(rng.choice(list(secrets.ALPHABET), 1_000_000))
    many = " ".join(f"token={i}abcdef" for i in range(20_000))
    model = [1000] * (len(secrets.ALPHABET) + 1) ** 2
    began = time.time()
    rows = secrets.find_secrets(spark.createDataFrame([(1, token), (2, many)], "doc_id long, text string"), model)
    got = {r[0]: (r.n, r.last) for r in rows.select("_row.doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("last")).collect()}
    assert got == {1: (1, 1_000_000), 2: (20_000, len(many))}
    assert time.time() - began < 60


def test_spans_in_blocks(spark):
    text = " ".join(["AKIA" + "A" * 20, "x" * 7] * 300)
    want = [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)]
    s = secrets.spans(F.col("t"), secrets.ACCESS, 1, "access", lambda m: F.length(m) >= 20)
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(s, lambda x: F.struct(x["start"], x["end"])).alias("s")).first().s
    assert [(x[0], x[1]) for x in got] == want


def plain_feistel(digits: list[int], radix: int, key: str) -> list[int]:
    """The network in plain Python: eight rounds, halves are the even and the odd places."""
    import xxhash

    a = list(digits)
    for r in range(pseudonyms.ROUNDS):
        other = ",".join(str(v) for i, v in enumerate(a) if i % 2 != r % 2)
        mark = hashlib.sha256(f"{key}|{r}|{len(a)}|{other}".encode()).hexdigest()
        for i in range(len(a)):
            if i % 2 == r % 2:
                seed = xxhash.xxh64_intdigest(mark.encode(), 42)
                h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed)
                a[i] = (a[i] + (h - (1 << 64) if h >> 63 else h) % radix) % radix
    return a


def test_pseudonyms_brute_force(spark):
    rng = np.random.default_rng(10)
    ssn = []
    while len(ssn) < 10_000:
        a, b, c = int(rng.integers(1, 900)), int(rng.integers(1, 100)), int(rng.integers(1, 10_000))
        if a != 666:
            ssn.append(f"{a:03d}-{b:02d}-{c:04d}")
    ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    rows = spark.createDataFrame([(i, f"ssn {s} end") for i, s in enumerate(ssn)], "doc_id long, text string")
    got = {r[0]: r[1][4:15] for r in pseudonyms.pseudonymise(rows, "k").select("_row.doc_id", "new_text").collect()}
    assert all(ok(x) for x in got.values()) and len({ssn[i] for i in got}) == len({got[i] for i in got})
    for i in range(0, 10_000, 97):
        d = [int(x) for x in ssn[i].replace("-", "")]
        while True:
            d = plain_feistel(d, 10, "k/ssn")
            s = "".join(map(str, d))
            if ok(f"{s[:3]}-{s[3:5]}-{s[5:]}"):
                break
        assert got[i] == f"{s[:3]}-{s[3:5]}-{s[5:]}"


def test_pseudonyms_move_all_dates(spark):
    import datetime

    days = [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), datetime.date(99, 5, 5), datetime.date(1600, 2, 29), datetime.date(2024, 2, 29), *[datetime.date(1, 1, 1) + datetime.timedelta(9973 * i) for i in range(366)]]
    rows = spark.createDataFrame([(i, f"on {d.isoformat()} at {d.day:02d}/{d.month:02d}/{d.year:04d}") for i, d in enumerate(days)], "doc_id long, text string")
    got = {r[0]: r[1] for r in pseudonyms.pseudonymise(rows, "k").select("_row.doc_id", "new_text").collect()}
    seen = set()
    for i, d in enumerate(days):
        a, b = got[i][3:13], got[i][17:27]
        x = datetime.date.fromisoformat(a)
        assert x != d and datetime.datetime.strptime(b, "%d/%m/%Y").date() == x
        seen.add((d, x))
    assert len({x for _, x in seen}) == len({d for d, _ in seen})


def test_pseudonyms_leave_the_rest(spark, corpus):
    """Over the whole table: what is not a valid value stays, each pseudonym has its value's form, equal values have equal ones, different ones different."""
    pattern = re.compile(pseudonyms.ANY.replace("++@", "+@"))
    forth, back = {}, {}
    for r in registry.QUERIES["op8_pseudonyms"](spark, SF).collect():
        old, new = corpus[r.doc_id], r.text
        a, b = pattern.findall(old), pattern.findall(new)
        assert pattern.split(old) == pattern.split(new) and len(a) == len(b)
        changed = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        assert len(changed) <= sum(r[f"n_{k}"] for k in pseudonyms.FORMATS)
        for x, y in changed:
            assert forth.setdefault(x, y) == y and back.setdefault(y, x) == x
            assert [c if c in "@.-/ ()+" else "" for c in x.split("@")[-1]] == [c if c in "@.-/ ()+" else "" for c in y.split("@")[-1]] or "." in x
    assert forth


@pytest.fixture(scope="module")
def stage_tables(spark):
    """Tables that every stage takes: none, nulls, repeats, long texts and columns with the stages' own names."""
    body = lambda k, n=80: " ".join(f"Word{k}x{i}" for i in range(n)) + "."
    rows = [
        (1, None, None, None, None, 7, "a", "t"), (None, body(1), "en", None, None, 7, "a", "t"), (None, body(1), "en", None, None, 7, "a", "t"), (2, "", "en", "s", 0, 7, None, "t"), (3, body(3) + "\n" + body(4), None, "s", 1, None, "a", None),
        (3, body(3) + "\n" + body(5), "en", "s", 1, 7, "a", "t"), (4, body(6, 60_000), "en", "s", 1, 7, "a", "t"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_dropped long, kept_text string, _key string"
    return spark.createDataFrame(rows, schema).cache(), spark.createDataFrame([], schema)


def test_stages_on_odd_tables(spark, stage_tables):
    import corpus_pipeline

    odd, empty = stage_tables
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, odd, SF)
        n = out.count()
        if name != "packing":
            assert out.columns == odd.columns and n <= odd.count(), name
    ids = lambda s: sorted((r.doc_id or 0) for r in s(spark, odd, SF).collect())
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["line_dedup"]) == [0, 0, 1, 2, 3, 3, 4]
    assert ids(stages["decontaminate"]) == [0, 0, 1, 2, 3, 3, 4]
    # the second of two equal rows, and one of the two empty texts, go
    assert ids(stages["simhash"]) == [0, 1, 3, 3, 4]


def test_stages_against_sql_and_brute_force(spark, duck, corpus):
    import corpus_pipeline

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality.ORACLE['op6_quality']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in stages["quality"](spark, docs, SF).select("doc_id").collect()} == kept
    want = dict(duck.sql(f"SELECT doc_id, kept_sha256 FROM ({line_dedup.ORACLE['op5_line_dedup']})").fetchall())
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages["line_dedup"](spark, docs, SF).collect()} == want
    first = {r.doc_id for r in registry.QUERIES["op4_simhash"](spark, SF).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in stages["simhash"](spark, docs, SF).collect()} == first
    leaks = {r.doc_id for r in registry.QUERIES["op9_decontaminate"](spark, SF).collect()}
    assert {r.doc_id for r in stages["decontaminate"](spark, docs, SF).collect()} == set(corpus) - leaks


def test_pipeline_run_releases_what_it_staged(spark):
    import corpus_pipeline

    before = len(common._staged)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert len(common._staged) - before <= len(corpus_pipeline.STAGES) + 1


def test_words_by_arrow_are_the_plain_words():
    import pyarrow as pa

    texts = [" a  B\t\x0bc \n", "", "   ", "É ÀB　x", "a\x1cb C\x85d", "x" * 100_000 + " Y", "ÄÖ ẞ İi"]
    words, size = lm_scoring.split_words(pa.array(["skipped", *texts])[1:])
    want = [WORDS.findall(lower(t)) for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and size.tolist() == [len(x) for x in want]
    words, size = lm_scoring.split_words(pa.array([], pa.string()))
    assert len(words) == 0 and len(size) == 0
