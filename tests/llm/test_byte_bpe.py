"""Byte-level BPE against the public library, streaming decoding against Python's own, and odd tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import byte_bpe, registry

RANKS = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
ENCODER = byte_bpe.Encoder(RANKS)
#: Without states, with few, and with as many as are reached.
FEW = [byte_bpe.Transducer(RANKS, 0), byte_bpe.Transducer(RANKS, 20), ENCODER.machine]


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i4").tolist()


def test_query(spark, public):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op11_byte_bpe"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text = r.text or ""
        found = public.encode_ordinary(text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (len(found), sha(" ".join(map(str, found))), sha(text))
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])) | st.text("abet hnos'ld\n\t 019é,.") | st.text("a ", min_size=30, max_size=300))
def test_any_text(public, text):
    assert ids(ENCODER.encode(text)) == ids(ENCODER.whole(text)) == public.encode_ordinary(text)


def test_every_character(public):
    for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)]:
        text = f"a{chr(c)}b 1{chr(c)}{chr(c)} x"
        assert ids(ENCODER.whole(text)) == public.encode_ordinary(text), hex(c)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghinorst", min_size=1, max_size=40))
def test_without_states(piece):
    want = byte_bpe.merged(piece.encode(), RANKS)
    for machine in FEW:
        assert machine.encode(piece.encode()) == machine.followed(machine.start, piece.encode()) == want


def test_bounded_lookahead():
    text = b" " + b"indistinguishability" * 200
    parts = list(ENCODER.machine.stream(text[k : k + 1] for k in range(len(text))))
    assert sum(parts, []) == byte_bpe.merged(text, RANKS)
    read = np.arange(1, len(text) + 1)
    out = np.cumsum([sum(len(ENCODER.machine.of[t]) for t in p) for p in parts[:-1]])
    assert (read - out).max() <= 3 * max(map(len, ENCODER.machine.of.values())) // 2 and (read - out).max() < 64


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=40) | st.text().map(str.encode), st.integers(1, 5))
def test_decoding_any_bytes(data, step):
    decoder = byte_bpe.Decoder({bytes((x,)): x for x in range(256)})
    got = "".join(decoder.feed(list(data[k : k + step])) for k in range(0, len(data), step)) + decoder.end()
    assert got == data.decode("utf-8", "replace")
    assert decoder.feed(b"ok") == "ok"


def test_decoding_as_it_comes():
    decoder = byte_bpe.Decoder(RANKS)
    text = "naïve 東京 🎉 done"
    got = [decoder.feed([t]) for t in ids(ENCODER.encode(text))]
    assert "".join(got) == text and "" in got and decoder.end() == ""


def test_vocabulary_is_checked(tmp_path):
    import base64

    bad = tmp_path / "bad.tiktoken"
    bad.write_text("".join(f"{base64.b64encode(bytes((x,))).decode()} {x}\n" for x in range(256)) + f"{base64.b64encode(b'abc').decode()} 256\n")
    with pytest.raises(ValueError, match="merges"):
        byte_bpe.read_ranks(str(bad))


def test_odd_rows(spark):
    long = "wörd " * 60_000
    rows = [(None, None), (1, ""), (2, long), (2, long), (3, "<|endoftext|> \n\n  x")]
    source = spark.createDataFrame(rows, "row long, text string")
    got = byte_bpe.encode_texts(source).collect()
    assert sorted((r.row or 0, len(r.ids)) for r in got) == sorted((i or 0, len(ids(ENCODER.encode(t or "")))) for i, t in rows)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(source)).collect()
    assert sorted((r.row or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert byte_bpe.decode_ids(spark.createDataFrame([(1, None)], "row long, ids array<int>")).first().text is None
    empty = spark.createDataFrame([], "row struct<a:int,ids:string>, text string")
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(empty)).columns == ["row", "text"] and not byte_bpe.encode_texts(empty).collect()
