"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours, merged on their own,
stay as they are. The transducer guesses where tokens end: a way through it has the tokens ended so
far and the bytes of an open one, and ends a token only after one it may follow. Its determinised states are
sets of ways, made when first reached and kept with their transitions; what all ways of a state agree on is emitted at once,
so output lags by a bounded number of bytes. After every byte just one way has no open token; at the end it is the result.
Decoding runs a machine over tokens whose states are the bytes of a character that is not yet whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.tiktoken"
#: States of a transducer, pairs of tokens, pieces and words of text it remembers at most.
MOST_STATES, MOST_PAIRS, MOST_PIECES, MOST_WORDS = 120_000, 300_000, 150_000, 400_000
BYTE = [bytes((x,)) for x in range(256)]
#: Bounds of the second byte of UTF-8 after these first bytes; else 80 to BF.
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}
_state: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a rank file, each a line of its bytes in base 64 and its rank; an error if they are not those of merges.

    Every byte has to be a token, and merging a token's bytes has to give that token.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    wrong = [x for x in range(256) if bytes((x,)) not in ranks] or [t for t, i in ranks.items() if merged(t, ranks) != [i]]
    if wrong:
        raise ValueError(f"no vocabulary of merges: {wrong[:3]}")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens left when the neighbours of lowest rank, leftmost first, are merged until none can be."""
    now = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        due = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(now, now[1:], strict=False)) if x + y in ranks), default=None)
        if due is None:
            return [ranks[x] for x in now]
        now[due[1] : due[1] + 2] = [now[due[1]] + now[due[1] + 1]]


class State(dict):
    """A set of ways, from the last emitted token on; maps a byte to the next state and the tokens then emitted.

    A way is its tokens, and the bytes of its open token. The last way of a state is the one without an open token.
    """

    __slots__ = ("ways",)

    def __init__(self, ways: tuple) -> None:
        self.ways = ways


class Transducer:
    """Reads the bytes of one piece of text and emits its tokens.

    A sequence of bytes has just one sequence of tokens. So of the tokens that could end at a byte one may follow the token
    before it, and if none of the others may, the one that is left does: that token is never looked at, nor is the last emitted one.
    States are made up to a bound; ways into a state beyond it are followed without making states.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES) -> None:
        self.most_states = most_states
        self.of = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        inner = {t[:k] for t in ranks for k in range(1, len(t))}
        #: of bytes that begin a token: whether longer ones do so too, and the token that they are, if any
        self.known = {t: (t in inner, ranks.get(t)) for t in inner | ranks.keys()}
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = State((((), b""),))

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a."""
        found = self.pairs.get(a << 24 | b)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a << 24 | b] = found = merged(self.of[a] + self.of[b], self.ranks) == [a, b]
        return found

    def grown(self, state: State, x: int) -> tuple[State, tuple[int, ...]]:
        """The state after a byte, made if it is new, and the tokens then emitted."""
        ways, ends = [], []
        for tokens, left in state.ways:
            more, token = self.known.get(left + BYTE[x], (False, None))
            if more:
                ways.append((tokens, left + BYTE[x]))
            if token is not None:
                ends.append((*tokens, token))
        ends.sort(key=lambda t: len(t) == 1)  # the one after the last emitted token is tried last
        ended = next((t for t in ends[:-1] if self.follows(t[-2], t[-1])), ends[-1])
        n = len(ended)
        for tokens, _ in ways:
            while tokens[:n] != ended[:n]:
                n -= 1
        key = tuple((tokens[n:], left) for tokens, left in [*ways, (ended, b"")])
        found = self.states.get(key)
        if found is None:
            self.states[key] = found = State(key)
        state[x] = found, ended[:n]
        return state[x]

    def followed(self, state: State, rest: bytes) -> list[int]:
        """The tokens from a state on, by all its ways at once; each way's tokens are a chain from the last one back."""
        known, pairs = self.known.get, self.pairs.get
        ways = []
        for tokens, left in state.ways:
            chain = None
            for t in tokens:
                chain = (chain, t)
            ways.append((chain, left))
        for x in rest:
            byte, opened, ends = BYTE[x], [], []
            for chain, left in ways:
                own = left + byte
                found = known(own)
                if found is not None:
                    if found[0]:
                        opened.append((chain, own))
                    if found[1] is not None:
                        ends.append((chain, found[1]))
            if len(ends) > 1:
                if ends[0][0] is None:
                    ends.append(ends.pop(0))
                for end in ends[:-1]:
                    fits = pairs(end[0][1] << 24 | end[1])
                    if self.follows(end[0][1], end[1]) if fits is None else fits:
                        ends = [end]
                        break
            opened.append((ends[-1], b""))
            ways = opened
        chain, out = ways[-1][0], []
        while chain is not None:
            chain, token = chain
            out.append(token)
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        state, out = self.start, []
        for k, x in enumerate(piece):
            found = state.get(x)
            if found is None:
                if len(self.states) >= self.most_states:
                    return out + self.followed(state, piece[k:])
                found = self.grown(state, x)
            state, got = found
            if got:
                out += got
        return [*out, *state.ways[-1][0]]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """The tokens of one piece that comes in chunks: after each chunk those that are certain, then the rest."""
        state = self.start
        for chunk in chunks:
            out: list[int] = []
            for x in chunk:
                state, got = state.get(x) or self.grown(state, x)
                out += got
            yield out
        yield list(state.ways[-1][0])


class _Beside(Exception):
    """A text has white space beside a space: its words cannot be encoded one by one."""


class _Words(dict):
    """Ids of words, each after `before`; encodes a word when first asked for it."""

    def __init__(self, before: str, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.before, self.encode = before, encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Beside
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = found = self.encode(self.before + word)
        return found


class Encoder:
    """Ids of whole texts, little-endian 32-bit; each match of the pattern goes through the transducer by itself.

    The pattern always cuts before a space between two characters that are not white space, so such a text is
    the sequence of its words, each with its space; words are remembered. Other texts are cut as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None) -> None:
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.pieces = regex.compile(pattern).finditer
        self.machine, self.seen = Transducer(ranks), {}
        self.first, self.known = _Words("", self.whole), _Words(" ", self.whole)

    def whole(self, text: str) -> bytes:
        out, seen = [], self.seen
        # letters and a space before them are one piece
        for piece in [text] if text.isascii() and text.removeprefix(" ").isalpha() else [m[0] for m in self.pieces(text)]:
            ids = seen.get(piece)
            if ids is None:
                if len(seen) >= MOST_PIECES:
                    seen.clear()
                seen[piece] = ids = array("i", self.machine.encode(piece.encode())).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        head, *words = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.known.__getitem__, words))
        except _Beside:
            return self.whole(text)


def utf8_step(held: bytes, x: int) -> tuple[bytes, str]:
    """After a byte: the bytes of a character not yet whole, and the text given out; a broken sequence is U+FFFD."""
    if not held:
        if x < 0x80:
            return b"", chr(x)
        return (bytes([x]), "") if 0xC2 <= x <= 0xF4 else (b"", "�")
    low, high = SECOND.get(held[0], (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
    if not low <= x <= high:
        after, text = utf8_step(b"", x)
        return after, "�" + text
    held += bytes([x])
    need = 2 + (held[0] >= 0xE0) + (held[0] >= 0xF0)
    return (b"", held.decode()) if len(held) == need else (held, "")


class _Held(dict):
    """The machine's state with these bytes held back: maps a token to the next state and the text given out."""

    def __init__(self, owner: Decoder, held: bytes) -> None:
        super().__init__()
        self.owner, self.held = owner, held

    def __missing__(self, token: int) -> tuple[_Held, str]:
        held, text = self.held, ""
        for x in self.owner.of[token]:
            held, more = utf8_step(held, x)
            text += more
        self[token] = found = self.owner.state(held), text
        return found


class Decoder:
    """Text of tokens as they come; at most three bytes are held back. An unknown token is an error."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of = {i: t for t, i in ranks.items()}
        self.states: dict[bytes, _Held] = {}
        self.now = self.state(b"")
        #: tokens that are whole characters, which leave the first state as it is
        self.whole = {}
        for t in self.of:
            after, text = self.now[t]
            if after is self.now and "�" not in text:
                self.whole[t] = text

    def state(self, held: bytes) -> _Held:
        if held not in self.states:
            self.states[held] = _Held(self, held)
        return self.states[held]

    def feed(self, tokens: Sequence[int]) -> str:
        now, out = self.now, []
        if not now.held:
            try:
                return "".join(map(self.whole.__getitem__, tokens))
            except KeyError:
                pass
        for t in tokens:
            now, text = now[t]
            out.append(text)
        self.now = now
        return "".join(out)

    def end(self) -> str:
        """What is left of a character that never became whole; the decoder can then be used anew."""
        left, self.now = self.now.held, self.state(b"")
        return "�" if left else ""


def _local(kind: type, sent):
    if _state.get(kind, (None,))[0] != sent.id:
        _state[kind] = (sent.id, kind(sent.value))
    return _state[kind][1]


class _Sent:
    """A broadcast vocabulary and a name for it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if path not in _state:
            _state[path] = read_ranks(path)
        self.ranks, self.id = spark.sparkContext.broadcast(_state[path]), path

    @property
    def value(self) -> dict[bytes, int]:
        return self.ranks.value


def _encoded(texts: pa.Array, own: Encoder) -> pa.ListArray:
    found = [own.encode(t) for t in texts.to_pylist()]
    ends = np.append(0, np.cumsum([len(x) // 4 for x in found])).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<i4")))


def _decoded(ids: pa.ListArray, own: Decoder) -> pa.Array:
    found = (ids[k].values for k in range(len(ids)))
    return pa.array([None if x is None else own.feed(x.to_numpy().tolist()) + own.end() for x in found], pa.string())


def _type(df: DataFrame) -> str:
    return df.schema["row"].dataType.simpleString()


def encode_texts(texts: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """texts(row, text) with ids (array of int) in place of text; row is anything. decoded: also text, decoded from the ids in the same pass.

    Null and empty texts have no ids. Very long texts are encoded whole. Rows are encoded one by one, so repeated rows
    give repeated rows. An empty table gives an empty table.
    """
    sent = _Sent(texts.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.parts(batches):
            ids = _encoded(b.column(1), _local(Encoder, sent))
            more = [_decoded(ids, _local(Decoder, sent))] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *more], ["row", "ids", "text"][: 2 + decoded])

    source = texts.select("row", C.text_or_empty().alias("text"))
    return source.mapInArrow(run, f"row {_type(source)}, ids array<int>" + ", text string" * decoded)


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(row, ids) with text in place of ids. Null ids give a null text, no ids the empty one."""
    sent = _Sent(encoded.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _decoded(b.column(1), _local(Decoder, sent))], ["row", "text"])

    return encoded.select("row", "ids").mapInArrow(run, f"row {_type(encoded)}, text string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text they decode to, of every row."""
    docs = C.read(spark, sf_dir, "documents")
    done = encode_texts(docs.select(F.col("doc_id").alias("row"), "text"), decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return done.select(F.col("row").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


ORACLE: dict[str, str] = {}
