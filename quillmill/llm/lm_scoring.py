"""Scoring of whole documents by a gated recurrent language model learned from the corpus.

Word counts come from every training document and stay distributed; frequent words, bounded in
number, go to all executors, the counts of all others are joined. The recurrent model reads the most
frequent words and one token for all others, whose own probabilities given that token come from
the counts. It trains on every token of every training document, in consecutive windows between which
the state is carried; shards train from the same start and their parameters are averaged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .gru import Model, keep_freed_memory

#: Words whose counts are sent to all executors at most, tokens of the recurrent model, and its sizes.
MOST_WORDS, TOKENS, CLASSES, WIDTH = 262_144, 4096, 64, 24
#: Documents of a shard, its tokens at most (about), and rounds of averaging.
PER_SHARD, SHARD_TOKENS, ROUNDS, RATE = 20_000, 6_000_000, 2, 0.02
#: Bytes of text whose words a task holds at once.
TEXT_BYTES = 16_000_000
END = b""
_state: dict = {}


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text (null: empty), modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, in order, and how many each text has: runs without ASCII white space, A-Z lower-cased."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = pieces.flatten(), pieces.offsets.to_numpy()
    ends = ends - ends[0]
    word = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    before = np.append(0, np.cumsum(word.to_numpy(zero_copy_only=False)))
    return flat.filter(word), np.diff(before[ends])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of texts, and of their ends (the empty word)."""
    for b in C.parts(batches, 0, TEXT_BYTES):
        found = pc.value_counts(split_words(b.column(0))[0])
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([b.num_rows], pa.int64())], ["word", "n"])


class Vocabulary:
    """Words with counts, most frequent first, and the recurrent model's tokens among them.

    Token 0 stands for all other words, token 1 ends a document; each is a class of its own.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, tokens: int, classes: int) -> None:
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.words = [words[k] for k in order if words[k] != END]
        by_word = dict(zip(words, counts, strict=True))
        self.counts = np.array([by_word[w] for w in self.words], np.int64)
        self.total, self.distinct, self.ends = total, distinct, by_word.get(END, 0)
        inside = min(len(self.words), tokens - 2)
        self.token = np.where(np.arange(len(self.words)) < inside, np.arange(len(self.words)) + 2, 0)
        known = self.counts[:inside]
        self.other = total - self.ends - int(known.sum())
        self.other_distinct = distinct - inside - (self.ends > 0)
        self.token_counts = np.concatenate([[self.other, self.ends], known]).astype(np.float64)
        # classes of about equal mass of the root of the counts
        mass = np.cumsum(np.sqrt(known + 1.0))
        cuts = np.searchsorted(mass, np.linspace(0, mass[-1], classes - 1)[1:-1]) + 3 if inside else []
        self.bounds = np.unique(np.concatenate([[0, 1], [2] if inside else [], cuts, [2 + inside]]).astype(np.int64))

    def index(self) -> pa.Array:
        """The words, to look others up in."""
        return pa.array(self.words, pa.binary()).cast(pa.string())


def _local(key: str, make):
    """What make() gives, kept in the worker until another key is asked for."""
    if _state.get("key") != key:
        _state.clear()
        _state.update(key=key, value=make())
    return _state["value"]


_ENCODED = "mark long, tokens binary, n_tokens long, n_known long, base double, more double, rare array<binary>"


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _encoded(sent, key: str):
    """Of each text its tokens to the end, a hash of its id and tokens that deals it out, what its sent words
    add to both scores, and its words that were not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        index = _local(key, v.index)
        many = len(v.words)  # the place of words that were not sent; the end has the next one
        token = np.concatenate([v.token, [0, 1]])
        logs = np.log10(np.concatenate([v.counts, [0, v.ends]]) + 1.0)
        known = np.concatenate([np.ones(many, np.int64), [0, int(v.ends > 0)]])
        # a word among all others: its own share of their mass
        more = np.where(token == 0, logs - math.log10(v.other + v.other_distinct + 1), 0.0)
        scale = math.log10(v.total + v.distinct + 1)
        for b in C.parts(batches, 1, TEXT_BYTES // 2):
            words, size = split_words(b.column(1))
            n = size + 1
            ends = np.cumsum(n)
            first = ends - n
            place = pc.fill_null(pc.index_in(words, value_set=index), many).to_numpy()
            at = np.full(int(n.sum()), many + 1)
            inner = np.ones(len(at), bool)
            inner[ends - 1] = False
            at[inner] = place
            far = np.flatnonzero(place == many)
            flat = token[at].astype(np.uint16).tobytes()
            row = b.column(0)
            ids = row.field("doc_id").to_pylist()
            mark = [xxhash.xxh3_64_intdigest(str(i).encode() + b" " + flat[2 * x : 2 * y]) >> 1 for i, x, y in zip(ids, first.tolist(), ends.tolist(), strict=True)]
            rare = np.searchsorted(far, np.append(np.cumsum(size) - size, len(words))).astype(np.int32)
            cols = [
                row, pa.array(mark, pa.int64()), _binary(2 * n, flat), pa.array(n), pa.array(np.add.reduceat(known[at], first)),
                pa.array(np.add.reduceat(logs[at], first) - scale * n), pa.array(np.add.reduceat(more[at], first)), pa.ListArray.from_arrays(rare, words.take(pa.array(far)).cast(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row", *(x.split()[0] for x in _ENCODED.split(", "))])

    return run


def round_of(shards: int, rounds: int) -> Column:
    """The round that a document's mark puts it in, apart from its shard: an exact division, for marks have 63 bits."""
    return F.pmod(F.expr(f"mark div {shards}"), F.lit(rounds))


def fit(encoded: DataFrame, vocabulary: Vocabulary, shards: int, rounds: int, width: int) -> Model:
    """Rounds of: every shard trains on its part from the same parameters, which are then averaged by tokens seen.

    encoded has mark and tokens. A round takes its part of the documents, all of them once over all rounds, each whole. Each shard is a partition of
    its own. Only sums of parameters move, along a tree; the driver holds one such sum.
    """
    model = Model(vocabulary.token_counts, vocabulary.bounds, width)
    sc = encoded.sparkSession.sparkContext
    for k in range(rounds):
        sent = sc.broadcast(model)
        part = encoded.where(round_of(shards, rounds) == k)
        own = part.repartitionById(shards, F.pmod("mark", F.lit(shards)).cast("int")).sortWithinPartitions("mark", "tokens").select("tokens")

        def train(rows, sent=sent, k=k):
            keep_freed_memory()
            found = [np.frombuffer(r[0], np.uint16) for r in rows]
            if found:
                m = Model.__new__(Model)
                m.__dict__.update(sent.value.__dict__)
                seen = m.train(found, 1, rate=RATE / (k + 1))
                yield m.flat().astype(np.float64) * seen, seen

        sums = own.rdd.mapPartitions(train)
        total, seen = sums.treeAggregate((0.0, 0), lambda a, x: (a[0] + x[0], a[1] + x[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        if seen:
            model.load((total / seen).astype(np.float32))
    return model


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        keep_freed_memory()
        for b in C.parts(batches):
            got = model.score([np.frombuffer(t, np.uint16) for t in b.column(1).to_pylist()], 1) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 2, 3, 4)), pa.array(got + b.column(5).to_numpy())], ["row", "n_tokens", "n_known", "base", "score"])

    return run


def score_documents(docs: DataFrame, most_words: int = MOST_WORDS, tokens: int = TOKENS, classes: int = CLASSES, width: int = WIDTH, per_shard: int = PER_SHARD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; null and empty texts are the end alone. Rows
    are learned from and scored one by one, so repeated rows count repeatedly. A very long text is one document: its words
    are held at once, its states window by window. Without training rows every
    word is unknown. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("doc_id"), held_out().alias("held_out"), C.text_or_empty().alias("text"))
    learn = texts.where(~F.col("held_out"))
    counts = C.stage(learn.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    # the least count whose words, with all more frequent ones, are few enough to send
    least, many = 1, 0
    for r in counts.where("word <> X''").groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).toLocalIterator():
        many += r["m"]
        if many > most_words:
            least = r["n"] + 1
            break
    sent_words = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).toArrow()
    vocabulary = Vocabulary(sent_words["word"].to_pylist(), sent_words["n"].to_pylist(), total, distinct, tokens, classes)
    sc = spark.sparkContext
    key = f"{sc.applicationId}-{id(vocabulary)}-{total}-{distinct}"
    marked = texts.select(F.struct(F.monotonically_increasing_id().alias("at"), "doc_id", "held_out").alias("row"), "text")
    row = f"struct<at:bigint,doc_id:{dict(docs.dtypes)['doc_id']},held_out:boolean>"
    # the text is read once for both: tokens to train on and to score
    encoded = C.stage(marked.mapInArrow(_encoded(sc.broadcast(vocabulary), key), f"row {row}, {_ENCODED}"), "encoded")
    to_learn = encoded.where(~F.col("row.held_out")).select("mark", "tokens")
    rows = learn.count()
    model = fit(to_learn, vocabulary, max(1, -(-rows // per_shard), -(-total // SHARD_TOKENS)), rounds, width)
    scored = C.stage(encoded.select("row", "tokens", "n_tokens", "n_known", "base", "more").mapInArrow(_score(sc.broadcast(model)), f"row {row}, n_tokens long, n_known long, base double, score double"), "scored")
    rare = encoded.select("row.at", F.explode("rare").alias("word")).join(counts.where(F.col("n") < least), "word", "left")
    logs = F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("logs")
    sums = rare.groupBy("at").agg(logs, F.count("n").alias("known"))
    done = scored.join(sums.withColumnRenamed("at", "_at"), F.col("row.at") == F.col("_at"), "left")
    more, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return done.select("row.doc_id", "row.held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
