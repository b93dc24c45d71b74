"""Substring dedup by paragraph MinHash banding, and by paragraphs of fixed width for passages inside texts.

A paragraph is a line of at least LEAST_LINE words, or a run of shorter lines. Paragraphs get MinHash
signatures over their 5-word shingles; bands are tuned for recall; those that share a band key
are verified by the exact Jaccard similarity of their shingle sets, and linked ones clustered by components.

Passages that keep to no line are found by windows: the WIDTH words from an anchor on, where
anchors are the places whose shingle has the least hash among SPAN neighbours. SPAN + WIDTH - 1 words that two
documents share hold a window that begins at the same word in both. Equal windows (128 bits) align a
document with the first and with the last that hold them; runs of such windows are extended, word by
word, to the whole passage shared. A Bloom filter over band and window keys lets only those that can repeat be shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import running_hashes
from .line_dedup import filter_bits, in_filter, twice_seen

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Words from which a line is a paragraph of its own; paragraphs of fewer are not compared.
LEAST_LINE = 20
WIDTH, SPAN = 26, 26
#: Words by which a run may be extended. The outermost window of a passage lies within SPAN - 1 words of its end; where an
#: earlier document holds a part of it, that part's windows are in another run, and the next window within twice that.
CONTEXT = SPAN + WIDTH - 1
#: A passage has over 50 words.
LEAST = 51
TILE = 256
#: Characters whose words are hashed at once.
CHARS = 1 << 20
_state: dict = {}


def tune_bands(similarity: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """The fewest bands of `rows` hashes that let a pair of this similarity collide with this probability."""
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
    return bands, rows


BANDS, ROWS = tune_bands(SIMILARITY, RECALL)
_MULTIPLIERS = (np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of every window of width values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is part of a word (a letter, a digit, a connector), and its hash."""
    if "chars" not in _state:
        inside = np.fromiter((chr(k).isalnum() or k == 95 for k in range(0x110000)), bool, 0x110000)
        _state["chars"] = inside, mixed(np.arange(1, 0x110001, dtype=np.uint64))
    return _state["chars"]


def powers(n: int) -> np.ndarray:
    if len(_state.get("powers", ())) < n:
        with np.errstate(over="ignore"):
            _state["powers"] = np.multiply.accumulate(np.full(max(64, 2 * n), _BASE))
    return _state["powers"]


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of values, in order: runs follow each other without a gap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(values * powers(int(lengths.max()))[at], starts) + lengths.astype(np.uint64))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of the lower-cased text: its hash, and how many line ends stand before it."""
    inside, of = _tables()
    hashes, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    text, at, before = text.lower(), 0, 0
    while at < len(text):
        end = at + CHARS
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):  # no word is cut
            end += 1
        points = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4")
        mine = inside[points]
        edges = np.flatnonzero(np.diff(mine, prepend=False, append=False))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        hashes.append(run_hashes(of[points[mine]], np.cumsum(lengths) - lengths, lengths))
        breaks = np.cumsum(points == 10)
        lines.append(before + breaks[starts])
        before += int(breaks[-1])
        at = end
    return np.concatenate(hashes), np.concatenate(lines)


class Features:
    """Windows and paragraphs of a list of texts, as flat arrays: each has its text and word positions."""

    def __init__(self, texts: list[str]) -> None:
        found = [words_of(t) for t in texts]
        size = np.array([len(w) for w, _ in found], np.int64)
        words = np.concatenate([*(w for w, _ in found), np.zeros(SHINGLE, np.uint64)])
        lines = np.concatenate([*(x for _, x in found), np.zeros(0, np.int64)])
        first = np.cumsum(size) - size
        text = np.repeat(np.arange(len(texts)), size)
        self.hashes = mixed(running_hashes(words, SHINGLE))  # at each word, of it and the next ones
        self.size = size
        self._windows(size, first, text)
        self._paragraphs(text, lines, first)

    def _windows(self, size: np.ndarray, first: np.ndarray, text: np.ndarray) -> None:
        n = len(text)
        inside = np.arange(n) - first[text]
        fits = size[text] - inside  # words from here to the text's end
        keep = np.zeros(n, bool)
        if n >= SPAN:
            low = sliding(self.hashes[:n], SPAN, np.minimum)
            low = np.where(fits[: len(low)] >= SPAN + SHINGLE - 1, low, np.uint64(0))
            pad = np.zeros(SPAN - 1, np.uint64)
            keep = (sliding(np.concatenate([pad, low, pad]), SPAN, np.maximum) == self.hashes[:n]) & (fits >= SHINGLE)
        keep |= (inside == 0) | (fits == WIDTH)
        at = np.flatnonzero(keep & (fits >= WIDTH))
        self.window_text, self.window_at = text[at], inside[at]
        one, two = np.zeros(len(at), np.uint64), np.ones(len(at), np.uint64)
        for k in (*range(0, WIDTH - SHINGLE, SHINGLE), WIDTH - SHINGLE):
            h = self.hashes[at + k]
            one, two = mixed(one ^ h), mixed(two + h)
        self.window_key, self.window_check = one, two

    def _paragraphs(self, text: np.ndarray, lines: np.ndarray, first: np.ndarray) -> None:
        n = len(text)
        new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(lines) != 0))) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(new, n))
        long = length >= LEAST_LINE
        own = np.append(True, (np.diff(text[new]) != 0) | long[1:] | long[:-1]) if n else np.zeros(0, bool)
        start = new[own]
        length = np.diff(np.append(start, n))
        enough = length >= LEAST_LINE
        start, length = start[enough], length[enough]
        self.text, self.start, self.length = text[start], start - first[text[start]], length
        many = length - (SHINGLE - 1)
        self.offset = np.append(0, np.cumsum(many))
        at = np.repeat(start - self.offset[:-1], many) + np.arange(self.offset[-1])
        self.shingles = self.hashes[at]
        self.keys = np.zeros((len(start), BANDS), np.uint64)
        if not len(start):
            self.whole = np.zeros(0, np.uint64)
            return
        self.whole = run_hashes(self.shingles, self.offset[:-1], many)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                key = np.full(len(start), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mixed(key ^ np.minimum.reduceat(self.shingles * _MULTIPLIERS[b * ROWS + r], self.offset[:-1]))
                self.keys[:, b] = key

    def all_keys(self) -> np.ndarray:
        """The keys of windows and bands, each once for a text."""
        keys = np.concatenate([self.window_key, self.keys.ravel()])
        text = np.concatenate([self.window_text, np.repeat(self.text, BANDS)])
        order = np.lexsort((text, keys))
        keys, text = keys[order], text[order]
        return keys[np.append(True, (np.diff(keys) != 0) | (np.diff(text) != 0))] if len(keys) else keys


def _keys(texts: list[str]) -> np.ndarray:
    return Features(texts).all_keys()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


_FOUND = "id long, tag long, at long, until long, whole long, more long, keys array<long>, shingles binary"


def _suspects(sent):
    """Windows (no keys; until is their text's end) and paragraphs whose keys the filter has seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.parts(batches, 2):
            ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            f = Features(b.column(2).to_pylist())
            hit = np.flatnonzero(in_filter(sent.value, f.window_key))
            text, at = f.window_text[hit], f.window_at[hit]
            none = np.zeros(len(hit) + 1, np.int32)
            cols = [_long(ids[text]), _long(tags[text]), _long(at), _long(f.size[text]), _long(f.window_key[hit]), _long(f.window_check[hit])]
            empty = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(none), pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(none, pa.array([], pa.int64())), empty], _names(_FOUND))
            hit = np.flatnonzero(in_filter(sent.value, f.keys.ravel()).reshape(f.keys.shape).any(axis=1))
            sets = [np.unique(f.shingles[f.offset[k] : f.offset[k + 1]]) for k in hit.tolist()]
            ends = np.append(0, np.cumsum([8 * len(x) for x in sets])).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(x.tobytes() for x in sets))])
            text, at = f.text[hit], f.start[hit]
            cols = [_long(ids[text]), _long(tags[text]), _long(at), _long(at + f.length[hit]), _long(f.whole[hit]), _long(f.length[hit])]
            keys = pa.ListArray.from_arrays((BANDS * np.arange(len(hit) + 1)).astype(np.int32), _long(f.keys[hit].ravel()))
            yield pa.RecordBatch.from_arrays([*cols, keys, data], _names(_FOUND))

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _verified(similarity: float):
    """Links of the paragraphs of each tile pair (rows in order of key, _a, _b) that are similar enough."""

    def group(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        sets = [(w, len(s) // 8, np.frombuffer(s, np.uint64)) for w, s in rows]
        held: dict[int, frozenset] = {}
        root, out = list(range(len(sets))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def common(i: int, j: int) -> int:
            if max(sets[i][1], sets[j][1]) > 4096:
                return len(np.intersect1d(sets[i][2], sets[j][2], assume_unique=True))
            for k in (i, j):
                if k not in held:
                    held[k] = frozenset(sets[k][2].tolist())
            return len(held[i] & held[j])

        for i, (w, n, _) in enumerate(sets):
            for j in range(i):
                m = sets[j][1]
                if min(n, m) >= similarity * max(n, m) and (p := find(i)) != (q := find(j)):
                    both = common(i, j)
                    if both >= similarity * (n + m - both):
                        root[max(p, q)] = min(p, q)
                        out.append((w, sets[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            out = []
            for key, a, z, w, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, a, z) != now:
                    out += group(rows)
                    now, rows = (key, a, z), []
                rows.append((w, s))
            yield batch(out)
        yield batch(group(rows))

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each place asked for: the words before it (side 0, backwards) or from it on (side 1)."""
    for b in C.parts(batches, 2):
        ids, tags = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        out: list[tuple] = []
        for k, (text, asked) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            words = words_of(text)[0].astype(np.uint32).view(np.int32)
            out += [(ids[k], tags[k], x, (words[max(0, (x >> 1) - CONTEXT) : x >> 1][::-1] if x & 1 == 0 else words[x >> 1 : (x >> 1) + CONTEXT]).tolist()) for x in asked]
        types = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["_id", "_tag", "_place", "context"])


def keyed(docs: DataFrame) -> DataFrame:
    """id, tag (a hash of the text), text: a row of docs is known by id and tag; equal rows are one."""
    return docs.select(C.id_or_last().alias("id"), F.xxhash64(C.text_or_empty()).alias("tag"), C.text_or_empty().alias("text"))


def suspects(docs: DataFrame, bits_per_doc: int = 1024, most_bits: int = 1 << 30) -> DataFrame:
    """Staged windows and paragraphs that may repeat. The filter's size follows the row count up to most_bits, which bounds the broadcast."""
    texts = keyed(docs)
    bits = filter_bits(docs.count(), bits_per_doc, most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(texts.select("text"), _keys, bits))
    return C.stage(texts.mapInArrow(_suspects(sent), _FOUND), "paragraphs")


def similar_paragraphs(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, tag, at, until, class_id, first (struct id, tag, at) of each paragraph whose class is found in two or more doc_ids."""
    own = found.where(F.size("keys") > 0)
    shared = C.tiled(own.select("whole", F.explode("keys").alias("key")).distinct(), "key", ["whole"], TILE, least=2).select("key", "_a", "_b", "whole")
    shared = C.stage(shared, "shared")
    # shingles follow only those that share a key with another paragraph
    sets = own.join(shared.select("whole").distinct(), "whole", "left_semi").groupBy("whole").agg(F.any_value("shingles").alias("shingles"))
    dealt = shared.join(sets, "whole").select("key", "_a", "_b", "whole", "shingles").repartition("key", "_a", "_b").sortWithinPartitions("key", "_a", "_b", "whole")
    parts = C.connected_components(dealt.mapInArrow(_verified(similarity), "u long, v long"))
    placed = own.join(parts, F.col("whole") == F.col("node"), "left").select("id", "tag", "at", "until", F.coalesce("component", "whole").alias("class_id"))
    return _owned(C.stage(placed, "classes"), ["class_id"]).drop("last")


def _owned(placed: DataFrame, keys: list[str]) -> DataFrame:
    """placed with the first and last place of each class that is found in two or more doc_ids."""
    place = F.struct("id", "tag", "at")
    owners = placed.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.id < last.id")
    # staged, so that both sides of the join have an exchange of their own and a common class's rows can be split
    return placed.join(C.stage(owners, "owners"), keys)


def _shared_length(a: Column, b: Column) -> Column:
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("long")


def shared_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, tag, at, until, class_id, first_id, removed of each run of words whose windows all stand in another document too.

    Runs of windows that an earlier doc_id holds are apart from those that the document is the first to hold. An end
    is moved outwards by the words that the run shares there with the first or the last holder of its outermost window.
    """
    windows = found.where(F.size("keys") == 0).select("id", "tag", "at", F.col("until").alias("size"), F.col("whole").alias("class_id"), "more")
    owned = _owned(windows, ["class_id", "more"]).withColumn("removed", F.col("id") > F.col("first.id"))
    order = Window.partitionBy("id", "tag", "removed").orderBy("at", "class_id")
    marked = owned.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(order) + WIDTH, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    holders = F.struct("first", "last")
    runs = marked.groupBy("id", "tag", "removed", "run").agg(
        F.min("at").alias("at"), (F.max("at") + WIDTH).alias("until"), F.max("size").alias("size"), F.min_by("class_id", "at").alias("class_id"),
        F.min("first.id").alias("first_id"), F.min_by(holders, "at").alias("head"), F.max_by(holders, "at").alias("tail"),
    )
    runs = C.stage(runs, "runs")
    # of each end that is not a text's: its place, and that of the same words at the holders; places are
    # written as twice the word, and one for what follows
    key = ["id", "tag", "removed", "run"]
    places = lambda side, shift: F.array(*[F.struct(F.col(f"{side}.{h}.id").alias("id"), F.col(f"{side}.{h}.tag").alias("tag"), ((F.col(f"{side}.{h}.at") + shift) * 2 + int(shift > 0)).alias("place")) for h in ("first", "last")])
    heads = runs.where("at > 0").select(*key, (F.col("at") * 2).alias("place"), F.explode(places("head", 0)).alias("to"))
    tails = runs.where("until < size").select(*key, (F.col("until") * 2 + 1).alias("place"), F.explode(places("tail", WIDTH)).alias("to"))
    ends = heads.unionByName(tails).where(~((F.col("to.id") == F.col("id")) & (F.col("to.tag") == F.col("tag")) & (F.col("to.place") == F.col("place"))))
    ends = ends.select(*key, "place", F.col("to.id").alias("to_id"), F.col("to.tag").alias("to_tag"), F.col("to.place").alias("to_place")).distinct()
    ends = C.stage(ends, "ends")
    asked = ends.select("id", "tag", "place").unionByName(ends.select(F.col("to_id").alias("id"), F.col("to_tag").alias("tag"), F.col("to_place").alias("place")))
    asked = asked.groupBy("id", "tag").agg(F.collect_set("place").alias("places"))
    texts = keyed(docs).join(asked, ["id", "tag"]).select("id", "tag", "text", "places")
    contexts = C.stage(texts.mapInArrow(_contexts, "_id long, _tag long, _place long, context array<int>").dropDuplicates(["_id", "_tag", "_place"]), "contexts")
    at_place = lambda i, t, p: (F.col("_id") == F.col(i)) & (F.col("_tag") == F.col(t)) & (F.col("_place") == F.col(p))
    both = ends.join(contexts, at_place("id", "tag", "place")).drop("_id", "_tag", "_place").withColumnRenamed("context", "mine")
    both = both.join(contexts, at_place("to_id", "to_tag", "to_place"))
    more = both.select(*key, (F.col("place") % 2).alias("side"), _shared_length(F.col("mine"), F.col("context")).alias("n"))
    grown = more.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("b"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("a"))
    wide = runs.drop("head", "tail", "size").join(grown, key, "left")
    return wide.select("id", "tag", (F.col("at") - F.coalesce("b", F.lit(0))).alias("at"), (F.col("until") + F.coalesce("a", F.lit(0))).alias("until"), "class_id", "first_id", "removed")


def passages(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, **options: int) -> DataFrame:
    """doc_id, start_word, end_word, class_id, first_doc_id, removed: repeated passages of documents, of `least` words or more.

    A passage is made up of runs of shared words and of paragraphs similar to one elsewhere that
    touch; what the document is the first to hold is apart from what a smaller doc_id holds, and that alone is removed.
    class_id is that of its first window or paragraph, first_doc_id the smallest holder of any. A passage must be
    found in two doc_ids: all its places count then, in one document too.
    Words are runs of letters, digits and connectors, lower-cased. Shorter texts, null and empty ones
    have no passage; all null doc_ids are one document, the last; rows that share a doc_id are one document, and
    equal rows count once. A very long text is hashed in blocks of CHARS characters; its words' hashes are held at once. Ties go by
    id, text hash and place. An empty table gives an empty table.
    """
    found = suspects(docs, **options)
    both = similar_paragraphs(found, similarity).select("id", "tag", "at", "until", "class_id", F.col("first.id").alias("first_id"), (F.col("id") > F.col("first.id")).alias("removed"))
    both = both.unionByName(shared_passages(docs, found))
    own = Window.partitionBy("id", "tag", "removed").orderBy("at", "until", "class_id")
    reach = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = both.withColumn("new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(own))
    ends = joined.groupBy("id", "tag", "removed", "island").agg(F.min("at").alias("start_word"), F.max("until").alias("end_word"), F.min("first_id").alias("first_id"), F.min_by("class_id", F.struct("at", "class_id")).alias("class_id")).where(F.col("end_word") - F.col("start_word") >= least)
    # a window may be an anchor in later holders alone: what stands inside a removed passage is not kept as a passage of its own
    inside = Window.partitionBy("id", "tag").orderBy("start_word", F.desc("removed"), F.desc("end_word"), "class_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("gone", F.max(F.when(F.col("removed"), F.col("end_word"))).over(inside)).where(F.col("removed") | F.col("gone").isNull() | (F.col("gone") < F.col("end_word")))
    return ends.select(C.id_back(F.col("id")).alias("doc_id"), "start_word", "end_word", "class_id", C.id_back(F.col("first_id")).alias("first_doc_id"), "removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(C.read(spark, sf_dir, "documents"))
