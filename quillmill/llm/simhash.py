"""SimHash near-dedup: shard trees keyed by Hamming distance, and components of their links.

Fingerprints within the radius agree on some set of blocks of bits (pigeonhole), so one shard for
each block set and value holds every pair that can link. In a shard a Burkhard-Keller tree keys each
child by its integer Hamming distance to the parent, and a search follows only the edges within the
radius. Trees are built and searched for all shards of a partition at once. A shard above the tile
size is split into pairs of tiles, and the more fingerprints there are the more blocks make up a
shard's key. Copies share one fingerprint and meet once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a tile at most (about), expected in a shard at most, and pairs searched at a time.
TILE, IN_SHARD, FRONTIER = 4096, 256, 400_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the text's word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = max(1, len(words) - width + 1)
    buf, digest = b" ".join(words), xxhash.xxh64_digest
    a, z = starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 100_000):
        got = b"".join([digest(buf[i:j], SEED) for i, j in zip(a[k : k + 100_000], z[k : k + 100_000], strict=True)])
        ones += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["id", "fp"])


def forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees over distinct fingerprints; root: of each item, the first item of its shard.

    Returns edge keys 65 * parent + distance, ascending, and the child under each.
    """
    todo = np.flatnonzero(root != np.arange(len(fp)))
    at = root[todo]
    keys, children = [], []
    while len(todo):
        key = at * 65 + np.bitwise_count(fp[todo] ^ fp[at])
        found, first, back = np.unique(key, return_index=True, return_inverse=True)
        child = todo[first]
        keys.append(found)
        children.append(child)
        down = child[back]
        rest = down != todo
        todo, at = todo[rest], down[rest]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key, kind="stable")
    return key[order], child[order]


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give both ends of each link the same, smallest, label."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := label[label], label):
            label[:] = flat


def linked(fp: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """Of each item, the first item it reaches in its shard by links of at most radius bits."""
    keys, children = forest(fp, root)
    label = np.arange(len(fp))
    stack = [(np.arange(len(fp)), root)]
    while stack:
        q, node = stack.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            stack += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = (d <= radius) & (q != node)
        unite(label, q[hit], node[hit])
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
        n = hi - lo
        if n.any():
            edge = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            nq, nn = np.repeat(q, n), children[edge]
            before = nn < nq  # later items search for earlier ones
            stack.append((nq[before], nn[before]))
    return label


def _search(radius: int):
    def solve(fp: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, shard[1:] != shard[:-1])
        root = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
        label = linked(fp, root, radius)
        ends = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[ends].view(np.int64)), pa.array(fp[label[ends]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, shards, held = [], [], 0
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            shard = np.fromiter(map(hash, zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)), np.int64, b.num_rows)
            fps.append(fp)
            shards.append(shard)
            held += len(fp)
            if held >= 200_000:
                fp, shard = np.concatenate(fps), np.concatenate(shards)
                cut = np.flatnonzero(shard[1:] != shard[:-1])
                cut = cut[-1] + 1 if len(cut) else 0
                if cut:
                    yield solve(fp[:cut], shard[:cut])
                fps, shards, held = [fp[cut:]], [shard[cut:]], len(fp) - cut
        if held:
            yield solve(np.concatenate(fps), np.concatenate(shards))

    return run


def masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which any two fingerprints within the radius agree on at least one."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if rows / 2.0 ** (64 * (blocks - radius) / blocks) <= IN_SHARD:
            break
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << i for i in range(a, z)) for a, z in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - radius)]


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links u, v of distinct fingerprints (column fp, long): within the radius u and v always end in one component."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(prints.count(), radius)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)]))
    tiles = C.tiled(prints.select("fp", keys.alias("key")), "key", ["fp"], tile).select("fp", "key", "_a", "_b")
    dealt = tiles.repartition("key", "_a", "_b").sortWithinPartitions("key", "_a", "_b", "fp")
    return dealt.mapInArrow(_search(radius), "u long, v long")


def grouped(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """id, fp, component_id (the least id of the component) of every row of texts(id, text as binary); any id that has an order."""
    prints = C.stage(texts.mapInArrow(_fingerprints, f"id {dict(texts.dtypes)['id']}, fp long"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    parts = C.connected_components(link_fingerprints(distinct.select("fp"), radius))
    own = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    # staged, so that both sides of the join have an exchange of their own and a large component's rows can be split
    least = C.stage(own.groupBy("part").agg(F.min("low").alias("component_id")), "least")
    return prints.join(own.join(least, "part").select("fp", "component_id"), "fp")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """id, fp (signed 64 bits), component_id of every row of docs.

    id is doc_id, with null as the largest long. Null and empty texts have fingerprint zero, linked like any
    other. Rows with one doc_id each have their own fingerprint. An empty table gives an empty table.
    """
    return grouped(docs.select(C.id_or_last().alias("id"), C.text_or_empty().cast("binary").alias("text")), radius)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_groups(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(C.id_back(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), C.id_back(F.col("component_id")).alias("component_id"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays, the first by doc_id (null last) and then by place."""
    rows = C.stage(C.packed(docs).withColumn("_key", F.monotonically_increasing_id()), "rows")
    first = F.struct(C.id_or_last("_row.doc_id").alias("doc"), F.col("_key").alias("key"))
    groups = grouped(rows.select(first.alias("id"), C.text_or_empty("_row.text").cast("binary").alias("text")))
    gone = groups.where("component_id < id").select(F.col("id.key").alias("_key"))
    return rows.join(gone, "_key", "left_anti").select("_row.*")


ORACLE: dict[str, str] = {}
