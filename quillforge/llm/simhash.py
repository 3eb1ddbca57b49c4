"""Operator 11: near-duplicates by SimHash, by exact comparison of tiles of fingerprints.

1. One pass fingerprints every text; equal fingerprints are one node.
2. Fingerprints are cut into `parts` runs of bits. `radius` differing bits leave
   at least parts - radius runs untouched, so two linked fingerprints agree on one
   of the choices of that many runs: each fingerprint comes once in a bucket of each
   choice. The number of parts follows the number of fingerprints, so that a
   bucket is expected to hold no more than a tile; this only deals the tiles out
   and loses no pair.
3. In a bucket, fingerprints are ordered by population count and compared tile by
   tile, by exclusive-or and bit counts; tiles whose population counts
   differ by more than the radius are skipped. A bucket of more than `tile` fingerprints
   is cut by population count, and by hash within one, and each pair of its tiles within the
   radius is a group of its own: no bucket has to fit one task.
4. A comparison gives out a forest of its links, not its pairs: at most one edge for each
   fingerprint. Components of these edges are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import components, local_roots, prepare, written

U = np.uint64
SEED = 42
#: Shingles that are hashed at once.
CHUNK = 1 << 16
#: One bit in each byte.
_LANES = U(0x0101010101010101)


def normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with A-Z lowered, one space after each, and where each begins there; one place more for the end."""
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(at[-1]), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    own = data[K.ranges(starts, ends - starts)]
    out[inside] = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own)
    return out.tobytes(), at


def votes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of hashes, none of them empty, how often each of the 64 bits is set."""
    begin = np.cumsum(counts) - counts
    pieces = -(-counts // 255)  # a byte counts to 255
    first = np.cumsum(pieces) - pieces
    at = np.repeat(begin, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    out = np.empty((len(counts), 8, 8), np.int64)
    for i in range(8):
        lanes = np.add.reduceat((h >> U(i)) & _LANES, at)
        out[:, :, i] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(-1, 64)


def simhash(texts: pa.Array, k: int) -> np.ndarray:
    """The fingerprint of each text (null: empty)."""
    out = [np.zeros(0, U)]
    for i, j, data, offs in K.blocks(texts):
        starts, ends, words = K.spans(data, offs)
        own = np.zeros(j - i, U)
        full = np.flatnonzero(words)
        if len(full):
            joined, at = normal(data, starts, ends)
            view, words = memoryview(joined), words[full]
            sizes = np.maximum(words - k + 1, 1)
            head = K.ranges(np.cumsum(words) - words, sizes)  # the first word of each shingle
            last = head + np.repeat(np.minimum(words, k), sizes)
            h = np.empty(len(head), U)
            for a in range(0, len(head), CHUNK):
                cuts = zip(at[head[a : a + CHUNK]].tolist(), (at[last[a : a + CHUNK]] - 1).tolist(), strict=True)
                h[a : a + CHUNK] = [xxhash.xxh64_intdigest(view[x:y], SEED) for x, y in cuts]
            bits = 2 * votes(h, sizes) > sizes[:, None]
            own[full] = np.packbits(bits, axis=1, bitorder="little").view(U)[:, 0]
        out.append(own)
    return np.concatenate(out)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash(batch.column(1), k).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(n: int, radius: int, tile: int) -> list[int]:
    """The choices of runs of bits, as masks, with which n random fingerprints leave `tile` in a bucket at most, or the finest ones of two-bit runs."""
    for parts in range(radius + 1, 33):
        cuts = [64 * i // parts for i in range(parts + 1)]
        runs = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(cuts, cuts[1:], strict=False)]
        out = [sum(c) for c in combinations(runs, parts - radius)]
        if n <= tile << min(m.bit_count() for m in out):
            break
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tile_edges(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within the distinct fingerprints of left, or between left and right: (node, its least fingerprint reached here).

    Rows of 256 are compared with columns of `tile`; both are ordered by population count, and what lies beyond the radius is skipped.
    """
    order = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    a, b = order(left), order(left if right is None else right)
    na, nb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    nodes = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root = np.arange(len(nodes))
    for i in range(0, len(a), 256):
        rows = slice(i, i + 256)
        lo = i if right is None else int(np.searchsorted(nb, na[i] - radius))
        hi = int(np.searchsorted(nb, na[rows][-1] + radius, side="right"))
        for j in range(lo, hi, tile):
            cols = slice(j, min(j + tile, hi))
            x, y = np.nonzero(np.bitwise_count(a[rows, None] ^ b[None, cols]) <= radius)
            x, y = root[ia[i + x]], root[ib[j + y]]
            if (off := x != y).any():
                root = local_roots(len(nodes), np.concatenate([np.arange(len(nodes)), x[off]]), np.concatenate([root, y[off]]))
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (grp, key, side, fp), ordered by the first two: within each key of a group, or between its sides 1 and 2."""
    held: list[tuple[np.ndarray, ...]] = []

    def judged() -> Iterator[pa.RecordBatch]:
        _, _, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(fp) > 1:
            both = side[0] > 0
            left = fp[side < 2] if both else fp
            a, b = tile_edges(left.view(U), fp[side == 2].view(U) if both else None, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        grp, key, side, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        if not len(grp):
            continue
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (key[1:] != key[:-1])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
            if held and (held[-1][0][-1], held[-1][1][-1]) != (grp[a], key[a]):
                yield from judged()
                held = []
            held.append(tuple(x[a:z].copy() for x in (grp, key, side, fp)))
    if held:
        yield from judged()


def links(prints: DataFrame, radius: int = 4, tile: int = 8192) -> DataFrame:
    """(a, b): edges between the distinct fingerprints (one long column, fp) whose components are those of all pairs within the radius."""
    chosen = masks(prints.count(), radius, tile)
    picks = F.explode(F.array(*[F.struct(F.lit(c).alias("grp"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in enumerate(chosen)]))
    dealt = prints.select(picks.alias("_"), "fp").select("_.grp", "_.key", "fp", F.bit_count("fp").alias("pop"))
    layers = written(dealt.groupBy("grp", "key", "pop").agg(F.count("*").alias("n")), "layers")
    large = layers.groupBy("grp", "key").agg(F.sum("n").alias("total")).where(F.col("total") > tile).select("grp", "key")
    cold = dealt.join(large, ["grp", "key"], "left_anti").select("grp", "key", F.lit(0).alias("side"), "fp")
    # buckets of more than a tile: each layer of equal population count in tiles, and the pairs of tiles within the radius
    salts = F.ceil(F.col("n") / tile).cast("int")
    cut = layers.join(large, ["grp", "key"]).withColumn("salts", salts)
    tiles = cut.select("grp", "key", "pop", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = tiles.select("grp", "key", F.col("pop").alias("pop2"), F.col("salt").alias("salt2"))
    near = (F.col("pop2") - F.col("pop") <= radius) & ((F.col("pop2") > F.col("pop")) | ((F.col("pop2") == F.col("pop")) & (F.col("salt2") >= F.col("salt"))))
    pairs = written(tiles.join(other, ["grp", "key"]).where(near).withColumn("pair", F.xxhash64("grp", "key", "pop", "salt", "pop2", "salt2")), "tile_pairs")
    alone = (F.col("pop") == F.col("pop2")) & (F.col("salt") == F.col("salt2"))
    ends = pairs.select("grp", "key", "pop", "salt", "pair", F.when(alone, 0).otherwise(1).alias("side")).unionByName(
        pairs.where(~alone).select("grp", "key", F.col("pop2").alias("pop"), F.col("salt2").alias("salt"), "pair", F.lit(2).alias("side")))
    hot = dealt.join(cut.select("grp", "key", "pop", "salts"), ["grp", "key", "pop"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    hot = hot.join(ends, ["grp", "key", "pop", "salt"]).select(F.lit(-1).alias("grp"), F.col("pair").alias("key"), "side", "fp")
    rows = cold.unionByName(hot).repartition("grp", "key").sortWithinPartitions("grp", "key")
    return rows.mapInArrow(lambda batches: _edges(batches, radius), "a long, b long")


def simhash_dedup(docs: DataFrame, k: int = 4, radius: int = 4, tile: int = 8192) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    A fingerprint bit is set if it is in more than half of the XXH64 values (seed
    42) of the text's k-word shingles, repeats included; fewer words
    are one shingle, a null text or one without words has the fingerprint zero and is linked
    like any other. Rows link when their fingerprints differ by `radius` bits at most;
    component_id is the least doc_id of the rows reachable, the own one included, and null
    only where all of these are null. Rows with a repeated doc_id are judged
    each by its own text. Extra columns are left out. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    prints = written(fingerprints(docs, k), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = written(components(links(nodes.select("fp"), radius, tile)), "roots")
    own = nodes.join(root, nodes.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    own = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
