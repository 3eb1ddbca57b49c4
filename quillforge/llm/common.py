"""Packed shuffles and connected components for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import importable, shared_folder, table, written
from . import kernel as K

U = np.uint64


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package; batches for them have 16 MB at most (Spark's own bound of 64 MB is held several times over by each task), unless the session sets a bound of its own."""
    importable(spark)
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "16m")


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


# -- packed shuffles -------------------------------------------------------------------------


class Keys(NamedTuple):
    """Hashes cut to 2^bits buckets and a key of `width` bits (24 or 32) in each."""

    bits: int
    width: int

    def of(self, h: np.ndarray) -> np.ndarray:
        return h >> U(64 - self.bits - self.width)

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket begins in ascending keys, and the end."""
        return np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=U) << U(self.width))

    def pack(self, keys: np.ndarray) -> tuple[bytes, bytes]:
        """The keys of one bucket, ascending, as two columns of bytes: the upper ones compress well, the lower two bytes are as they are."""
        return (keys >> U(16)).astype(np.uint8 if self.width == 24 else np.uint16).tobytes(), keys.astype(np.uint16).tobytes()

    def unpack(self, high: pa.ChunkedArray, low: pa.ChunkedArray) -> list[np.ndarray]:
        """The keys of each row, without their bucket."""
        kind = np.uint8 if self.width == 24 else np.uint16
        return [(np.frombuffer(a.as_buffer(), kind).astype(np.uint32) << np.uint32(16)) | np.frombuffer(b.as_buffer(), np.uint16) for a, b in zip(high, low, strict=True)]


def key_plan(total_bytes: int, word_bytes: int = 6) -> Keys:
    """About half a million keys for each bucket, one in 32 of which meets another by chance; of wider keys, more."""
    words = max(1, total_bytes // word_bytes)
    bits = min(16, max(8, int(np.ceil(np.log2(words / (1 << 19))))))
    return Keys(bits, 24 if words >> bits <= 1 << 20 else 32)


def small_kind(n: int) -> type:
    """The narrowest unsigned integers that hold 0 to n - 1, and one more."""
    return np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.uint32


def block_of(doc: np.ndarray, n: int) -> np.ndarray:
    """The block, of n, that each doc_id is dealt to."""
    return (K.mix(doc.astype(np.int64).view(U) ^ U(0x5851F42D4C957F2D)) % U(n)).astype(np.int64)


def row_batches(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of 1,024."""
    for at in range(0, len(rows), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1024], strict=True), kinds, strict=True)], names)


# -- texts by block, packed --------------------------------------------------------------------

PACKED = "block long, ids binary, sizes binary, raw long, data binary"


def packed_texts(docs: DataFrame, n_blocks: int, limit: int = 1 << 23) -> DataFrame:
    """The columns doc_id (not null) and text, dealt to blocks: the texts of one block in about `limit` bytes of input are one compressed row; a null text is empty."""
    codec = lambda: pa.Codec("zstd", compression_level=1)

    def run(batches):
        zstd = codec()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, _, _ in K.blocks(batch.column(1), limit):
                block = block_of(doc[i:j], n_blocks)
                order = np.argsort(block, kind="stable")
                texts = K.plain(batch.column(1).slice(i, j - i)).take(pa.array(order))
                block, own = block[order], doc[i:j][order]
                offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = memoryview(texts.buffers()[2] or b"")
                at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                rows = []
                for a, z in zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True):
                    raw = data[offs[a] : offs[z]]
                    rows.append((int(block[a]), own[a:z].tobytes(), np.diff(offs[a : z + 1]).tobytes(), len(raw), zstd.compress(raw, asbytes=True) if len(raw) else b""))
                yield from row_batches(rows, [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()], ["block", "ids", "sizes", "raw", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def unpacked_texts(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The ids and texts of the rows of packed_texts()."""
    zstd = pa.Codec("zstd")
    ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("ids"))])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("sizes"))])
    data = b"".join(zstd.decompress(x.as_buffer(), n, asbytes=True) for x, n in zip(t.column("data"), t.column("raw").to_pylist(), strict=True) if n)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return ids, pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])


# -- sets of ids as bit maps -------------------------------------------------------------------


def id_map(ids: DataFrame, most_bits: int = 28, each: int = 64) -> np.ndarray:
    """A bit map of hashed ids (one long column, no nulls): about `each` bits for each id, 2^most_bits at most (32 MB). Of the ids that are not in it one in `each` seems to be, while it is not full; never the other way round."""
    n = ids.count()
    bits = min(most_bits, max(16, int(np.ceil(np.log2(max(1, n) * each)))))
    slices = max(0, bits - 20)  # of 128 KB

    def place(batches):
        for batch in batches:
            at = np.unique(_map_place(batch.column(0).to_numpy(zero_copy_only=False), bits))
            cuts = np.searchsorted(at, np.arange((1 << slices) + 1, dtype=U) << U(bits - slices))
            own = (at & U((1 << (bits - slices)) - 1)).astype(np.uint32)
            rows = [(s, own[cuts[s] : cuts[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(cuts)).tolist()]
            yield from row_batches(rows, [pa.int32(), pa.binary()], ["slice", "at"])

    def fill(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << (bits - slices), dtype=bool)
        for x in t.column("at"):
            out[np.frombuffer(x.as_buffer(), np.uint32)] = True
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "map": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    got = ids.mapInArrow(place, "slice int, at binary").groupBy("slice").applyInArrow(fill, "slice int, map binary").toArrow()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = 1 << (bits - slices - 3)
    for part, own in zip(got.column("slice").to_pylist(), got.column("map"), strict=True):
        out[part * step : (part + 1) * step] = np.frombuffer(own.as_buffer(), np.uint8)
    return out


def _map_place(ids: np.ndarray, bits: int) -> np.ndarray:
    return K.mix(ids.astype(np.int64).view(U) ^ U(0x2545F4914F6CDD1D)) >> U(64 - bits)


def in_map(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _map_place(ids, int(len(bitmap)).bit_length() + 2)
    return (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1


# -- connected components ---------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of the star contraction: each node hands its neighbours (the larger ones, or the smaller ones) to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part of a partition's edges as stars around least nodes: as many edges as nodes at most."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        off = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off], pa.int64()), pa.array(nodes[root[off]], pa.int64())], ["a", "b"])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        off = low != high
        if not off.any():
            break
        a, b, low, high = a[off], b[off], low[off], high[off]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge.

    edges has two long columns, the ends. Alternates large-star and small-star
    rounds until nothing changes, and raises an error if that takes more than
    `rounds`; every round is written to the shared folder,
    and a hot node is met by partial aggregation and joins that can be split.
    Rows with a null end and loops are ignored.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = written(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_star(_star(now, True), False), "edges")
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        if seen[0]:
            raise RuntimeError(f"components are not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def hex_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


__all__ = ["K", "Keys", "block_of", "components", "id_map", "in_map", "key_plan", "local_roots", "packed_texts", "prepare", "row_batches", "shared_folder", "small_kind", "table", "union_all", "unpacked_texts", "written"]
