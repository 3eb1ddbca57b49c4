"""Operator 3: removal of passages that an earlier document already has, with a count-min prefilter.

A window is k consecutive words of one document. A word goes if a window over it
has a word sequence that also starts in a document with a smaller doc_id.

1. Sketch: count-min, two rows of 2^32 or more counters each (about 32 counters
   for each window). Each partition counts its own windows in rows of its own, and
   sends the counters that are not 0, about two bytes each, to hash buckets, where
   the partitions' counters are added. A counter never underestimates, so a
   window with a counter of 1 in some row is unique. Counters of 2 or more are
   folded into a bit map for each row. The places of the fullest counters, 2^20 at
   most, are the frequent ones.
2. Exact pass: only windows that the map holds to be repeated are grouped, by 96
   bits of hash, after each task has reduced its own to one least doc_id for each
   window and block of documents. A window at a frequent place is sent without its
   blocks, once by each task, so that a hot passage stays small.
3. Each block of documents gets the windows that some smaller document outside
   it has; the frequent windows' least doc_ids, which number little more than
   2^20, are told to all tasks. A block adds those repeated within it, and removes
   the words they cover.

The bit maps have 32 MB and the frequent windows some 16 MB at any size of the
input; entries and answers for all others are at most one for each occurrence. On a
corpus of far more repeated windows the maps fill up and send more windows to the
exact pass, but never lose one. Which windows count as frequent changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Keys, block_of, key_plan, packed_texts, prepare, row_batches, unpacked_texts, written

U = np.uint64
#: Bits of the map that a row of the sketch is folded into.
MAP_BITS = 27
_SALT = K.splitmix(29, 8)
ENTRIES = 1 << 20
#: Counters above this may be frequent, and so many of them are at most.
HOT_BLOCKS, FREQUENT = 16, 1 << 20
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def _windows(texts, k: int) -> Iterator[tuple]:
    for i, j, data, offs in K.blocks(texts):
        starts, _, counts = K.spans(data, offs)
        words = K.word_hashes(data, starts, K.EXACT)
        yield i, j, data, offs, counts, words, *K.windows(words, counts, k)


def repeated_map(docs: DataFrame, k: int, plan: Keys, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row of the merged sketch a bit map: a bit is set if a window there may come twice or more; and the places of the fullest counters of the first row, ascending."""
    spare = U(plan.bits + plan.width - MAP_BITS)
    slice_bits = MAP_BITS - plan.bits
    each = max(1, FREQUENT >> plan.bits)

    def sketch(held: list) -> Iterator[pa.RecordBatch]:
        """A partition's share: its counters that are not 0, those of 1 and those above apart."""
        h = np.concatenate(held)
        out = []
        for row in range(rows):
            keys = np.sort(plan.of(_in_row(h, row)))
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.concatenate([at, [len(keys)]])).astype(np.uint32)
            keys = keys[at]
            for more in (False, True):
                own, n = keys[(count > 1) == more], count[(count > 1) == more]
                cuts = plan.cuts(own)
                out += [(row, b, *plan.pack(own[cuts[b] : cuts[b + 1]]), n[cuts[b] : cuts[b + 1]].tobytes() if more else b"") for b in np.flatnonzero(np.diff(cuts)).tolist()]
        yield from row_batches(out, [pa.int32(), pa.int32(), *[pa.binary()] * 3], ["row", "bucket", "high", "low", "counts"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for _, _, _, _, _, _, h, _, _ in _windows(batch.column(0), k):
                held.append(h)
                total += len(h)
                if total >= ENTRIES:
                    yield from sketch(held)
                    held, total = [], 0
        if total:
            yield from sketch(held)

    def merge(t: pa.Table) -> pa.Table:
        """Adds the partitions' counters of one bucket, and folds those of two or more into bits."""
        own = plan.unpack(t.column("high"), t.column("low"))
        count = np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) if len(c.as_buffer()) else np.ones(len(x), np.uint32) for x, c in zip(own, t.column("counts"), strict=True)])
        keys = np.concatenate(own)
        order = np.argsort(keys)
        keys, count = keys[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, count = keys[at], np.add.reduceat(count.astype(np.int64), at)
        twice = keys[count > 1]
        bits = np.zeros(1 << slice_bits, dtype=bool)
        bits[(twice >> spare).astype(np.int64)] = True
        full = keys[count > HOT_BLOCKS] if t.column("row")[0].as_py() == 0 else keys[:0]
        if len(full) > each:
            full = full[np.argpartition(-count[count > HOT_BLOCKS], each)[:each]]
        return pa.table({"row": t.column("row").slice(0, 1), "bucket": t.column("bucket").slice(0, 1), "map": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "full": pa.array([full.astype(np.uint32).tobytes()], pa.binary())})

    sketches = docs.select("text").mapInArrow(run, "row int, bucket int, high binary, low binary, counts binary")
    found = sketches.groupBy("row", "bucket").applyInArrow(merge, "row int, bucket int, map binary, full binary").toArrow()
    out = [np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8) for _ in range(rows)]
    step = 1 << (slice_bits - 3)
    for row, bucket, own in zip(found.column("row").to_pylist(), found.column("bucket").to_pylist(), found.column("map"), strict=True):
        out[row][bucket * step : (bucket + 1) * step] = np.frombuffer(own.as_buffer(), np.uint8)
    full = [np.frombuffer(x.as_buffer(), np.uint32).astype(U) | U(b) << U(plan.width) for b, x in zip(found.column("bucket").to_pylist(), found.column("full"), strict=True)]
    return out, np.sort(np.concatenate([np.zeros(0, U), *full]))


def _in_row(h: np.ndarray, row: int) -> np.ndarray:
    """The hash that places a window in a row of the sketch."""
    return K.mix(h ^ _SALT[row]) if row else h


def _may_repeat(maps: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    may = np.ones(len(h), dtype=bool)
    for row, bits in enumerate(maps):
        left = np.flatnonzero(may)
        at = _in_row(h[left], row) >> U(62 - len(bits).bit_length())  # a bit for each of 2^n places
        may[left] = (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1
    return may


def _among(held: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in `held`, ascending, and where."""
    if not len(held):
        return np.zeros(len(x), dtype=bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(held, x), len(held) - 1)
    return held[at] == x, at


def _ids(doc: np.ndarray) -> bytes:
    """In four bytes each where all fit, else in eight."""
    return doc.astype(np.uint32 if 0 <= doc.min() and doc.max() < 1 << 32 else np.int64).tobytes()


def _earlier(docs: DataFrame, k: int, plan: Keys, n_blocks: int, sent) -> DataFrame:
    """(block, windows, least): hashes of windows that come in a smaller document outside the block; for block -1, the frequent windows and their least documents."""
    bits = plan.bits

    def send(held: list, full: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, h2, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        block = block_of(doc, n_blocks)
        order = np.lexsort((doc, block, h2, h))
        h, h2, doc, block = h[order], h2[order], doc[order], block[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        first = new | np.concatenate([[True], block[1:] != block[:-1]])
        h, h2, doc, new = h[first], h2[first], doc[first], new[first]
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(h)]]))
        hot = _among(full, plan.of(h[at]))[0]
        least = np.minimum.reduceat(doc, at)
        keep = np.repeat(~hot, size)
        parts = [(h[keep], h2[keep], doc[keep], 0), (h[at[hot]], h2[at[hot]], least[hot], 1)]
        for h, h2, doc, flag in parts:
            cuts = np.concatenate([[0], np.searchsorted(h, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)), [len(h)]])
            rows = [(b, flag, h[a:z].tobytes(), h2[a:z].tobytes(), _ids(doc[a:z])) for b in np.flatnonzero(np.diff(cuts)).tolist() for a, z in [(cuts[b], cuts[b + 1])]]
            yield from row_batches(rows, [pa.int32(), pa.int32(), *[pa.binary()] * 3], ["bucket", "hot", "h", "h2", "doc"])

    def run(batches):
        bitmap, full = sent.value
        held, total = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, _, _, counts, words, h, at, of in _windows(batch.column(1), k):
                may = _may_repeat(bitmap, h)
                if may.any():
                    h2 = K.windows(words, counts, k, seed=2)[0][may].astype(np.uint32)
                    held.append((h[may], h2, ids[i:j][of[may]]))
                    total += len(h2)
                if total >= ENTRIES:
                    yield from send(held, full)
                    held, total = [], 0
        if total:
            yield from send(held, full)

    def meet(t: pa.Table) -> pa.Table:
        join = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]
        hs = join("h", U)
        flag = np.repeat(t.column("hot").to_numpy(), [len(x) for x in hs])
        ids = [np.frombuffer(x.as_buffer(), np.int64 if len(x.as_buffer()) == 8 * len(own) else np.uint32).astype(np.int64) for x, own in zip(t.column("doc"), hs, strict=True)]
        h, h2, doc = np.concatenate(hs), np.concatenate(join("h2", np.uint32)), np.concatenate(ids)
        block = block_of(doc, n_blocks)
        order = np.lexsort((doc, block, h2, h))
        h, h2, doc, block, flag = h[order], h2[order], doc[order], block[order], flag[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        least, hot = np.minimum.reduceat(doc, at), np.maximum.reduceat(flag, at) == 1  # a window is frequent in all tasks or in none
        first = new | np.concatenate([[True], block[1:] != block[:-1]])
        told = first & (doc > least[group]) & ~hot[group]  # the block's least document comes after another block's
        order = np.argsort(block[told], kind="stable")
        h_told, of = h[told][order], block[told][order]
        to = np.unique(of)
        a, z = np.searchsorted(of, to), np.searchsorted(of, to, side="right")
        rows = [(b, h_told[x:y].tobytes(), b"") for b, x, y in zip(to.tolist(), a.tolist(), z.tolist(), strict=True)]
        if hot.any():
            rows.append((FOR_ALL, h[at[hot]].tobytes(), least[hot].tobytes()))
        return pa.Table.from_batches(row_batches(rows, [pa.int64(), pa.binary(), pa.binary()], _TOLD), pa.schema(list(zip(_TOLD, [pa.int64(), pa.binary(), pa.binary()], strict=True))))

    packed = docs.select("doc_id", "text").mapInArrow(run, "bucket int, hot int, h binary, h2 binary, doc binary")
    return packed.groupBy("bucket").applyInArrow(meet, "block long, windows binary, least binary")


_TOLD = ["block", "windows", "least"]
FOR_ALL = -1


def _frequent(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent windows, ascending, and their least documents."""
    rows = told.where(F.col("block") == FOR_ALL).select("windows", "least").toArrow()
    h, least = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows.column(c))]) for c, kind in (("windows", U), ("least", np.int64)))
    order = np.argsort(h)
    return h[order], least[order]


def window_dedup(docs: DataFrame, k: int = 13, block_bytes: int = 1 << 23, rows: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, text, removed) for each row of docs(doc_id, text).

    text has the kept words joined by single spaces; removed has the runs taken
    out, as first word and count. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. All
    windows are judged on the input. A null or empty text has no words; rows with
    one doc_id are never smaller than each other; a null doc_id counts as 2^63 - 1,
    the greatest; extra columns are left out; an empty table gives no rows. rows:
    rows of the sketch.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL").withColumn("doc_id", F.lit(LAST))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 8 + int(total // block_bytes)
    plan = key_plan(total)
    sent = spark.sparkContext.broadcast(repeated_map(docs, k, plan, rows))
    told = written(_earlier(docs, k, plan, n_blocks, sent), "told")
    shared = spark.sparkContext.broadcast(_frequent(told))
    earlier = told.where(F.col("block") != FOR_ALL).select("block", "windows")

    def finish(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        (bitmap, _), (hot, least) = sent.value, shared.value
        none = np.repeat(texts.column("none").to_numpy(zero_copy_only=False), [len(x.as_buffer()) // 8 for x in texts.column("ids")])
        doc, arr = unpacked_texts(texts)
        outer = np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(x.as_buffer(), U) for x in told.column("windows"))]))
        got = []
        for i, j, _, _, counts, _, h, at, of in _windows(arr, k):
            may = _may_repeat(bitmap, h)
            got.append((h[may], at[may], of[may] + i))
        h, of = (np.concatenate([g[c] for g in got]) if got else np.zeros(0, U) for c in (0, 2))
        of = of.astype(np.int64)
        out = np.zeros(len(h), dtype=bool)
        if len(h):
            value, inverse = np.unique(h, return_inverse=True)
            first = np.full(len(value), np.iinfo(np.int64).max)
            np.minimum.at(first, inverse, doc[of])
            out = first[inverse] < doc[of]
            out |= _among(outer, value)[0][inverse]
            found, at = _among(hot, value)
            if found.any():
                out |= found[inverse] & (least[at][inverse] < doc[of])
        rows, used = [], 0
        for (g, at, own), (i, j, data, offs) in zip(got, K.blocks(arr), strict=True):
            hit = out[used : used + len(g)]
            used += len(g)
            _, _, counts = K.spans(data, offs)
            first = np.concatenate([[0], np.cumsum(counts)])
            cover = np.zeros(first[-1] + 1, np.int64)
            np.add.at(cover, at[hit], 1)
            np.add.at(cover, at[hit] + k, -1)
            gone = np.cumsum(cover[:-1]) > 0
            raw = data.tobytes()
            for r in range(j - i):
                words = raw[offs[r] : offs[r + 1]].split()
                mask = gone[first[r] : first[r + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                rows.append((None if none[i + r] else int(doc[i + r]), len(words), int(mask.sum()), b" ".join(compress(words, ~mask) if len(edge) else words), [{"first": int(a), "words": int(z - a)} for a, z in zip(edge[::2], edge[1::2], strict=True)]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "text": pa.array(cols[3], pa.binary()).cast(pa.string()), "removed": pa.array(cols[4], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))})

    blocks = packed_texts(named, n_blocks).withColumn("none", F.lit(False)).unionByName(packed_texts(nameless, n_blocks).withColumn("none", F.lit(True)))
    return blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, text string, removed array<struct<first:int,words:int>>")
