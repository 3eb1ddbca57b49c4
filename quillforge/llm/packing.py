"""Operator 2: token ids of documents, packed into fixed rows by best-fit decreasing.

Texts are cut at white space into units (a word with the space before it, or a
run of other white space), each distinct unit of a block is encoded once, and a
text's ids are its units' ids in order, so decoding gives the text back. Documents
longer than a row are split into full rows and a rest; nothing is dropped. The
pieces of a task's share, of a bounded number of tokens, are packed together:
largest first, each into the row whose free space fits it most tightly, found by a
descent in a segment tree over the capacities.

Each packed row carries its id matrix row, the cumulative lengths of its segments
and the positions at which position ids start again from 0.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import prepare

U = np.uint64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that fills the end of a row; the vocabulary leaves it free.
PAD = 50256
_UNIT = K._BYTES
_encoders: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encodes many texts; loaded once in each Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = lambda texts: [made.encode_ordinary(t) for t in texts]
    return _encoders[path]


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units, and how many each text has; the units cover all bytes."""
    n = len(data)
    space = K.SPACE[data]
    new = np.zeros(n, dtype=bool)
    new[1:] = space[1:] & ~space[:-1]  # a run of white space begins
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:]  # its last byte before a word: a single space goes with the word
    new |= last
    other = np.flatnonzero(last & (data != 32)) + 1
    new[other] = True
    new[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(new)
    return starts, np.diff(np.searchsorted(starts, offs))


class Tokens:
    """Ids of whole texts, by way of their distinct units; keeps the ids of some hundred thousand units."""

    def __init__(self, encode: Callable, most: int = 500_000):
        self.encode, self.most = encode, most
        self.place: dict[int, int] = {}  # of each unit's hash: where its ids are, and in the last 32 bits how many
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0

    def _learn(self, keys: list[int], texts: list[str]) -> list[int]:
        found = self.encode(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = int(counts.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        places = ((self.used + np.cumsum(counts) - counts) << 32 | counts).tolist()
        self.place.update(zip(keys, places, strict=True))
        self.used += total
        return places

    def of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the count of each text."""
        if len(self.place) > self.most:
            self.place, self.used = {}, 0
        starts, counts = units(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
        ends = np.concatenate([starts[1:], [len(data)]])
        h = K.word_hashes(data, starts, _UNIT)
        h ^= K.mix((ends - starts).astype(U))
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys, get = keys.tolist(), self.place.get
        where = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            where[new] = self._learn([keys[i] for i in new.tolist()], [raw[a:z].decode("utf-8", "replace") for a, z in spans])
        at, size = where >> 32, where & 0xFFFFFFFF
        size = size[inverse]
        return self.ids[K.ranges(at[inverse], size)], K.totals(size, counts)


def best_fit_decreasing(sizes: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """The row of each piece (1 to `row` tokens), and the number of rows.

    Pieces go by falling size, earlier ones first among equals, each into the row
    with the least free space that holds it, the longest-open one among equals. A
    segment tree over free space, 1 to `row`, counts the rows that have it.
    """
    leaves = 1 << max(1, int(row).bit_length())
    tree = [0] * (2 * leaves)
    open_: list[list[int]] = [[] for _ in range(row + 1)]
    head = [0] * (row + 1)
    out, n = np.zeros(len(sizes), np.int64), 0

    def put(free: int, by: int) -> None:
        i = free + leaves
        while i:
            tree[i] += by
            i >>= 1

    for p in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[p])
        # the least free space of at least `size` that some row has
        i = size + leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            i = i + 1 if i > 1 else 0
            while 0 < i < leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        if i:
            free = i - leaves
            r = open_[free][head[free]]
            head[free] += 1
            put(free, -1)
        else:
            r, free, n = n, row, n + 1
        out[p] = r
        if free > size:
            open_[free - size].append(r)
            put(free - size, 1)
    return out, n


SCHEMA = "pack string, row long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>"
_ARROW = pa.schema([("pack", pa.string()), ("row", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


def _packed(ids: np.ndarray, counts: np.ndarray, docs: list, row: int, pack: str) -> Iterator[pa.RecordBatch]:
    """Packed rows of some documents' ids."""
    whole = counts // row
    pieces = np.maximum(whole + (counts % row > 0), 1)  # an empty document has one empty piece
    of = np.repeat(np.arange(len(counts)), pieces)
    nth = K.ranges(np.zeros(len(counts), np.int64), pieces)
    start = (np.cumsum(counts) - counts)[of] + nth * row
    size = np.minimum(counts[of] - nth * row, row)
    row_of = np.zeros(len(of), np.int64)
    full = size > 0
    row_of[full], n = best_fit_decreasing(size[full], row)
    n = max(n, 1) if len(of) else 0  # empty pieces lie in the first row
    order = np.argsort(row_of, kind="stable")
    cut = np.searchsorted(row_of[order], np.arange(n + 1))
    dtype = np.uint16 if PAD < 1 << 16 else np.int32
    for base in range(0, n, 512):
        top = min(base + 512, n)
        matrix = np.full((top - base, row), PAD, dtype)
        cols: list[list] = [[] for _ in range(5)]
        for r in range(base, top):
            own = order[cut[r] : cut[r + 1]]
            ends = np.cumsum(size[own])
            if len(own):
                matrix[r - base, : ends[-1]] = ids[K.ranges(start[own], size[own])]
            used = int(ends[-1]) if len(own) else 0
            cu = np.concatenate([[0], ends]).astype(np.int32)
            for c, x in zip(cols, (used, cu, cu[:-1][size[own] > 0], [docs[i] for i in of[own]], nth[own].astype(np.int32)), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array([pack] * (top - base)), pa.array(range(base, top), pa.int64()), pa.array([m.tobytes() for m in matrix], pa.binary()), *(pa.array(c, t.type) for c, t in zip(cols, list(_ARROW)[3:], strict=True))], schema=_ARROW)


def pack_tokens(docs: DataFrame, row: int = 2048, vocabulary: str = VOCABULARY, tokens: int = 1 << 22) -> DataFrame:
    """One row for each packed row of `row` token ids.

    docs has doc_id and text. pack names the share of documents packed together
    (about `tokens` tokens of one task), row counts in it; ids has the row's ids
    as little-endian 16-bit numbers, filled with PAD after n_tokens; cu_seqlens
    has the cumulative segment lengths from 0, resets the positions at which
    position ids begin at 0; doc_ids and pieces tell each segment's document and
    which piece of it that is. A null or empty text gives a segment of length 0
    in its share's first row (it has no reset). Repeated rows are packed each; extra columns are
    left out; an empty table gives no rows. Needs no shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known, held, total, share = Tokens(encoder(vocabulary)), [], 0, 0

        def flush():
            ids, counts, docs = (list(x) for x in zip(*held, strict=True))
            return _packed(np.concatenate(ids), np.concatenate(counts), [d for x in docs for d in x], row, f"{part}-{share}")

        for batch in batches:
            doc = batch.column(0).to_pylist()
            for i, j, data, offs in K.blocks(batch.column(1)):
                ids, counts = known.of(data, offs)
                held.append((ids, counts, doc[i:j]))
                total += len(ids)
                if total >= tokens:
                    yield from flush()
                    held, total, share = [], 0, share + 1
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def unpack(packed: list[dict]) -> dict[int, list[int]]:
    """The ids of each document from packed rows (for tests and readers); rows of one doc_id are taken as one document."""
    parts: dict = {}
    for r in packed:
        ids = np.frombuffer(r["ids"], np.uint16)
        for k, (doc, piece) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts.setdefault(doc, {})[piece] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    return {d: [x for _, own in sorted(p.items()) for x in own] for d, p in parts.items()}
