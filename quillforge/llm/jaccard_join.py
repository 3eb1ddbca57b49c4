"""Operator 9: similarity self-join of documents on word n-grams, by token-combination prefixes.

Each document is the set of its distinct k-word shingles; two link when their
Jaccard similarity reaches a threshold given as a fraction.

1. One pass fingerprints each set; documents with equal sets are one class.
2. One pass counts, over the whole corpus, in how many documents each shingle
   comes (packed keys of 24 bits in hash buckets), and answers each block of
   documents with the rank by frequency, one byte, of those of its shingles that
   come twice or more. Nothing is broadcast. A shingle that a task meets very often
   is sent once with its count and answered to all blocks. Texts meet the answers
   in compressed rows.
3. In each block, documents get prefixes in the order of these counts. A document
   that may lack t of its shingles needs t + 1 units: a shingle of no other
   document is a unit without an entry, a rare one (in at most `rare` documents)
   is a unit and is indexed alone. Where these do not suffice, the prefix is
   extended into the frequent shingles, which are dealt to a number of small
   classes that follows the document's size; the second and each further shingle
   in a class is a unit, and all pairs of a class's prefix shingles are indexed.
   Two linked documents share a rare prefix shingle, or two frequent ones of one
   class (pigeonhole; it holds for any order that all documents use alike).
4. Documents sharing an index entry are joined to the entry's least document
   only, and components of these candidate edges are formed.
5. In each component pairs are verified by exact overlap counts, in one task
   while the component is small. A larger one is dealt to levels by the size of the sets, and
   these to blocks: sets that link are at most two levels apart, so only pairs of blocks that near are
   tasks. A bit map of candidates, of bounded size, keeps other texts out of this shuffle.

So no link is lost and pairs of documents never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Keys, block_of, components, id_map, in_map, key_plan, local_roots, packed_texts, prepare, row_batches, small_kind, unpacked_texts, written

U = np.uint64
#: A shingle that a task's share of documents has more often than this is sent as one count.
HOT = 1024
#: Index entries that a task holds before it sends them off.
ENTRIES = 1 << 20
_SALT = K.splitmix(23, 4)


def _sets(texts, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set sizes, the sorted sets one after the other), block by block."""
    for i, _, data, offs in K.blocks(texts):
        starts, _, counts = K.spans(data, offs)
        h, per = K.shingles(K.word_hashes(data, starts, K.LOWER), counts, k)
        own, sizes = K.sets(h, per)
        yield i, sizes, own


def _prints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    return tuple(K.totals(K.mix(sets ^ s), sizes).view(np.int64) for s in _SALT[:2])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, f1, f2) of documents with the columns doc_id and text."""

    def run(batches):
        for batch in batches:
            for i, sizes, own in _sets(batch.column(1), k):
                f1, f2 = _prints(own, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sizes)), pa.array(sizes), pa.array(f1), pa.array(f2)], ["doc_id", "n", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def rank_of(df: np.ndarray) -> np.ndarray:
    """One byte that orders counts of documents: as they are up to 64, then by eighths of a power of two; 0 and 1 stay below all shared ones."""
    return np.where(df <= 64, df, np.minimum(64 + np.floor(8 * np.log2(np.maximum(df, 64) / 64)), 255)).astype(np.uint8)


def shared_shingles(docs: DataFrame, k: int, plan: Keys, n_blocks: int) -> DataFrame:
    """(block, bucket, high, low, ranks): for each block of documents, the keys of those of its shingles that two or more documents have, and rank_of() how many."""
    kind = small_kind(n_blocks)
    everywhere = kind(np.iinfo(kind).max)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        key, block = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, block = key[order], block[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([at, [len(key)]]))
        count = np.ones(len(key), np.uint32)
        if (hot := size > HOT).any():
            count[at[hot]] = size[hot]
            block[at[hot]] = everywhere
            keep = np.repeat(~hot, size)
            keep[at[hot]] = True
            key, block, count = key[keep], block[keep], count[keep]
        cuts, hot = plan.cuts(key), block == everywhere
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            rows.append((b, *plan.pack(key[own]), block[own].tobytes(), count[own][hot[own]].tobytes()))
        yield from row_batches(rows, [pa.int32(), *[pa.binary()] * 4], ["bucket", "high", "low", "blocks", "counts"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            of = block_of(batch.column(0).to_numpy(zero_copy_only=False), n_blocks).astype(kind)
            for i, sizes, own in _sets(batch.column(1), k):
                held.append((plan.of(own), np.repeat(of[i : i + len(sizes)], sizes)))
                total += len(own)
                if total >= ENTRIES:
                    yield from send(held)
                    held, total = [], 0
        if total:
            yield from send(held)

    def answer(t: pa.Table) -> pa.Table:
        key = np.concatenate(plan.unpack(t.column("high"), t.column("low")))
        block = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column("blocks")])
        count = np.ones(len(key), np.int64)
        count[block == everywhere] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("counts")])
        order = np.lexsort((block, key))
        key, block, count = key[order], block[order], count[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        df = np.add.reduceat(count, at)
        rank = rank_of(df)
        hot = np.logical_or.reduceat(block == everywhere, at)
        told = (new | np.concatenate([[True], block[1:] != block[:-1]])) & ((df > 1) & ~hot)[group]
        order = np.argsort(block[told], kind="stable")
        own, of, n = key[told][order], block[told][order], rank[group[told]][order]
        hot_key, hot_n = key[at[hot]], rank[hot]
        to = np.arange(n_blocks) if hot.any() else np.unique(of).astype(np.int64)
        a, z = np.searchsorted(of, to), np.searchsorted(of, to, side="right")
        rows = []
        for b, x, y in zip(to.tolist(), a.tolist(), z.tolist(), strict=True):
            keys, ranks = (own[x:y], n[x:y]) if not len(hot_key) else (np.concatenate([own[x:y], hot_key]), np.concatenate([n[x:y], hot_n]))
            rows.append((b, t.column("bucket")[0].as_py(), *plan.pack(keys.astype(U)), ranks.tobytes()))
        return pa.Table.from_batches(row_batches(rows, _TOLD, ["block", "bucket", "high", "low", "ranks"]), pa.schema(list(zip(["block", "bucket", "high", "low", "ranks"], _TOLD, strict=True))))

    packed = docs.select("doc_id", "text").mapInArrow(run, "bucket int, high binary, low binary, blocks binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(answer, "block long, bucket int, high binary, low binary, ranks binary")


_TOLD = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _classes(level: int, least_overlap) -> int:
    """Classes for the frequent shingles of sets of 2^level or more: a power of two, below the overlap of any two such sets that link; 0 where they may share a single shingle."""
    most = least_overlap(1 << level) - 1
    return min(1 << max(0, level - 2), 1 << (most.bit_length() - 1)) if most > 0 else 0


def prefix_entries(own: np.ndarray, df: np.ndarray, least_overlap, rare: int) -> np.ndarray:
    """Index entries of one set. df: what orders its shingles, 0 for one that no other document has, else as the number of documents with it. least_overlap(n): shingles that a set of n shares with any it links to.

    Two sets that link have sizes within a factor of the threshold, so that the
    levels from least_overlap(n) to n of both have one in common.
    """
    n = len(own)
    shared = np.flatnonzero(df)
    need = n - least_overlap(n) + 1 - (n - len(shared))
    if need <= 0:
        return own[:0]
    shared = shared[np.lexsort((own[shared], df[shared]))]
    split = int(np.searchsorted(df[shared], rare, side="right"))
    if split >= need:
        return own[shared[:need]]
    often = own[shared[split:]]
    need -= split
    out = [own[shared[:split]]]
    for level in range(least_overlap(n).bit_length() - 1, n.bit_length()):
        if not (classes := _classes(level, least_overlap)):
            out.append(K.mix(often[:need] ^ _SALT[3]))
            continue
        cls = (K.mix(often ^ _SALT[2]) & U(classes - 1)).astype(np.int64)
        again = np.ones(len(often), dtype=bool)
        again[np.unique(cls, return_index=True)[1]] = False
        units = np.cumsum(again)
        end = int(np.searchsorted(units, need)) + 1
        kept, cls = often[:end], cls[:end]
        order = np.argsort(cls, kind="stable")
        kept, cls = kept[order], cls[order]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(cls)]])).astype(np.int64)
        after = np.repeat(first + size, size) - np.arange(len(cls)) - 1  # later ones in the class
        left, right = np.repeat(np.arange(len(cls)), after), K.ranges(np.arange(len(cls)) + 1, after)
        out.append(K.mix((kept[left] * (_SALT[3] | U(1)) + kept[right]) ^ U(level + 1)))
    return np.concatenate(out)


def candidate_edges(docs: DataFrame, k: int, num: int, den: int, rare: int, plan: Keys, n_blocks: int) -> DataFrame:
    """(a, b): a document and the least one that it shares an index entry with."""
    least_overlap = lambda n: -(-num * n // den)
    entries = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("ids", pa.binary())])
    rare, bits = int(rank_of(np.array([rare]))[0]), plan.bits

    def send(sigs: list, ids: list) -> Iterator[pa.RecordBatch]:
        sig, doc = np.concatenate(sigs), np.concatenate(ids)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        hub = doc[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([doc, hub], 1)[doc != hub], axis=0)
        rows = [(-1 - int(doc[0] % 1024), b"", pairs.tobytes())] if len(pairs) else []
        sig, doc = sig[first], doc[first]
        cuts = np.searchsorted(sig, np.arange(1, 1 << bits, dtype=U) << U(64 - bits))
        cuts = np.concatenate([[0], cuts, [len(sig)]])
        rows += [(b, sig[cuts[b] : cuts[b + 1]].tobytes(), doc[cuts[b] : cuts[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        yield from row_batches(rows, [pa.int32(), pa.binary(), pa.binary()], ["bucket", "sigs", "ids"])

    def enter(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not len(told) or not len(texts):
            return pa.Table.from_batches([], entries)
        keys = np.concatenate([x.astype(U) | (U(b) << U(plan.width)) for x, b in zip(plan.unpack(told.column("high"), told.column("low")), told.column("bucket").to_pylist(), strict=True)])
        ranks = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in told.column("ranks")])
        order = np.argsort(keys)
        keys, ranks = keys[order], ranks[order]
        doc, texts = unpacked_texts(texts)
        out, sigs, of, total, seen = [], [], [], 0, set()
        for i, sizes, own in _sets(texts, k):
            mine = plan.of(own)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            df = np.where(keys[at] == mine, ranks[at], 0)
            f1, f2 = _prints(own, sizes)
            end = np.cumsum(sizes)
            for j, n in enumerate(sizes.tolist()):
                if not n or (p := (int(f1[j]), int(f2[j]))) in seen:
                    continue
                seen.add(p)
                e = prefix_entries(own[end[j] - n : end[j]], df[end[j] - n : end[j]], least_overlap, rare)
                if len(e):
                    sigs.append(e)
                    of.append(np.full(len(e), doc[i + j], np.int64))
                    total += len(e)
            if total >= ENTRIES:
                out += send(sigs, of)
                sigs, of, total = [], [], 0
        if total:
            out += send(sigs, of)
        return pa.Table.from_batches(out, entries)

    def meet(t: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("ids")])
        if t.column("bucket")[0].as_py() < 0:
            pairs = np.unique(ids.reshape(-1, 2), axis=0)
        else:
            sig = np.concatenate([np.frombuffer(x.as_py(), U) for x in t.column("sigs")])
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            hub = ids[first][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([ids, hub], 1)[ids != hub], axis=0)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

    told = shared_shingles(docs, k, plan, n_blocks)
    packed = packed_texts(docs, n_blocks).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(enter, "bucket int, sigs binary, ids binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long")


def overlaps(sets: list[np.ndarray], num: int, den: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i > j, of all linked sets; with left, only those with i >= left > j."""
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    post = of[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    rank = np.empty(len(token), np.int64)
    rank[order] = np.arange(len(token))
    end = np.cumsum(size)
    a, b = [], []
    for i in range(left or 1, len(sets)):
        own = slice(end[i] - size[i], end[i])
        at = start[token[own]]
        with_ = post[K.ranges(at, rank[own] - at)]  # members before i with each of its tokens
        count = np.bincount(with_, minlength=i)[: left if left is not None else i]
        j = np.flatnonzero(count)
        j = j[den * count[j] >= num * (size[i] + size[j] - count[j])]
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _verified(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rows: grp, side, doc_id, f1, f2, copies, text. Links in each group: between all rows of side 0, or between side 1 and side 2.

    Returns (a, f1, f2, b, w): w > 0 has document a with the set of that fingerprint
    and the copies that it is linked with there, b its least partner so far;
    enough to join and to count links.
    """

    def judged(sets, side, doc, copies, f1, f2):
        split = int((side == 1).sum()) if side[0] else None
        if split == len(side):
            return  # the other block has no document
        i, j = overlaps(sets, num, den, split)
        if not len(i):
            return
        links = np.bincount(i, copies[j], len(sets)).astype(np.int64) + np.bincount(j, copies[i], len(sets)).astype(np.int64)
        root = local_roots(len(sets), i, j)
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], f1[at], f2[at], doc[root[at]], links[at])], ["a", "f1", "f2", "b", "w"])

    def run(batches):
        group, held = None, []
        for batch in batches:
            grp = batch.column(0).to_pylist()
            side, doc, f1, f2, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 6))
            for i, sizes, own in _sets(batch.column(6), k):
                p1, p2 = _prints(own, sizes)
                end = np.cumsum(sizes)
                for j, n in enumerate(sizes.tolist()):
                    r = i + j
                    if grp[r] != group:
                        if len(held) > 1:
                            yield from judged([h[0] for h in held], *(np.array(x) for x in list(zip(*held, strict=True))[1:]))
                        group, held = grp[r], []
                    own_key = (side[r], doc[r], copies[r], f1[r], f2[r])
                    if p1[j] == f1[r] and p2[j] == f2[r] and not (held and held[-1][1:] == own_key):
                        held.append((own[end[j] - n : end[j]].copy(), *own_key))
        if len(held) > 1:
            yield from judged([h[0] for h in held], *(np.array(x) for x in list(zip(*held, strict=True))[1:]))

    return rows.select("grp", "side", "doc_id", "f1", "f2", "copies", "text").mapInArrow(run, "a long, f1 long, f2 long, b long, w long")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rare: int = 32, block_bytes: int = 1 << 23, group_docs: int = 1024, group_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs(doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their
    k-shingle sets. component_id is the least doc_id reachable by links, the
    document's own included; n_links counts the other documents it links with.
    A null or empty text has an empty set: linked with nothing. Fewer than k
    words are one shingle. A row with a repeated doc_id and equal text counts as
    a further copy; different texts under one doc_id are one document's, so in one
    component, but n_links counts one of them for another only if their sets link.
    A row with a null doc_id is linked with nothing and has a null component_id.
    Extra columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    prints = written(fingerprints(docs, k), "prints")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, plan = 8 + int(total // block_bytes), key_plan(total)

    classes = written(prints.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    raw = written(candidate_edges(docs, k, num, den, rare, plan, n_blocks), "candidates")
    # from documents to classes
    ends = raw.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rep = written(prints.join(ends, "doc_id", "left_semi").join(classes, ["n", "f1", "f2"]).select("doc_id", "rep").distinct(), "reps")
    edges = raw.join(rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    # the classes of one document: linked by its id, and verified for n_links
    several = prints.where("n > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("doc_id")
    own_reps = written(prints.where("n > 0").join(several, "doc_id", "left_semi").join(classes, ["n", "f1", "f2"]).select("doc_id", "rep").distinct(), "same")
    same = own_reps.join(own_reps.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select("least", "rep")
    candidate = components(edges.where("ra <> rb").select("ra", "rb").unionByName(same.select(F.col("least").alias("ra"), F.col("rep").alias("rb"))))
    alone = same.select(F.col("rep").alias("node")).distinct().join(candidate, "node", "left_anti")
    candidate = candidate.unionByName(alone.select("node", F.col("node").alias("root")))
    member = candidate.join(classes, F.col("node") == F.col("rep")).select("root", "node", "n", "f1", "f2", "copies")
    member = written(member.withColumn("level", F.floor(F.log("n") * (2 / (math.log(den / num) + 1e-9))) if num < den else F.col("n")), "members")
    found = written(_links(docs, member, k, num, den, group_docs, group_shingles), "links")

    label = components(found.select("a", "b").unionByName(same.select(F.col("least").alias("a"), F.col("rep").alias("b"))))
    links = found.groupBy(F.col("a").alias("rep"), "f1", "f2").agg(F.sum("w").alias("w"))
    own = classes.join(label, classes.rep == label.node, "left").join(links, ["rep", "f1", "f2"], "left")
    own = own.select("n", "f1", "f2", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = prints.where("n > 0").join(own, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = prints.where("n = 0").unionByName(fingerprints(nameless, k))
    return full.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def _links(docs: DataFrame, member: DataFrame, k: int, num: int, den: int, group_docs: int, group_shingles: int) -> DataFrame:
    """The verified links of all candidate components: a task for each small component, and for each block and pair of near blocks of a large one. Sets that link differ by two in level at most."""
    parts = F.ceil(F.greatest(F.col("docs") / group_docs, F.col("total") / group_shingles)).cast("int")
    count = lambda *keys: member.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("n").alias("total")).withColumn("parts", parts)
    large = written(count("root").where("parts > 1").select("root"), "large")
    dealt = written(count("root", "level").join(large, "root", "left_semi").select("root", "level", "parts"), "levels")
    row = ["grp", "side", "node", "f1", "f2", "copies"]
    small = member.join(large, "root", "left_anti").select(F.xxhash64("root").alias("grp"), F.lit(0).alias("side"), *row[2:])
    own = member.join(dealt, ["root", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    within = own.select(F.xxhash64("root", "level", "block").alias("grp"), F.lit(0).alias("side"), *row[2:])
    # a block is the left side with those after it, the right side with those before
    blocks = dealt.select("root", "level", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    other = blocks.select("root", F.col("level").alias("level2"), F.col("block").alias("block2"))
    after = F.struct("level2", "block2") > F.struct(F.col("level").alias("level2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "root").where(after & (F.col("level2") - F.col("level") <= 2)).withColumn("grp", F.xxhash64("root", "level", "block", "level2", "block2"))
    ends = pairs.select("root", "level", "block", "grp", F.lit(1).alias("side")).unionByName(pairs.select("root", F.col("level2").alias("level"), F.col("block2").alias("block"), "grp", F.lit(2).alias("side")))
    rows = small.unionByName(within).unionByName(own.join(ends, ["root", "level", "block"]).select(*row))
    sent = docs.sparkSession.sparkContext.broadcast(id_map(member.select("node")))  # 32 MB at most

    def candidates(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_map(sent.value, batch.column(0).to_numpy(zero_copy_only=False))))

    texts = docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(candidates, "node long, text string").join(rows, "node").withColumnRenamed("node", "doc_id")
    return _verified(texts.repartition("grp").sortWithinPartitions("grp", "side", "doc_id", "f1", "f2"), k, num, den)
