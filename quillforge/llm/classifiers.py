"""Operators 1 and 4: classifiers over hashed word n-grams, trained with numpy.

Both learn labels from a bounded sample (the bound is a parameter) and score every
whole text in one pass without a shuffle; a model is a weight table of fixed size.

Operator 1, toxicity: non-negative positive-unlabelled learning. Confirmed toxic
documents are the positives, all documents that may teach, whatever they are, the
unlabelled ones. With the class prior p, the risk is p R+(P, +1) + max(0, R(U, -1) -
p R(P, -1)) under the sigmoid loss; where the second part falls below zero, its
gradient is taken with the opposite sign. Features: which lower-cased words and
which beginnings of words a document has. They are picked by counts over all
unlabelled documents. These are then dealt to shards of some thousands. In each of some
rounds every shard trains in minibatches against the positives, from the mean of the
shards' weights after the round before. So all documents take part, no task holds
more than a shard, and a small corpus is one shard.

Operator 4, quality: logistic regression by follow-the-regularised-leader
updates (per-coordinate rates, L1 and L2). Features: the shares of hashed tokens
and pairs of neighbouring tokens; a token is a run of letters and digits or a
run of other signs, and a token that repeats the one before it is a feature of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import block_of, prepare, row_batches, written

U = np.uint64
_SALT = K.splitmix(31, 6)
#: Bytes of words here: letters, digits, and all of other scripts.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_WORDS = np.where(WORD, K.LOWER, U(0))
_SIGNS = np.where(WORD | K.SPACE, U(0), K.LOWER)
BEGINNING = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0: such rows teach no label."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# -- features ----------------------------------------------------------------------------------


def presence_features(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes): the distinct words and beginnings of words of each text."""
    for i, _, data, offs in K.blocks(texts):
        starts, _, counts = K.spans(data, offs, ~WORD)
        words = K.word_hashes(data, starts, _WORDS)
        head = np.zeros(len(data) + BEGINNING, dtype=bool)
        for p in range(BEGINNING):
            head[starts + p] = True
        short = np.where(head[: len(data)], data, 32)
        begin = K.mix(K.word_hashes(short, starts, _WORDS) ^ _SALT[0]) if len(starts) else words
        both = np.empty(2 * len(words), dtype=U)
        both[0::2], both[1::2] = words, begin
        own, sizes = K.sets(both, counts * 2)
        yield i, sizes, own


def share_features(texts, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens of each text, tokens' features, features of pairs); a text of n tokens has n of each, the first pair being with nothing."""
    for i, _, data, offs in K.blocks(texts):
        a, _, in_words = K.spans(data, offs, ~WORD)
        b, _, in_signs = K.spans(data, offs, WORD | K.SPACE)
        at = np.concatenate([a, b])
        order = np.argsort(at, kind="stable")
        h = np.concatenate([K.word_hashes(data, a, _WORDS), K.word_hashes(data, b, _SIGNS)])[order]
        counts = in_words + in_signs
        of = np.repeat(np.arange(len(counts)), counts)
        before = np.concatenate([[U(0)], h[:-1]]) if len(h) else h
        before = np.where(np.concatenate([[True], of[1:] != of[:-1]]), U(0), before) if len(h) else h
        pair = np.where(h == before, _SALT[1], h * (_SALT[2] | U(1)) + before)
        cut = U(64 - bits)
        yield i, counts, (h >> cut).astype(np.uint32), (K.mix(pair) >> cut).astype(np.uint32)


# -- samples -----------------------------------------------------------------------------------


def teaching(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): the label of each document that is not held out; of several labels of one document the greatest."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, extra: Column | None = None) -> DataFrame:
    """At most `most` labelled rows (doc_id, y, text) that may teach, picked by hash of their ids; texts are whole, of several under one id the least."""
    rows = teaching(labels, label)
    rows = rows if extra is None else rows.where(extra)
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _packed_presence(rows: DataFrame) -> DataFrame:
    """(doc_id, y, f): the distinct features of each text, as 32-bit hashes."""

    def run(batches):
        for batch in batches:
            for i, sizes, own in presence_features(batch.column(2)):
                end = np.cumsum(sizes)
                bits = (own >> U(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sizes)), batch.column(1).slice(i, len(sizes)), pa.array([np.unique(bits[e - n : e]).tobytes() for e, n in zip(end, sizes, strict=True)], pa.binary())], ["doc_id", "y", "f"])

    return rows.mapInArrow(run, "doc_id long, y int, f binary")


def _shared_features(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features that two or more rows of a bounded sample have, ascending, and how many have each."""

    def count(t: pa.Table) -> pa.Table:
        keys, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("f")]), return_counts=True)
        return pa.table({"keys": pa.array([keys[n > 1].tobytes()], pa.binary()), "n": pa.array([n[n > 1].astype(np.uint32).tobytes()], pa.binary())})

    got = packed.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(count, "keys binary, n binary").first()
    return tuple(np.frombuffer(x, np.uint32) for x in got) if got else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))


def _kept_features(packed: DataFrame, keys: np.ndarray) -> list[np.ndarray]:
    """Of each row its features among the keys, by their places, in order of ids."""

    def run(batches):
        for batch in batches:
            rows = [np.flatnonzero(np.isin(keys, np.frombuffer(x.as_buffer(), np.uint32))).astype(np.uint16).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "f"])

    got = packed.select("doc_id", "f").mapInArrow(run, "doc_id long, f binary").toArrow().sort_by("doc_id")
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in got.column("f")]


# -- operator 1 --------------------------------------------------------------------------------


def pick_features(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: float, prior: float, most: int = 4096, least_chi: float = 12.0) -> np.ndarray:
    """Places of the features that speak for toxicity, ascending.

    in_p, in_u: how many of the n_p confirmed and n_u unlabelled documents have each.
    Kept are those that the confirmed have more often by a chi-square of least_chi,
    the best ones first, if at least about two in five of the documents with one
    are positive by the prior; they speak for toxicity or not at all, so that long
    texts don't drown them.
    """
    total = in_p + in_u
    expect = total * n_p / (n_p + n_u)
    pure = prior * in_p / n_p >= 0.4 * np.maximum(in_u, 0.5) / n_u  # 1 for what only positives have
    chi = (in_p - expect) ** 2 / np.maximum(expect, 1e-9) * ((total >= 5) & pure)
    kept = np.argsort(-chi, kind="stable")[:most]
    return np.sort(kept[chi[kept] > least_chi])


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], w: np.ndarray, bias: float, prior: float, epochs: int = 80, rate: float = 0.1, decay: float = 1e-5, seed: int = 5, batch: int = 256) -> tuple[np.ndarray, float]:
    """Weights, none negative, and bias of a linear scorer, by Adam steps from given ones on the non-negative risk over minibatches. positive, unlabelled: the features that each document has."""
    n_features = len(w)
    n_p, n_u = len(positive), len(unlabelled)
    rows = [*positive, *unlabelled]
    col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    rng = np.random.default_rng(seed)
    m, v, step = np.zeros(n_features + 1), np.zeros(n_features + 1), 0
    where_p, where_u = np.arange(n_p), np.arange(n_p, n_p + n_u)
    batches = max(1, n_u // batch)
    for _ in range(epochs):
        parts_u = np.array_split(rng.permutation(where_u), batches)
        parts_p = np.array_split(rng.permutation(np.resize(rng.permutation(where_p), max(n_p, batches * 16))), batches)
        for own_p, own_u in zip(parts_p, parts_u, strict=True):
            slope = {}
            for name, own in (("p", own_p), ("u", own_u)):
                size = start[own + 1] - start[own]
                c = col[K.ranges(start[own], size)]
                s = 1 / (1 + np.exp(-np.clip(K.totals(w[c], size) + bias, -30, 30)))
                d = s * (1 - s) / len(own)
                slope[name] = (s.mean(), np.append(np.bincount(c, np.repeat(d, size), n_features), d.sum()))
            negative = slope["u"][0] - prior * slope["p"][0]  # R(U, -1) - p R(P, -1); the sigmoid loss of -1 is the score
            if negative >= 0:
                grad = slope["u"][1] - 2 * prior * slope["p"][1]
            else:
                grad = prior * slope["p"][1] - slope["u"][1]
            grad[:-1] += decay * w
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w = np.maximum(w - move[:-1], 0)
            bias -= move[-1]
    return w, float(bias)


def _places(keys: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashed features the places among sorted 32-bit keys, and which text each is of; others go."""
    f = (own >> U(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
    hit = keys[at] == f
    return at[hit], np.repeat(np.arange(len(sizes)), sizes)[hit]


def unlabelled_counts(texts: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How many of the texts (one column) have each of the features; tasks send one vector each, in slices."""
    sent, slices = texts.sparkSession.sparkContext.broadcast(keys), 16
    cuts = np.linspace(0, len(keys), slices + 1).astype(int)

    def run(batches):
        keys = sent.value
        count = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, sizes, own in presence_features(batch.column(0)):
                at, of = _places(keys, own, sizes)
                count += np.bincount(np.unique(at * len(sizes) + of) // max(len(sizes), 1), minlength=len(keys))
        if count.any():
            rows = [(i, count[cuts[i] : cuts[i + 1]].tobytes()) for i in range(slices)]
            yield from row_batches(rows, [pa.int32(), pa.binary()], ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
        return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    got = texts.mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").toArrow()
    out = np.zeros(len(keys), np.int64)
    for i, x in zip(got.column("slice").to_pylist(), got.column("counts"), strict=True):
        out[cuts[i] : cuts[i + 1]] = np.frombuffer(x.as_buffer(), np.int64)
    return out


def sharded_nnpu(docs: DataFrame, keys: np.ndarray, positive: list[np.ndarray], n_docs: int, prior: float, shard: int, rounds: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias by iterative mixing: in each round every shard of about `shard` of the unlabelled docs(doc_id, text) trains from the last round's mean, against all the positives (places among the keys)."""
    n_shards = max(1, round(n_docs / shard))
    w, bias = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    sent = docs.sparkSession.sparkContext.broadcast((keys, positive))

    def patterns(batches):
        keys = sent.value[0]
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, sizes, own in presence_features(batch.column(1)):
                at, of = _places(keys, own, sizes)
                cut = np.searchsorted(of, np.arange(len(sizes) + 1))
                rows = [at[a:z].astype(np.uint16).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block_of(doc[i : i + len(sizes)], n_shards)), batch.column(0).slice(i, len(sizes)), pa.array(rows, pa.binary())], ["shard", "doc_id", "f"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        total = sum(np.frombuffer(x.as_buffer()) for x in t.column("w"))
        return pa.table({"shard": t.column("shard").slice(0, 1), "w": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    kind, groups = "shard long, w binary, n long", math.isqrt(n_shards - 1) + 1  # as many groups as vectors in each
    dealt = written(docs.mapInArrow(patterns, "shard long, doc_id long, f binary"), "patterns")

    def training(w: np.ndarray, bias: float, turn: int):
        def fit(t: pa.Table) -> pa.Table:
            t = t.sort_by([("doc_id", "ascending"), ("f", "ascending")])
            rows = [np.unique(np.frombuffer(x.as_buffer(), np.uint16)) for x in t.column("f")]
            own, b = train_nnpu(sent.value[1], rows, w, bias, prior, epochs, rate=0.1 / (1 + turn), seed=5 + turn)
            return pa.table({"shard": t.column("shard").slice(0, 1), "w": pa.array([(np.append(own, b) * len(rows)).tobytes()], pa.binary()), "n": pa.array([len(rows)], pa.int64())})

        return fit

    for turn in range(rounds):
        got = dealt.groupBy("shard").applyInArrow(training(w, bias, turn), kind).groupBy(F.col("shard") % groups).applyInArrow(add, kind).toArrow()
        got = add(got)
        mean = np.frombuffer(got.column("w")[0].as_buffer()) / got.column("n")[0].as_py()
        w, bias = mean[:-1], float(mean[-1])
    return w, bias


def toxicity(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, shard: int = 8000, rounds: int = 8, epochs: int = 10, features: int = 4096) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); labels has doc_id and toxic.

    Learns from at most most_positive confirmed toxic rows and from all documents
    as unlabelled ones, in shards of about `shard`, none of them held out. Its features are the
    `features` words and beginnings of words, at most, that the confirmed have more often than all documents do, by a
    chi-square that counts the unlabelled as one shard of them (all, where there are fewer). The class
    prior is the share of toxic rows among the labelled ones that may teach. Several
    labels of one document count as the greatest. Without any such row, or without
    positives, all scores are the prior. A null or empty text scores as one without
    features; a null doc_id teaches nothing. Rows are scored one by one, so repeated
    ones score alike; extra columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, hits = teaching(labels, "toxic").agg(F.count("*"), F.sum((F.col("y") == 1).cast("int"))).first()
    prior = min(max((hits or 0) / n, 1e-3), 0.95) if n else 1e-3
    confirmed = written(_packed_presence(labelled_sample(docs, labels, "toxic", most_positive, F.col("y") == 1)), "confirmed")
    n_confirmed = confirmed.count()
    teach = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_docs = teach.count()
    keys, w, bias = np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior)))
    if n_confirmed and n_docs:
        keys, in_p = _shared_features(confirmed)
        if len(keys):
            # the unlabelled weigh as a shard of them would, however many there are, so that the test is alike at every size
            weight = min(1.0, shard / n_docs)
            keys = keys[pick_features(in_p, n_confirmed, unlabelled_counts(teach.select("text"), keys) * weight, n_docs * weight, prior, features)]
        if len(keys):
            w, bias = sharded_nnpu(teach, keys, _kept_features(confirmed, keys), n_docs, prior, shard, rounds, epochs)
    model = spark.sparkContext.broadcast((keys, w, bias))

    def run(batches):
        keys, w, bias = model.value
        for batch in batches:
            for i, sizes, own in presence_features(batch.column(1)):
                score = np.full(len(sizes), bias)
                if len(keys) and len(own):
                    at, of = _places(keys, own, sizes)
                    score += np.bincount(of, w[at], len(sizes))
                score = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sizes)), pa.array(score)], ["doc_id", "score"])

    return _judged(docs.mapInArrow(run, "doc_id long, score double"), 0.5)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


# -- operator 4 --------------------------------------------------------------------------------


def fit_ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> tuple[np.ndarray, float]:
    """Weights of the hashed features, and the bias, after FTRL-proximal updates, one document at a time."""
    z, n, w = (np.zeros((1 << bits) + 1) for _ in range(3))
    last = 1 << bits
    for _ in range(epochs):
        for (f, x), truth in zip(rows, y, strict=True):
            at, x = np.append(f, last), np.append(x.astype(np.float64), 1.0)
            own_z, own_n = z[at], n[at]
            own = np.where(np.abs(own_z) <= l1, 0.0, -(own_z - np.sign(own_z) * l1) / ((beta + np.sqrt(own_n)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(own @ x, -30, 30))) - truth) * x
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha
            z[at] = own_z + g - sigma * own
            n[at] = own_n + g * g
    keep = np.abs(z) > l1
    w[keep] = -(z[keep] - np.sign(z[keep]) * l1) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return w[:-1].astype(np.float32), float(w[-1])


#: A share of all tokens is worth so much in a feature; shares of 0.05 already tell much.
SCALE = 10.0


def _packed_shares(rows: DataFrame, bits: int) -> DataFrame:
    """(doc_id, y, n, f, times): tokens of each text, its features and how often each comes, a byte each where that does."""

    def run(batches):
        for batch in batches:
            for i, counts, f, g in share_features(batch.column(2), bits):
                end = np.cumsum(counts)
                keys, values = [], []
                for e, n in zip(end.tolist(), counts.tolist(), strict=True):
                    own, times = np.unique(np.concatenate([f[e - n : e], g[e - n : e]]), return_counts=True)
                    keys.append(own.tobytes())
                    values.append(times.astype(np.uint8 if len(times) and times.max() < 256 else np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(counts)), batch.column(1).slice(i, len(counts)), pa.array(counts), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "y", "n", "f", "times"])

    return rows.mapInArrow(run, "doc_id long, y int, n long, f binary, times binary")


class _Shares:
    """Features and values of the documents of a packed sample, in a given order, worked out anew each time: SCALE times a feature's share of the tokens."""

    def __init__(self, sample: pa.Table, order: np.ndarray):
        self.sample, self.order = sample.combine_chunks(), order

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, times, n = (self.sample.column(c) for c in ("f", "times", "n"))
        for i in self.order.tolist():
            f, t = np.frombuffer(keys[i].as_buffer(), np.uint32), times[i].as_buffer()
            t = np.frombuffer(t, np.uint8 if len(t) == len(f) else np.uint32)
            yield f, (SCALE * t / max(n[i].as_py(), 1)).astype(np.float32)


def quality(docs: DataFrame, labels: DataFrame, most: int = 8000, bits: int = 18, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); labels has doc_id and quality.

    Learns from at most `most` labelled rows, none of them held out; several labels
    of one document count as the greatest. Without any, all scores are 0.5; with
    labels of one kind, they tend to it. A null or empty text scores as one without
    features. Rows are scored one by one, so repeated ones score alike; extra
    columns are left out; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(quality_scores(docs, labels, most, bits), threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 8000, bits: int = 18) -> DataFrame:
    """All columns of docs (a column score apart) and the quality score of the text."""
    prepare(docs.sparkSession)
    docs = docs.drop("score")

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("n", "ascending")])
        order = np.random.default_rng(3).permutation(len(t))
        w, bias = fit_ftrl(_Shares(t, order), (t.column("y").to_numpy() == 1).astype(float)[order], bits)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias])})

    # the sample is bounded: one task trains on it, and the driver gets the weights only
    trained = _packed_shares(labelled_sample(docs, labels, "quality", most), bits).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "w binary, bias double").first()
    w, bias = (np.frombuffer(trained["w"], np.float32), trained["bias"]) if trained else (np.zeros(1 << bits, np.float32), 0.0)
    model = docs.sparkSession.sparkContext.broadcast((w, bias))

    text = docs.columns.index("text")

    def run(batches):
        w, bias = model.value
        for batch in batches:
            scores = []
            for _, counts, f, g in share_features(batch.column(text), bits):
                of = np.repeat(np.arange(len(counts)), counts)
                total = np.bincount(of, w[f].astype(np.float64) + w[g], len(counts))
                scores.append(1 / (1 + np.exp(-np.clip(bias + SCALE * total / np.maximum(counts, 1), -30, 30))))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
