"""The Jaccard join and window deduplication against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from quillforge.llm import jaccard_join as J
from quillforge.llm import kernel as K
from quillforge.llm import window_dedup as W
from quillforge.llm.common import Keys as K2

KIND = "doc_id long, text string, score double, block long, rep string, a int"


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, 0.1, 1, "r", 2) for i, t in docs], KIND).repartition(parts)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed, n=60):
    """Near copies by small changes, exact copies, a passage that many share, short, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x y", "É" * 9]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        if rng.random() < 0.2:
            w = passage * rng.choice([1, 2])
        docs.append((rng.choice([i, i, -i]), rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.02 else x for x in w)))
    return [*dict(docs).items(), (1001, ""), (1002, None), (1003, " \n "), (1004, "One two"), (1005, "one TWO"), (1006, "one two three")]


def brute_components(docs, num=80, den=100):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, x in enumerate(ids):
        for y in ids[p + 1 :]:
            both = len(sets[x] & sets[y])
            if both and den * both >= num * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), links[i]) for i in ids)


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"rare": 1}), (3, {"rare": 2, "group_docs": 3}), (4, {"rare": 1, "group_shingles": 50, "block_bytes": 500})])
def test_jaccard_join_against_brute_force(spark, seed, options, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    docs = corpus(seed)
    got = sorted(tuple(r) for r in J.jaccard_join(frame(spark, docs), **options).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute_components(docs)


def test_jaccard_prefixes_lose_no_link():
    """Linked sets share an entry, whatever classes their shingles have."""
    rng = np.random.default_rng(5)
    least = lambda n: -(-80 * n // 100)
    for _ in range(400):
        n = int(rng.integers(4, 90))
        base = np.unique(rng.integers(0, 1 << 62, n + 30).astype(np.uint64))
        df_of = dict(zip(base.tolist(), rng.choice([1, 2, 3, 9, 50, 700], len(base)).tolist(), strict=True))
        x, extra = base[:n], base[n:]
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        y = np.sort(np.concatenate([rng.permutation(x)[drop:], extra[: int(rng.integers(0, drop + 1))]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        shared = set(np.intersect1d(x, y).tolist())
        entries = [set(J.prefix_entries(s, np.array([max(df_of[v], 2) if v in shared else df_of[v] * (df_of[v] > 1) for v in s.tolist()]), least, 8).tolist()) for s in (np.sort(x), y)]
        # a shingle of both has a count of two or more, one count for both sets
        assert entries[0] & entries[1]


@pytest.mark.parametrize("percent", [10, 20, 30, 40, 50, 60, 80, 100])
def test_jaccard_prefixes_at_any_threshold(percent):
    """No pair of linked sets without a common entry, at low thresholds and in small sets too."""
    rng = np.random.default_rng(percent)
    least = lambda n: -(-percent * n // 100)
    seen = 0
    for _ in range(40):
        pool = rng.integers(0, 1 << 62, int(rng.integers(6, 70))).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 40)))) for _ in range(14)]
        df_of = {int(v): sum(v in x for x in sets) for v in pool}
        rare = int(rng.integers(1, 4))
        entries = [set(J.prefix_entries(x, np.array([df_of[int(v)] if df_of[int(v)] > 1 else 0 for v in x]), least, rare).tolist()) for x in sets]
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if both and 100 * both >= percent * (len(x) + len(sets[j]) - both) and not np.array_equal(x, sets[j]):
                    seen += 1
                    assert entries[i] & entries[j]
    assert seen or percent >= 80


def test_ranks_keep_the_order_of_counts():
    df = np.unique(np.concatenate([np.arange(300), np.geomspace(300, 1e12, 400).astype(np.int64)]))
    rank = J.rank_of(df).astype(int)
    assert (np.diff(rank) >= 0).all()
    assert (rank[df <= 64] == df[df <= 64]).all()


def test_id_maps_and_packed_texts(spark):
    from quillforge.llm.common import id_map, in_map, packed_texts, unpacked_texts

    ids = list(range(-50, 4000, 7)) + [2**63 - 1, -(2**63)]
    bits = id_map(spark.createDataFrame([(i,) for i in ids], "x long").repartition(3))
    assert in_map(bits, np.array(ids)).all()
    assert in_map(bits, np.arange(10**6, 10**6 + 2000)).mean() < 0.2
    assert not id_map(spark.createDataFrame([], "x long")).any()
    texts = [(i, x) for i, x in enumerate(["", None, "é" * 10, "a b", "x" * 100_000] * 3)]
    got = []
    for r in packed_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), 4, limit=50).toArrow().to_batches(max_chunksize=1):
        doc, own = unpacked_texts(pa.Table.from_batches([r]))
        got += zip(doc.tolist(), own.to_pylist(), strict=True)
    assert sorted(got) == [(i, x or "") for i, x in texts]


def test_very_long_texts(spark):
    """A text of many blocks, near copies of it, and a passage of it in another."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    near = [*long[:-9], *["new"] * 9]
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[500:600])), (2**63 - 1, " ".join(near)), (None, " ".join(long[:40]))]
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_join(frame(spark, docs)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 0), 2**63 - 1: (1, 2), None: (None, 0)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in W.window_dedup(frame(spark, docs)).collect()}
    assert got[1] == (150_000, 0)
    assert got[3] == (100, 100)
    assert got[2] == (150_000, 150_000 - 9)
    assert got[2**63 - 1] == (150_000, 150_000)
    assert got[None] == (40, 40)


def test_jaccard_empty_null_and_repeated(spark):
    assert J.jaccard_join(frame(spark, [])).collect() == []
    docs = [(7, "a b c d e f"), (7, "a b c d e f"), (9, "A B c d e f"), (None, "a b c d e f"), (8, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_join(frame(spark, docs)).collect())
    assert got == [(-1, 2, None, 0), (7, 2, 7, 2), (7, 2, 7, 2), (8, 0, 8, 0), (9, 2, 7, 2)]


@pytest.mark.parametrize("options", [{}, {"group_docs": 2}])
def test_jaccard_ids_with_several_texts(spark, options):
    """Two sets of one id, each with links of its own; one set that a smaller id has too; two sets of one id that link with each other."""
    rng = random.Random(9)
    text = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(90)) for _ in range(60)]
    near = lambda w, x: " ".join([*w[:-1], x])
    a, b, c, d, e, f = (text() for _ in range(6))
    docs = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a, "x")), (7, near(b, "x")), (8, near(b, "y")), (3, " ".join(c)), (9, " ".join(c)), (9, " ".join(d)), (20, " ".join(e)), (20, near(e, "x")), (30, " ".join(f)), (30, None)]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in J.jaccard_join(frame(spark, docs), **options).collect())
    assert got == [(3, 3, 1), (5, 5, 1), (5, 5, 2), (6, 5, 1), (7, 5, 2), (8, 5, 2), (9, 3, 0), (9, 3, 1), (20, 20, 1), (20, 20, 1), (30, 30, 0), (30, 30, 0)]


def brute_windows(docs, k):
    first = defaultdict(lambda: float("inf"))
    key = lambda i: float("inf") if i is None else i
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - k + 1):
            first[tuple(w[p : p + k])] = min(first[tuple(w[p : p + k])], key(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < key(i):
                gone[p : p + k] = [True] * k
        out.append((key(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "hot", "k"), [(11, 16, 13), (12, 0, 13), (13, 1, 4)])
def test_window_dedup_against_brute_force(spark, seed, hot, k, monkeypatch):
    monkeypatch.setattr(W, "HOT_BLOCKS", hot)
    docs = [*corpus(seed), (None, "a " * 40), (5000, "a " * 30), (5000, "a " * 30)]
    got = W.window_dedup(frame(spark, docs), k, block_bytes=1000).collect()
    assert sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_windows(docs, k)
    assert all(sum(x.words for x in r.removed) == r.n_removed for r in got)


@pytest.mark.parametrize("rows", [1, 3])
def test_window_dedup_with_other_sketches(spark, rows, monkeypatch):
    """Narrow maps fill up and lose nothing; wide keys; shares of a few windows."""
    monkeypatch.setattr(W, "MAP_BITS", 13)
    monkeypatch.setattr(W, "ENTRIES", 50)
    monkeypatch.setattr(W, "key_plan", lambda total: K2(9, 32))
    docs = corpus(17)
    got = W.window_dedup(frame(spark, docs), 5, block_bytes=1000, rows=rows).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_windows(docs, 5)


def test_window_dedup_frequent_windows(spark, monkeypatch):
    """Only some of many hot windows are told to all; results stay, no block gets a row for a window that it has not, and what is told to all has its bound."""
    monkeypatch.setattr(W, "HOT_BLOCKS", 2)
    monkeypatch.setattr(W, "FREQUENT", 1)
    rng = random.Random(23)
    passage = [f"p{i}" for i in range(600)]
    docs = [(i, " ".join(passage if i % 3 == 0 else [f"u{rng.randrange(10**9)}" for _ in range(40)])) for i in range(60)]
    got = W.window_dedup(frame(spark, docs), 5, block_bytes=2000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_windows(docs, 5)
    plan, n_blocks = K2(8, 24), 500
    maps, full = W.repeated_map(frame(spark, docs), 5, plan, 2)
    assert 0 < len(full) <= 1 << plan.bits
    told = W._earlier(frame(spark, docs), 5, plan, n_blocks, spark.sparkContext.broadcast((maps, full)))
    holders = set(W.block_of(np.array([i for i, _ in docs if i % 3 == 0]), n_blocks).tolist())
    rows = told.collect()
    assert {r.block for r in rows} <= holders | {W.FOR_ALL}
    hot, least = W._frequent(told)
    assert 0 < len(hot) < 596  # 596 windows come in 20 documents each
    assert set(least.tolist()) == {0}
    assert len(set(hot.tolist())) + len({x for r in rows if r.block != W.FOR_ALL for x in np.frombuffer(r.windows, np.uint64).tolist()}) == 596


def test_window_dedup_empty(spark):
    assert W.window_dedup(frame(spark, [])).collect() == []


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé \n\tÀ.") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "x" * 5000]
    seen = {}
    arr = pa.array(texts)
    for i, j, data, offs in K.blocks(arr, limit=100):
        starts, ends, counts = K.spans(data, offs)
        h = K.word_hashes(data, starts, K.EXACT)
        raw, at = data.tobytes(), 0
        for r in range(i, j):
            own = words(texts[r])
            assert counts[r - i] == len(own)
            for w in own:
                assert raw[starts[at] : ends[at]].decode() == w
                assert seen.setdefault(w, h[at]) == h[at]
                at += 1
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    """Random pairs, one long chain, one star, loops and null ends."""
    from quillforge.llm.common import components, local_roots

    rng = random.Random(seed)
    chain = rng.sample(range(1000, 5000), 300)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + list(zip(chain, chain[1:], strict=False)) + [(7000, i) for i in range(7001, 7100)] + [(1, 1), (None, 3), (4, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()}
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert got == {v: find(v) for v in root}
    nodes = sorted(root)
    place = {v: i for i, v in enumerate(nodes)}
    ends = [(place[a], place[b]) for a, b in edges if a in place and b in place]
    roots = local_roots(len(nodes), np.array([a for a, _ in ends]), np.array([b for _, b in ends]))
    assert [nodes[i] for i in roots] == [find(v) for v in nodes]
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_components_raise_when_not_stable(spark):
    from quillforge.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long").repartition(30)
    assert {r.root for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError, match="not stable"):
        components(edges, 1)
