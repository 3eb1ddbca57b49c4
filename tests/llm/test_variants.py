"""SimHash and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from quillforge.llm import queries as Q
from quillforge.llm import simhash as S
from quillforge.llm import spelling as V
from quillforge.llm.common import table

KIND = "doc_id long, text string, fp string, word string, n int, root int"


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "f", "w", 1, 2) for i, t in docs], KIND).repartition(parts)


# -- SimHash ------------------------------------------------------------------------------------


def plain_print(text, k=4):
    words = [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    words = [w.lower() for w in words]
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_prints(rows, radius=4):
    """rows: (doc_id, print); the least doc_id reachable of each row, by a search over all pairs."""
    left, out = set(range(len(rows))), [None] * len(rows)
    prints = np.array([p for _, p in rows], np.uint64)
    while left:
        seen, edge = set(), [left.pop()]
        while edge:
            i = edge.pop()
            seen.add(i)
            near = {j for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius).tolist() if j in left}
            left -= near
            edge += near
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        for i in seen:
            out[i] = min(ids, default=None)
    return out


def texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "X", "É" * 9]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 200))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return docs


ODD = [(900, None), (901, ""), (902, " \n\x0b "), (903, "one"), (904, "ONE"), (905, "a b c"), (None, "a b c"), (906, "x " * 5000), (907, "x" * 100_000), (907, "another text under one id"), (None, "nobody knows this one"), (908, "a b   c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_against_brute_force(spark, seed):
    docs = texts(seed) + ODD
    got = [tuple(r) for r in S.simhash_dedup(frame(spark, docs)).collect()]
    prints = [(i, plain_print(t)) for i, t in docs]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_prints(prints), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("tile", [4, 16, 8192])
def test_links_of_prints_in_buckets_of_any_size(spark, tile):
    """Clusters, chains at the radius and a hot bucket; with small tiles every bucket is cut."""
    rng = random.Random(tile)
    made = {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for base in list(made)[:10]:
        for _ in range(30):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
            made.add(x)
    made |= {x << 40 for x in range(64)}
    made = sorted(made)
    nodes = spark.createDataFrame([(S._signed(x),) for x in made], "fp long")
    from quillforge.llm.common import components

    root = {r["node"]: r["root"] for r in components(S.links(nodes, 4, tile)).collect()}
    want = brute_prints([(S._signed(x), x) for x in made])
    assert [root.get(S._signed(x), S._signed(x)) for x in made] == want


def test_choices_of_runs_lose_no_pair():
    rng = random.Random(5)
    for n, radius in ((10, 4), (1 << 30, 4), (1 << 36, 4), (1 << 20, 2)):
        chosen = S.masks(n, radius, 8192)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not diff & m for m in chosen)
    assert len(S.masks(1 << 30, 4, 8192)) == 15


def test_tiles_give_a_forest():
    rng = np.random.default_rng(3)
    own = np.unique(np.concatenate([rng.integers(0, 1 << 20, 3000), np.uint64(1) << np.arange(60, dtype=np.uint64)]).astype(np.uint64))
    a, b = S.tile_edges(own, None, 4, tile=100)
    assert len(a) == len(np.unique(a)) < len(own)
    x, y = S.tile_edges(own[:500], own[500:], 4, tile=100)
    assert len(x) and (np.bitwise_count(own) >= 0).all()


def test_simhash_of_an_empty_table(spark):
    got = S.simhash_dedup(frame(spark, []))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def test_simhash_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    prints = [(i, plain_print(t)) for i, t in docs]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_prints(prints), strict=True)]
    assert sorted(tuple(r) for r in Q.op11_simhash_dedup(spark, sf).collect()) == sorted(want)


# -- spelling variants ----------------------------------------------------------------------------


def plain_words(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = plain_words(docs)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def noisy_texts(seed, n=200):
    """Frequent words with mistakes of each kind, chains of forms, anagrams, accents."""
    rng = random.Random(seed)
    base = ["keyboard", "necessary", "Étudiante", "straßenbahn", "aaaaaaaa", "abababab", "listener", "enlister", "reenlist", "naïveté×÷"]
    docs = []
    for i in range(n):
        out = []
        for _ in range(40):
            w = rng.choice(base[: rng.choice([1, 2, len(base)])])
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(out)))
    return docs


@pytest.mark.parametrize(("seed", "group"), [(1, 64), (2, 1)])
def test_variants_against_brute_force(spark, seed, group, monkeypatch):
    """With groups of one entry every key is dealt by halves."""
    plain = V.near_words
    monkeypatch.setattr(V, "near_words", lambda words: plain(words, group))
    long = "b" * 30_000
    docs = noisy_texts(seed) + [(None, "keyboard keyboard"), (500, None), (501, ""), (502, "short"), (503, f"{long} {long}c"), (503, f"{long} {long}c"), (504, f"{long} {long}c")]
    key = lambda r: r[0]
    got = sorted((tuple(r) for r in V.spelling_variants(frame(spark, docs)).collect()), key=key)
    want = sorted(brute_variants(docs), key=key)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) or seed == 2 or any(r[1] for r in want)


def test_chains_lead_to_their_end(spark):
    rows = [("abcdefg", 5000), ("abcdefgh", 400), ("abcdefghi", 30), ("abcdefghij", 3), ("zzzzzzz", 2)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(rows)]
    got = {r["word"]: r["root"] for r in V.spelling_variants(frame(spark, docs)).collect()}
    want = {r[0]: r[2] for r in brute_variants(docs)}
    assert got == want and len(set(want.values())) < len(want)


def test_variants_of_an_empty_table(spark):
    got = V.spelling_variants(frame(spark, []))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_variants_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert sorted(tuple(r) for r in Q.op12_spelling_variants(spark, sf).collect()) == sorted(brute_variants(docs))
