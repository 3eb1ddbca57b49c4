"""Classifiers by held-out accuracy; mixing, packing, decontamination and the pipeline by plain versions."""

import base64
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as C
import duckdb
import numpy as np
import pytest
from quillforge.llm import classifiers as L
from quillforge.llm import decontamination as D
from quillforge.llm import packing as P
from quillforge.llm.mixing import ORACLE_SQL, mix_sources


def made(n=1500, seed=1):
    """Texts with labels: some have a word from a bad list, some are of poor form."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic, good = rng.random() < 0.12, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "vilest"])
        if not good:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [w[0]] * len(w)
        docs.append((i, " ".join(w), "en", "s", 1))
        if rng.random() < 0.7:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = made()
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(L.toxicity, "toxic"), (L.quality, "quality")])
def test_held_out_accuracy(labelled, score, label):
    docs, labels = labelled
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_without_labels_or_texts(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0)], DOCS)
    for score in (L.toxicity, L.quality):
        assert len(score(odd, labels).collect()) == 2
        assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1
        assert score(docs.limit(0), labels).collect() == []


def test_held_out_rows_teach_nothing(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(L.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in L.quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 2 * sizes[s]}
        if not over:
            return full | {s: share * w[s] for s in open_}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 40, 300])), "en", rng.choice(["a", "a", "a", "b", "c", "d", "é", None]), 1) for i in range(900)] + [(-1, None, "en", "b", 0)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mix_sources(df).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(size)
    assert len(rows) == len(docs)
    for s, t in want.items():
        assert abs(target[s] - t) <= 1e-9 * t and abs(taken[s] - t) <= 0.01 * t + 64
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_sources(df.repartition(5)).collect()), key=str)
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    twin = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(ORACLE_SQL).fetchall())
    assert twin == sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows)


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)
    assert sorted((r.doc_id, r.target, r.taken) for r in mix_sources(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert mix_sources(df.limit(0)).collect() == []


def test_best_fit_decreasing_against_plain_version():
    rng = random.Random(6)
    for _ in range(200):
        row = rng.choice([5, 16, 33])
        sizes = np.array([rng.randint(1, row) for _ in range(rng.randint(0, 60))], dtype=np.int64)
        out, n = P.best_fit_decreasing(sizes, row)
        free = []
        for p in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [f for f in free if f >= sizes[p]]
            if fits:
                assert free[out[p]] == min(fits)
            else:
                assert out[p] == len(free)
                free.append(row)
            free[out[p]] -= sizes[p]
        assert n == len(free)


def test_packing_round_trip(spark):
    import tiktoken

    texts = ["", None, "a", " a  b\n\nc\t d ", "é ü 日本語 ｆ", "word " * 300, "<|endoftext|> x", "it's we'll\r\n  end  ", "\n", "x" * 500]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(2)
    rows = [r.asDict() for r in P.pack_tokens(docs, row=64, tokens=500).collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = P.unpack(rows)
    assert {i: enc.decode(x) for i, x in got.items()} == {i: t or "" for i, t in enumerate(texts)}
    for r in rows:
        ids, cu = np.frombuffer(r["ids"], np.uint16), r["cu_seqlens"]
        assert len(ids) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == P.PAD).all()
        assert r["resets"] == [a for a, z in zip(cu, cu[1:], strict=False) if z > a]
    assert P.pack_tokens(docs.limit(0)).collect() == []


ITEM = "A train leaves Paris at 9 and covers 120 km in 2 hours while Maria waits near the old bridge with her three dogs until noon."


def test_leaks(spark):
    def with_(text):
        return "Some words before it stand here and there. " + text + " And some follow after that, as they do."

    docs = {
        1: with_(ITEM), 2: with_(ITEM.replace("120", "350").replace("Maria", "Ingrid Berg").replace("2 hours", "5 hours")), 3: with_(ITEM.upper().lower().replace("paris", "Paris").replace("maria", "Maria")),
        4: "A train is a thing that covers ground while people wait near an old bridge.", 5: None, 6: "", 7: with_(ITEM[:40]),
    }
    # the same form, but one value of the item stands for several others
    item2 = "Ann gave Bob 5 apples and then said to Ann that she has 5 apples while the others of the group had 5 pears and 5 plums."
    docs[8] = with_("now " + item2)
    docs[9] = with_("now Ann gave Bob 7 apples and then said to Carl that she has 8 apples while the others of the group had 9 pears and 11 plums.")
    bench = spark.createDataFrame([(1, ITEM), (2, "so " + item2), (3, None), (4, "too short")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], DOCS)
    found = {(r.doc_id, r.item_id): (r.n_slots > 0, r.n_changed > 0) for r in D.leaks(df, bench).collect()}
    assert found == {(1, 1): (True, False), (2, 1): (True, True), (3, 1): (True, False), (8, 2): (True, False)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench, map_bits=10).collect()} == set(found)
    assert {r.doc_id for r in D.without_leaks(df, bench).collect()} == {4, 5, 6, 7, 9}
    assert D.leaks(df.limit(0), bench).collect() == [] and D.leaks(df, bench.limit(0)).collect() == []


def test_leaking_copies_are_judged_once(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, f"before it {item} after it") for i in range(300)] + [(1000 + i, f"quite another text of number {i} that holds nothing of note") for i in range(50)]
    rows += [(2000, None), (2001, ""), (None, f"before it {item} after it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id for r in D.without_leaks(docs, bench).collect()} == {*range(1000, 1050), 2000, 2001}
    assert D._new(seen := set(), [1, 1, 2, 1], [1, 1, 1, 2]) == [True, False, True, True] and len(seen) == 3
    many = D._new(set(), [*range(D.KEYS + 5), 0], [0] * (D.KEYS + 6))
    assert all(many)  # forgotten keys are judged again, never passed over


def test_leaks_of_a_later_occurrence(spark):
    """The item's form with values that fit no mapping, then the item: verbatim, with other values, or with words put in."""
    item = "so Ann gave Bob 5 apples and then said to Ann that she has 5 apples while the others of the group had 5 pears and 5 plums."
    off = "so Ann gave Bob 7 apples and then said to Carl that she has 8 apples while the others of the group had 9 pears and 11 plums."
    other = item.replace("5", "6").replace("Ann", "Eve")
    longer = item.replace("that she has", "that she surely has")
    texts = [f"Here it stands. {off} And then. {x} So it ends." for x in (item, other, longer, off)] + [f"Here it stands. {other} And then. {item} So it ends."]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.n_changed > 0 for r in D.leaks(df, bench).collect()} == {0: False, 1: True, 2: False, 4: False}
    assert {r.doc_id for r in D.without_leaks(df, bench).collect()} == {3}


def plain_template(text):
    """(token, kind, value) of a text by the rules in words, and its plain words."""
    raw = (text or "").encode()
    found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw))
    low = lambda w: re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m[0][1] + 32]), bytes(c + 32 if 65 <= c <= 90 else c for c in w))
    kinds = []
    for i, m in enumerate(found):
        w = m[0]
        fresh = not i or re.search(rb'[.!?:;\n"]', raw[found[i - 1].end() : m.start()])
        capital = w[0:1].isupper() and w[0] < 128 or (w[0] == 0xC3 and len(w) > 1 and 0x80 <= w[1] <= 0x9E and w[1] != 0x97)
        if re.search(rb"[0-9]", w) or low(w).decode("latin1") in D.NUMBER_WORDS:
            kinds.append(D.NUMBER)
        elif capital and not fresh and len(w) > 1:
            kinds.append(D.NAME)
        else:
            kinds.append(0)
    for i in range(1, len(found)):
        if kinds[i - 1] == D.NUMBER and not kinds[i] and low(found[i][0]).decode("latin1") in D.UNITS:
            kinds[i] = D.UNIT
    out, i = [], 0
    while i < len(found):
        j = i + 1
        while kinds[i] and j < len(found) and kinds[j] == kinds[i]:
            j += 1
        words = tuple(low(m[0]) for m in found[i:j])
        out.append((kinds[i] or words[0], kinds[i], words))
        i = j
    return out, [low(m[0]) for m in found]


def plain_leaks(docs, items, k=5, coverage=0.33, agree=0.8, least=3, fewest=4):
    """Pairs of documents and items, each compared with each; alignments far apart are not merged, so for texts without words put in."""
    windows = lambda t: {p: tuple(x[0] for x in t[p : p + k]) for p in range(len(t) - k + 1) if sum(not x[1] for x in t[p : p + k]) >= (k + 1) // 2}
    out = set()
    for item_id, item in items:
        t, words = plain_template(item)
        own = windows(t)
        for doc_id, doc in docs:
            u, others = plain_template(doc)
            if not own:
                m = len(words)
                if m and (words == others if m < least else any(others[p : p + m] == words for p in range(len(others)))):
                    out.add((doc_id, item_id, True))
                continue
            theirs = windows(u)
            along = defaultdict(set)
            for a, w in own.items():
                for p, v in theirs.items():
                    if v == w:
                        along[p - a].add(a)
            enough = max(coverage * len(own), min(len(own), fewest))
            if _by_words(words, others, k, coverage, fewest):
                out.add((doc_id, item_id, True))
            if not along or len(set().union(*along.values())) < enough:
                continue
            good = []
            for shift, places in along.items():
                if len(places) < enough and len(places) < max(map(len, along.values())):
                    continue
                slots = sorted({a + i for a in places for i in range(k) if t[a + i][1]})
                pairs = [(t[s][2], u[s + shift][2]) for s in slots]
                there, back = defaultdict(Counter), defaultdict(Counter)
                for x, y in pairs:
                    there[x][y] += 1
                    back[y][x] += 1
                fit = sum(there[x].most_common(1)[0][0] == y and back[y].most_common(1)[0][0] == x for x, y in pairs)
                if fit >= agree * len(pairs):
                    good.append((-len(places), sum(x != y for x, y in pairs)))
            if good:
                same = any(others[p : p + len(words)] == words for p in range(len(others)))
                out.discard((doc_id, item_id, True))
                out.add((doc_id, item_id, same or min(good)[1] == 0))
    return out


def _by_words(words, others, k, coverage, fewest):
    """Whether enough windows of an item's words come in a text, in alignments up to 8 words apart."""
    own = len(words) - k + 1
    met = [(p - a, a) for a in range(own) for p in range(len(others) - k + 1) if others[p : p + k] == words[a : a + k]]
    return any(len({a for shift, a in met if abs(shift - x) <= 8}) >= max(coverage * own, min(own, fewest)) for x, _ in met)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_against_plain_version(spark, seed):
    """Items verbatim, with other values consistently or not, in parts, short and numeric ones, repeated; among plain texts."""
    rng = random.Random(seed)
    words = ["train", "leaves", "bridge", "old", "near", "waits", "group", "apples", "the", "a", "of", "and", "covers"]
    names, units = ["Paris", "Maria", "Ingrid", "Écija", "Bob"], ["km", "hours", "kg"]

    def sentence(n):
        return [rng.choice(names) if (x := rng.random()) < 0.12 else f"{rng.randrange(200)} {rng.choice(units)}" if x < 0.22 else rng.choice(words) for _ in range(n)]

    items = [(i, " ".join(sentence(rng.randint(6, 40))) + ".") for i in range(12)]
    items += [(20, "17 + 25 - 99 12 it"), (21, "alpha beta gamma delta"), (22, "Alpha"), (23, "one two"), (24, ""), (25, None), (26, "12, 13, 14, 15, 16, 17, 18, 19, 20, 21 and 22"), (27, items[3][1])]
    docs = [(0, None), (1, ""), (2, "x alpha BETA gamma delta y"), (3, "alpha"), (4, "alpha beta"), (5, "one, two"), (6, "so 17+25-99/12 it was"), (7, "12 13 14 15 16 17 18 19 20 21 and 22"), (8, "12 13 14 15 16 17 18 19 20 21 and 23")]
    for i in range(10, 110):
        parts = [" ".join(sentence(rng.randint(3, 30)))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1] or ""
            how = rng.random()
            if how < 0.4:
                other = {n: rng.choice(names) for n in names} if how < 0.2 else dict(zip(names, rng.sample(names, len(names)), strict=True))
                x = " ".join(other.get(w, str(int(w) + 7) if w.isdigit() else w) for w in x.split(" "))
            elif how < 0.6:
                x = x[rng.randrange(len(x) + 1) :]
            parts += [x, " ".join(sentence(rng.randint(3, 30)))]
        docs.append((i, rng.choice([". ", "\n", ", "]).join(parts)))
    docs += [docs[-1], (None, items[0][1])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, h string, item_id string, k1 int").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, h int").repartition(2)
    want = {(i, 3 if x == 27 else x, same) for i, x, same in plain_leaks(docs, items)}  # 27 has the text of 3
    rows = D.leaks(df, bench).collect()
    assert all(r.n_items == 1 + (r.item_id == 3) for r in rows)
    assert {(r.doc_id, r.item_id, r.n_changed == 0) for r in rows} == want
    assert {(2, 21, True), (3, 22, True), (5, 23, True), (6, 20, True), (7, 26, True)} <= want and not any(i in (4, 8) for i, _, _ in want)
    assert Counter((r.doc_id, r.item_id) for r in rows)[docs[109][0], 3] in (0, 2)
    clean = D.without_leaks(df, bench)
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in docs if i not in {x[0] for x in want})


@pytest.mark.parametrize("case", [str, str.upper, str.lower, str.title])
def test_leaks_in_any_letter_case(spark, case):
    """All items of the test table, and a short one with a name, within other words."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(5000, "What is the capital of France ?")]
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 8)))
    other = lambda: " ".join(word() for _ in range(40))
    docs = [(i, f"{other()}. {case(t)} {other()}") for i, t in items] + [(9000 + i, other()) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(i, i) for i, _ in items}
    assert all(r.doc_id < 9000 for r in found)
    assert {r.doc_id for r in D.without_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == set(range(9000, 9020))


def test_items_of_one_template_are_joined_once(spark):
    """300 items and 300 documents of one template: a row for each document; equal values in other places are another class."""
    form = "The train leaves {} at {} and reaches {} near the old bridge after {} hours of slow travel in the rain."
    items = [(i, form.format("Paris", i % 24, "Rome", i + 30)) for i in range(300)] + [(900, form.format("Paris", 7, "Paris", 7)), (901, "another item of words alone that stands by itself here")]
    docs = [(i, "Some say so. " + form.format("Oslo", 1000 + i, "Bergen", i)) for i in range(299)] + [(299, items[5][1])]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    same = {i: 0 if i % 24 != i + 30 else i for i, _ in items[:300]}
    assert {r.item_id: r.class_id for r in D.item_classes(b).collect()} == same | {900: 900, 901: 901}
    rows = D.leaks(d, b).collect()
    own = [r for r in rows if r.item_id == 0]
    assert sorted(r.doc_id for r in own) == list(range(300)) and {r.n_items for r in own} == {300}
    assert len(rows) <= 600 and {r.doc_id for r in own if r.n_changed == 0} == {299}
    met = D._class_windows(D.item_windows(b, 5, 3))
    assert met.where("size = 0 and item_id = 0").count() < 30


def test_leaks_with_noise_and_in_long_texts(spark):
    """Nine in ten items with 10 % of their words replaced are found; an item in a very long text; a word that all texts have."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(50))) for i in range(60)]
    noisy = [(i, " ".join("noise" if rng.random() < 0.1 else w for w in t.split())) for i, t in items]
    long = " ".join(word() for _ in range(120_000))
    docs = [(i, f"The common start of all texts here. {t} And more.") for i, t in noisy] + [(100, f"{long} {items[5][1]} {long}")]
    bench = spark.createDataFrame([*items, (99, "the common start of all texts now")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert (100, 5) in found
    assert sum((i, i) in found for i, _ in items) >= 54
    assert all(i == j or j == 99 or i == 100 for i, j in found)


def test_pipeline_stages(spark):
    """Each stage by what it must do to its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_name = dict(C.STAGES)
    kept = C.keep_quality(spark, docs, sf)
    assert kept.columns == C.COLUMNS
    good = {r.doc_id for r in L.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.3").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    twice = docs.unionByName(docs)
    assert C.drop_near_duplicates(spark, twice, sf).count() == C.drop_near_duplicates(spark, docs, sf).count() < docs.count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    clean = C.drop_leaks(spark, docs, sf)
    want = {r.doc_id for r in docs.collect() if not any(b.text in r.text for b in bench)}
    assert {r.doc_id for r in clean.collect()} == want
    taken = {r.doc_id: (r.taken, r["size"]) for r in mix_sources(docs).collect()}
    times = defaultdict(int)
    for r in C.mix(spark, docs, sf).collect():
        times[r.doc_id] += 1
    assert dict(times) == {i: int(t / n + 0.5) for i, (t, n) in taken.items() if n and int(t / n + 0.5)}
    assert list(by_name) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    assert C.run(spark, sf).count() > 0


def test_pipeline_null_and_repeated_ids(spark):
    """No text is lost or multiplied where the id is null or comes with another text."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(90)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(5, a), (5, b), (5, b), (3, a), (None, c), (None, d), (None, d), (7, c), (8, None), (2, e), (2, e + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = C.drop_near_duplicates(spark, docs, "")
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    one = {(2, e), (2, e + " x")} & set(kept)
    assert got.columns == C.COLUMNS and len(one) == 1
    assert kept == Counter([(5, b), (3, a), (None, c), (None, d), (None, d), (7, c), (8, None), *one])

    texts = [(i if i < 40 else 40 if i < 50 else None, text() + " z" * (i % 3)) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en", rng.choice(["s", "t", None]), 1) for i, t in texts], DOCS).repartition(3)
    want, most = Counter(), Counter((r.doc_id, r.source, len(r.text.split())) for r in docs.collect())
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.source, r["size"]] += int(r.taken / r["size"] + 0.5)
    mixed = C.mix(spark, docs, "").collect()
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed)
    assert got == +want and any(k[0] is None for k in got) and max(Counter(r.text for r in mixed).values()) <= 2
    assert all(n <= 2 * most[k] for k, n in got.items())


def test_small_sources_get_their_words(spark):
    """Sources of 1 to 40 words beside a large one: each takes its target to the word, no document more than twice its size."""
    docs = [(i, " ".join(["w"] * n), "en", f"s{n:02d}", 1) for i, n in enumerate(range(1, 41))] + [(100 + i, "x " * 500, "en", "large", 1) for i in range(40)] + [(900, "a b c d e", "en", None, 1), (901, "f g", "en", None, 1)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mix_sources(df).collect()
    want, taken, target = plain_targets({s: sum(len(t.split()) for _, t, _, x, _ in docs if x == s) for s in {d[3] for d in docs}}), defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 0.5 + 1e-6
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted((r[0], r[4]) for r in con.execute(ORACLE_SQL).fetchall()) == sorted((r.doc_id, r.taken) for r in rows)


def test_nnpu_against_plain_loops():
    """The same minibatches, one document and one feature at a time; some with the sign of the gradient switched."""
    import math

    rng = random.Random(3)
    for prior in (0.05, 0.9):
        positive = [sorted(rng.sample(range(6), rng.randint(prior > 0.5, 4))) for _ in range(9)]
        unlabelled = [sorted(rng.sample(range(6), rng.choice([0, 0, 1, 2]) if prior < 0.5 else 0)) for _ in range(40)]
        got, bias = L.train_nnpu([np.array(x, np.int64) for x in positive], [np.array(x, np.int64) for x in unlabelled], np.zeros(6), math.log(prior / (1 - prior)), prior, epochs=30, batch=16)
        rows, order = positive + unlabelled, np.random.default_rng(5)
        w, b = [0.0] * 6, math.log(prior / (1 - prior))
        m, v, step, batches, switched = [0.0] * 7, [0.0] * 7, 0, 40 // 16, 0
        for _ in range(30):
            parts_u = np.array_split(order.permutation(np.arange(9, 49)), batches)
            parts_p = np.array_split(order.permutation(np.resize(order.permutation(np.arange(9)), max(9, batches * 16))), batches)
            for own_p, own_u in zip(parts_p, parts_u, strict=True):
                risk, slope = {}, {}
                for name, own in (("p", own_p), ("u", own_u)):
                    risk[name], slope[name] = 0.0, [0.0] * 7
                    for i in own:
                        s = 1 / (1 + math.exp(-(sum(w[f] for f in rows[i]) + b)))
                        risk[name] += s / len(own)
                        for f in [*rows[i], 6]:
                            slope[name][f] += s * (1 - s) / len(own)
                # risk of P as toxic: 1 - s; of U and P as clean: s
                if risk["u"] - prior * risk["p"] >= 0:
                    grad = [u - prior * p - prior * p for u, p in zip(slope["u"], slope["p"], strict=True)]
                else:
                    grad, switched = [prior * p - u for u, p in zip(slope["u"], slope["p"], strict=True)], switched + 1
                step += 1
                for f in range(7):
                    g = grad[f] + (1e-5 * w[f] if f < 6 else 0)
                    m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g * g
                    move = 0.1 * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
                    if f < 6:
                        w[f] = max(w[f] - move, 0.0)
                    else:
                        b -= move
        assert np.allclose(got, w, atol=1e-9, rtol=0) and abs(bias - b) < 1e-9
        assert switched or prior < 0.5


def test_ftrl_against_plain_loops():
    import math

    rng = random.Random(4)
    rows = [sorted(rng.sample(range(16), rng.randint(0, 6))) for _ in range(60)]
    values = [[rng.random() * 3 for _ in r] for r in rows]
    y = [int(3 in r or rng.random() < 0.2) for r in rows]
    got, bias = L.fit_ftrl([(np.array(r, np.uint32), np.array(x, np.float32)) for r, x in zip(rows, values, strict=True)], np.array(y, float), 4)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.001
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)
    for _ in range(3):
        for r, x, truth in zip(rows, values, y, strict=True):
            pairs = [*zip(r, (float(np.float32(a)) for a in x), strict=True), (16, 1.0)]
            w = {f: weight(f) for f, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[f] * a for f, a in pairs)))
            for f, a in pairs:
                g = (p - truth) * a
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    assert np.allclose(got, [weight(f) for f in range(16)], atol=1e-6) and abs(bias - weight(16)) < 1e-9


def test_classifiers_with_repeated_and_clashing_rows(spark, labelled):
    """Conflicting labels count as the greatest, whatever their order; columns named like ours; one very long text; several shards."""
    docs, labels = labelled
    from pyspark.sql import functions as F

    twice = labels.unionByName(labels.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    more = docs.withColumns({"score": F.lit("x"), "held_out": F.lit(1), "y": F.lit(2), "shard": F.lit("s"), "f": F.lit(b"")}).unionByName(
        docs.limit(1).select(F.lit(10_000).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 3000).alias("text"), "lang", "source", "n_chars", F.lit("x").alias("score"), F.lit(1).alias("held_out"), F.lit(2).alias("y"), F.lit("s").alias("shard"), F.lit(b"").alias("f"))
    )
    for score in (L.quality, L.toxicity):
        a = {r.doc_id: r.score for r in score(docs, labels).collect()}
        b = [(r.doc_id, r.score) for r in score(docs.unionByName(docs.limit(5)), twice).collect()]
        assert len(b) == len(a) + 5
        if score is L.quality:
            assert all(abs(a[i] - s) < 1e-12 for i, s in b)
        assert len({i for i, _ in b}) == len(a) and all(len({s for j, s in b if j == i}) == 1 for i in [r.doc_id for r in docs.limit(5).collect()])
        assert score(more, labels).count() == len(a) + 1
    assert L.quality_scores(more, labels).columns == [c for c in more.columns if c != "score"] + ["score"]
    rows = L.toxicity(docs, labels, shard=300).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.97
    again = L.toxicity(docs.repartition(7), labels, shard=300).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in L.toxicity(docs, labels, shard=300).collect()}


def test_pipeline_edges(spark, tmp_path):
    """Each stage on no rows, on null and empty texts and other nulls, on repeated rows and with clashing columns."""
    sf = "/root/testdata/sf0.001"
    clash = "size int, score string, component_id string, _key string, _hash int, source_size int, item_id long, k1 long, salt int"
    extra = (1, "x", "c", "k", 2, 3, 4, 5, 6)
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (None, None, None, None, None), (None, "some words stand here and nowhere else", "en", "s", 4), (3, "these are the words of a plain text", None, None, None), (3, "these are the words of a plain text", None, None, None)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"{DOCS}, {clash}").repartition(2)
    want = Counter((r[0], r[1]) for r in rows)
    for name, stage in C.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == C.COLUMNS and empty.collect() == []
        kept = stage(spark, docs, sf)
        assert kept.columns == C.COLUMNS
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        if name == "n-gram Jaccard join":
            assert got == want - Counter([(3, rows[4][1])])
        elif name == "benchmark decontamination":
            assert got == want
        elif name == "mixing sources":
            assert set(got) == {(None, rows[3][1]), (3, rows[4][1])} and all(n <= 2 * want[k] for k, n in got.items())
        else:
            assert all(n == want[k] for k, n in got.items())
    assert C.pack(spark, docs.limit(0), sf).collect() == []
    assert sum(len(r.doc_ids) for r in C.pack(spark, docs, sf).collect()) == 6
    # against an empty benchmark all stays
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.drop_leaks(spark, docs, str(tmp_path)).count() == 6


def test_pipeline_against_plain_versions(spark):
    """run() on the smallest table: scores and what the mix takes by their operators, all else by loops over the texts."""
    import tiktoken

    from test_similarity import brute_components

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in L.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.3").collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    kept = [(i, t) for i, t in kept if i in {i for i, _, c, _ in brute_components(kept) if i == c}]
    found = {i for i, _, _ in plain_leaks(kept, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    left = docs.where(docs.doc_id.isin([i for i, _ in kept if i not in found]))
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mix_sources(left).collect() if r["size"]}
    want = Counter({r.text: 0 for r in left.collect()})
    for r in left.collect():
        want[r.text] += times.get(r.doc_id, 0)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, parts = Counter(), defaultdict(list)
    for r in C.run(spark, sf).collect():
        ids = np.frombuffer(r.ids, np.uint16)
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            parts[r.pack, doc].append((piece, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    for own in parts.values():  # a row that is taken twice has its pieces twice, all alike
        n = sum(p == 0 for p, _ in own)
        whole = {p: x for p, x in own}
        assert len(own) == n * len(whole)
        got[enc.decode([x for p in sorted(whole) for x in whole[p]])] += n
    assert got == +want and len(got) > 50


def test_packing_long_repeated_and_clashing(spark):
    """A text of several shares, one that fills rows exactly, rows with one doc_id or none, columns named like the result's."""
    import tiktoken

    rng = random.Random(5)
    texts = [(1, " ".join(rng.choice(["alpha", "beta,", "Γάμμα", "12"]) for _ in range(6000))), (2, "twice"), (2, "twice"), (None, "no id"), (None, None), (3, "a" * 64), (4, None)]
    docs = spark.createDataFrame([(i, t, "p", 1, b"x", 2) for i, t in texts], "doc_id long, text string, pack string, row int, ids binary, n_tokens int").coalesce(1)
    rows = P.pack_tokens(docs, row=64, tokens=300).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(enc.encode(t or "", disallowed_special=()))) for i, t in texts)
    got, ids = Counter(), defaultdict(dict)
    for r in rows:
        cu = r.cu_seqlens
        own = np.frombuffer(r.ids, np.uint16)
        for k, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            got[doc] += cu[k + 1] - cu[k]
            if doc == 1:
                ids[doc][piece] = own[cu[k] : cu[k + 1]].tolist()
    assert got == Counter({i: sum(n * c for (j, n), c in want.items() if j == i) for i, _ in texts})
    assert enc.decode([x for p in sorted(ids[1]) for x in ids[1][p]]) == texts[0][1]
    assert sum(r.doc_ids.count(2) for r in rows) == 2 and sum(r.doc_ids.count(None) for r in rows) == 2


def test_mix_with_clashing_columns_and_equal_rows(spark):
    rows = [(i % 40, "w " * (i % 7), "en", f"s{i % 3}", 1) for i in range(200)]
    plain = spark.createDataFrame(rows, DOCS)
    clash = spark.createDataFrame([(*r, "x", 5, 6.0, "t", 7) for r in rows], f"{DOCS}, h string, size int, target double, shard string, cells int").repartition(3)
    a, b = (sorted(map(tuple, mix_sources(x).collect())) for x in (plain, clash))
    assert a == b and len(a) == 200
    again = mix_sources(clash.withColumn("also", clash.text), also=("also",))
    assert again.columns[-1] == "also" and sorted(tuple(r)[:-1] for r in again.collect()) == a
