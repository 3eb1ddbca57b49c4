import random

from pyspark.sql import functions as F
from quillforge.io import assert_unique, global_position
from quillforge.operators import aggregates as A
from quillforge.operators import ranking as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_skips_null_times_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, "q", None), (2, "q", 5), (3, "q", 5), (4, "r", None), (5, "s", 1)], "id int, quiz string, at int")
    assert rows(R.latest_per_group(df, ["quiz"], "at", "id").select("id")) == [(2,), (5,)]


def test_mastery_cases(spark):
    attempts = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 11, 3), (4, 12, 4)], "attempt_id int, quiz_id int, completed_at int")
    answers = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "a", 1.0), (2, "", 0.0), (3, None, 0.5), (3, "b", 0.5), (3, "b", None)], "attempt_id int, key string, score double")
    names = spark.createDataFrame([("a", "Alpha")], "key string, name string")
    got = [tuple(r) for r in A.mastery(attempts, answers, names).orderBy("ordinal").collect()]
    assert got == [("b", "b", 1, 1, 0.5, 1), ("a", "Alpha", 1, 2, 0.75, 2), ("__ungrouped__", "__ungrouped__", 2, 2, 0.25, 3)]
    trend = rows(A.mastery_trend(A.mastery_history(attempts, answers)).select("key", "points", "delta"))
    assert trend == [("__ungrouped__", 2, 50), ("a", 1, None), ("b", 1, None)]


def test_scores_count_unanswered(spark):
    attempts = spark.createDataFrame([(1,), (2,)], "attempt_id int")
    questions = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "attempt_id int, question_id int")
    answers = spark.createDataFrame([(1, 1, 1.0), (1, 2, None)], "attempt_id int, question_id int, score double")
    assert rows(A.attempt_scores(attempts, questions, answers)) == [(1, 3, 1, 1 / 3), (2, 0, 0, 0.0)]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("none", None)] + [("one", 7)] + [("two", x) for x in (1, 9)] + [("four", x) for x in (1, 2, 3, 4)] + [("six", x) for x in range(6)], "k string, v int")
    got = {r.k: (r.p50, r.p95) for r in A.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"none": (None, None), "one": (7, 7), "two": (1, 9), "four": (3, 4), "six": (2, 5)}


def plain_seeds(items):
    """Ranges, claims and rounds with plain dictionaries."""
    by_range = {}
    for i in items:
        key = (i["f"], i["a"], i["z"])
        best = by_range.get(key)
        if best is None:
            by_range[key] = dict(i, seen=i["ord"])
        elif i["prio"] < best["prio"]:
            by_range[key] = dict(i, seen=best["seen"])
    by_claim = {}
    for i in sorted(by_range.values(), key=lambda x: x["seen"]):
        best = by_claim.get(i["claim"])
        if best is None or (i["prio"], i["f"], i["a"]) < (best["prio"], best["f"], best["a"]):
            by_claim[i["claim"]] = i
    out = []
    for tier in sorted({i["prio"] for i in by_claim.values()}):
        buckets = {}
        for i in sorted((x for x in by_claim.values() if x["prio"] == tier), key=lambda x: (x["f"], x["a"], x["ord"])):
            buckets.setdefault(i["bucket"] or "", []).append(i["ord"])
        while any(buckets.values()):
            out += [buckets[b].pop(0) for b in sorted(buckets) if buckets[b]]
    return out


def test_seed_chain_against_plain_version(spark):
    rng = random.Random(4)
    for _ in range(3):
        items = [{"ord": i, "f": rng.choice("abc"), "a": rng.randint(1, 4), "z": rng.randint(4, 5), "prio": rng.randint(0, 3), "claim": rng.choice("uvwxyz"), "bucket": rng.choice(["p", "q", None])} for i in range(60)]
        df = spark.createDataFrame([tuple(i.values()) for i in items], "ord int, f string, a int, z int, prio int, claim string, bucket string")
        from pyspark.sql import Window

        df = df.withColumn("seen", F.min("ord").over(Window.partitionBy("f", "a", "z")))
        df = R.first_per_group(df, ["f", "a", "z"], ["prio", "ord"])
        df = R.first_per_group(df, ["claim"], ["prio", "f", "a", "seen"])
        got = R.round_robin(df, F.col("prio"), F.col("bucket"), ["f", "a", "ord"]).orderBy("position").select("ord").collect()
        assert [r.ord for r in got] == plain_seeds(items)
        first = R.round_robin(df, F.col("prio"), F.col("bucket"), ["f", "a", "ord"], most=5).orderBy("position").collect()
        assert [(r.ord, r.position) for r in first] == [(x, i + 1) for i, x in enumerate(plain_seeds(items)[:5])]


def plain_chunks(files, size, most):
    out = []
    for f in sorted(files):
        n = files[f]
        parts = [min(size, n - i) for i in range(0, n, size)] or [0]
        out += [(f, k + 1, p) for k, p in enumerate(parts)]
    out = out[:most]
    return sorted((f, i, n, sum(1 for g in out if g[0] == f)) for f, i, n in out)


def test_chunks_with_cap_against_plain_version(spark):
    files = {"a": 0, "b": 60, "c": 61, "d": 7, "e": 130}
    units = [(f, i, True) for f, n in files.items() for i in range(n)] + [(f, -1, False) for f in files]
    df = spark.createDataFrame(units, "file string, line int, is_unit boolean")
    chunks = R.chunk(df, "file", ["line"], 60)
    for most in (3, 5, 99):
        assert rows(R.capped_chunks(chunks, "file", most)) == plain_chunks(files, 60, most)


def test_cutoffs_pages_and_positions(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([3, 4, 5, 1])], "k string, i int, c int")
    assert rows(R.take_while_total(df, ["k"], ["i"], F.col("c"), 8).select("i")) == [(0,), (1,)]
    assert rows(R.page(df, [F.desc("i")], 2).select("i", "total")) == [(2, 4), (3, 4)]
    many = spark.range(1000).repartition(7).withColumn("v", (F.col("id") * 37) % 1000)
    assert [r.v for r in global_position(many, ["v"]).orderBy("position").collect()] == list(range(1000))
    assert rows(global_position(many, ["v"]).select((F.col("position") - F.col("v")).alias("d")).distinct()) == [(1,)]
    assert rows(assert_unique(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])) == [(1, 2)]


def test_archive_guard(spark):
    e = [("many", i, "f", 1) for i in range(4)] + [("big", 0, "f", 90), ("big", 1, "g", 20), ("up", 0, "a/../../x", 1), ("abs", 0, "/x", 1), ("ok", 0, "a/../b", 100)]
    df = spark.createDataFrame(e, "a string, i int, p string, n long")
    got = {r.a: r.verdict for r in R.guard_archive(df, ["a"], "n", "p", 3, 100).collect()}
    assert got == {"many": "too many files", "big": "too large", "up": "outside", "abs": "outside", "ok": "ok"}


def test_asof_against_plain_version(spark):
    """Ties of time, times on the edge of a bucket, keys of one side only, gaps of many buckets."""
    import datetime as dt
    import random

    from quillforge.operators import joins as J

    rng = random.Random(7)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 12, 24, 24, 36, 240, rng.randrange(500)]))
    left = [(rng.choice(["a", "b", "l"]), at(), i) for i in range(120)]
    right = [(rng.choice(["a", "b", "r"]), at(), i, f"v{i}" if i % 9 else None) for i in range(60)]
    got = J.asof(spark.createDataFrame(left, "k string, at timestamp_ntz, id int"), spark.createDataFrame(right, "k string, at timestamp_ntz, n int, v string"), "k", "at", "n", "v").collect()
    want = {}
    for k, t, i in left:
        seen = max(((u, n, v) for x, u, n, v in right if x == k and u <= t), key=lambda x: x[:2], default=(0, 0, None))
        want[i] = seen[2]
    assert {r.id: r.v for r in got} == want and len(got) == 120
