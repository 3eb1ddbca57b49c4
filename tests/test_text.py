import pytest
from pyspark.sql import functions as F
from quillforge.functions import grading as G
from quillforge.functions import text as X


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(col.alias("x")).first().x


def lit(x):
    return F.array(*[F.lit(v) for v in x]).cast("array<string>") if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(
    ("markdown", "spoken"),
    [
        ("# Title\n\nSome *bold* **text** and ***both***.", "Title Some bold text and both."),
        ("```py\nx = 1\n```\nafter", "Code example omitted. after"),
        ("- one\n* two\n1. three\n> quote", "one two three quote"),
        ("see [the link](http://x) ![pic](y)", "see the link pic"),
        ("`run_layer_b` and run_layer_b and _soft_", "run_layer_b and run_layer_b and soft"),
        ("a <b>tag</b>\n\n---\n\nend", "a tag end"),
        ("", ""),
    ],
)
def test_speakable(spark, markdown, spoken):
    assert one(spark, X.speakable(lit(markdown))) == spoken


@pytest.mark.parametrize(("text", "most", "cut"), [("One. Two. Three", 10, "One. Two."), ("no sentence here", 11, "no"), ("unbroken", 4, "unbr"), ("short", 9, "short"), ("Ends. now", 5, "Ends.")])
def test_cut_at_sentence(spark, text, most, cut):
    assert one(spark, X.cut_at_sentence(lit(text), most)) == cut


def test_sentence_pieces(spark):
    long = "word " * 100 + "end."
    pieces = one(spark, X.sentence_pieces(lit("Hi there. " + long)))
    assert pieces[0] == "Hi there." and max(map(len, pieces)) <= 350 and " ".join(pieces[1:]) == long
    assert [len(p) for p in one(spark, X.sentence_pieces(lit("x" * 800)))] == [350, 350, 100]


def test_names_and_labels(spark):
    assert one(spark, X.fallback_label(lit("a/api2x_a_b.tar.py"))) == "Api2X A B.Tar"
    assert one(spark, X.fallback_name(lit("src/my-big_dir"))) == "My Big Dir" and one(spark, X.fallback_name(lit("(root)"))) == "Project root"
    assert one(spark, X.sanitize_label(lit('[]"{}'))) == "Unnamed"
    assert one(spark, X.file_stem(lit("  Psf/Requests — é!"))) == "psf-requests-é" and one(spark, X.file_stem(lit("!!"))) == "study-guide"
    assert one(spark, X.arrow_paths(lit("a.py -> b.py"))) == ["a.py", "b.py"]


def test_wer_and_recall(spark):
    def wer(a, b):
        folded = spark.createDataFrame([(a, b)], "a string, b string").select(X.fold_accents("a").alias("a"), X.fold_accents("b").alias("b"))
        return folded.select(X.word_error_rate(X.spoken_tokens(F.col("a")), X.spoken_tokens(F.col("b")))).first()[0]

    assert wer("analyze underscore source now", "analyze_source now") == 0
    assert wer("Café, time!", "cafe times") == 0.5
    assert wer("", "") == 0 and wer("", "x") == 1 and wer("a b c d", "") == 1
    assert one(spark, X.identifier_recall(lit(["a_b", "c"]), lit(["a_b"]))) == 0.5 and one(spark, X.identifier_recall(lit([]), lit(["x"]))) is None


def test_vocabulary_leaves_the_answer_out(spark):
    df = spark.createDataFrame([(1, "def create_snapshot(x): parseFile main.py self build_graph build_graph", "app/quizzing/mastery.py", " Quiz Engine ", ["snapshot"])], "id int, s string, p string, n string, o array<string>")
    got = [(r.term, r.weight) for r in X.vocabulary(df, "id", "s", "p", "n", "o").orderBy("rank").collect()]
    assert got == [("build_graph", 2), ("mastery.py", 2), ("quizzing", 2), ("Quiz Engine", 2), ("parseFile", 1), ("main.py", 1)]
    assert [r.term for r in X.vocabulary(df, "id", "s", "p", "n", "o", 6, 24).orderBy("rank").collect()] == ["build_graph", "mastery.py"]


def test_snippets(spark):
    text = "\n".join(f"l{i}" for i in range(1, 301))
    assert one(spark, X.snippet(lit(text), F.lit(2), F.lit(3))) == "l2\nl3"
    assert one(spark, X.snippet(lit(text), F.lit(1), F.lit(300))).endswith("l200\n… (truncated)")
    assert one(spark, X.last_visible_line(lit("a\nb\nc"), F.lit(5))) == 7


def test_grading(spark):
    assert one(spark, G.fill_blank(lit("  The ANSWER "), lit("the answer"), lit([]), lit("code"), F.lit(None).cast("double"))) == 1
    assert one(spark, G.fill_blank(lit("x"), lit(None), lit(["y"]), lit("concept"), F.lit(0.5))) == 0.5
    assert one(spark, G.fill_blank(lit("x"), lit("z"), lit(["y"]), lit("concept"), F.lit(0.7))) is None
    assert one(spark, G.rubric(F.array(F.lit(True), F.lit(False)), lit(["a", "b"]))) == 0.5
    with pytest.raises(Exception, match="differ in length"):
        one(spark, G.rubric(F.array(F.lit(True)), lit(["a", "b"])))
    assert not one(spark, G.valid_mcq(lit(["a"]), F.lit(0))) and one(spark, G.valid_mcq(lit(["a", "b"]), F.lit(1)))
    assert not one(spark, G.valid_short(lit("p"), lit("a"), lit(["x", " "]))) and one(spark, G.valid_blank(lit("code"), lit("a ___"), lit("b")))
    assert one(spark, G.choice_text(lit("mcq"), lit(["a"]), F.lit(4), lit("t"))) is None


def test_wer_against_plain_distance(spark):
    import random

    def plain(r, h):
        row = list(range(len(h) + 1))
        for i, a in enumerate(r, 1):
            row, before = [i], row
            for j, b in enumerate(h, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        return row[-1] / len(r) if r else float(bool(h))

    rng = random.Random(12)
    pairs = [([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]) for _ in range(200)]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r array<string>, h array<string>")
    got = df.select("i", X.word_error_rate(F.col("r"), F.col("h")).alias("w")).orderBy("i").collect()
    assert [round(g.w, 9) for g in got] == [round(plain(r, h), 9) for r, h in pairs]


def test_wer_of_many_distinct_tokens(spark):
    """Pairs with more than 256 distinct tokens."""
    r = [f"w{i}" for i in range(300)]
    pairs = [(r, [*r[:256], "w0", *r[257:]]), (r[:1], r[256:257]), (r, [f"v{i}" for i in range(300)]), (r, r[::-1][:1] + r[1:])]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    got = [x.w for x in df.select(X.word_error_rate(F.col("r"), F.col("h")).alias("w")).collect()]
    assert got == [1 / 300, 1.0, 1.0, 1 / 300]


def test_wer_and_recall_of_whole_turns(spark, tmp_path):
    """Turns of more than 200 characters with accents, against the plain rule."""
    import random
    import re
    import unicodedata

    from quillforge.plans import catalog

    def tokens(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return [x for x in (w.strip("./-") for w in re.sub(r"[^\w\s./\-]", " ", t).split()) if x]

    def distance(r, h):
        row = list(range(len(h) + 1))
        for i, a in enumerate(r, 1):
            row, before = [i], row
            for j, b in enumerate(h, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        return row[-1]

    rng = random.Random(8)
    words = [f"mot{i}" for i in range(500)] + ["Été,", "naïve", "a_b.py", "où?"] * 20
    base = [rng.choice(words) for _ in range(400)]
    turns = [" ".join(base), " ".join(rng.choice(words) if rng.random() < 0.3 else w for w in base), "Café " * 60 + "fin", "cafe " * 60, ""]
    rows = [(1, 2 * i, ("user", "assistant")[i % 2], t) for i, t in enumerate(turns)] + [(1, 1, "system", "left out")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = [(tokens(r), tokens(h)) for r, h in zip(turns, turns[1:], strict=False)]
    got = catalog.queries()["wer"](spark, str(tmp_path)).orderBy("turn").collect()
    assert [round(x.wer, 9) for x in got] == [round(distance(r, h) / len(r), 9) for r, h in pairs]
    long = [([t for t in r if len(t) > 3], set(h)) for r, h in pairs]
    got = catalog.queries()["identifier_recall"](spark, str(tmp_path)).orderBy("turn").collect()
    assert [round(x.recall, 9) for x in got] == [round(sum(t in h for t in r) / len(r), 9) for r, h in long]


def test_paths_against_a_plain_stack(spark):
    import random

    from quillforge.operators.graph import external_name, normal_path

    rng = random.Random(3)
    paths = ["/".join(rng.choice(["a", "b", ".", "..", "c.py"]) for _ in range(rng.randint(1, 8))) for _ in range(200)]

    def plain(p):
        out = []
        for x in p.split("/"):
            if x == "..":
                out = out[:-1]
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out) or "."

    df = spark.createDataFrame(list(enumerate(paths)), "i int, p string")
    assert [r.n for r in df.select("i", normal_path(F.col("p")).alias("n")).orderBy("i").collect()] == [plain(p) for p in paths]
    names = spark.createDataFrame([("@s/p/q",), ("@s",), ("lodash/fp",), ("react",)], "p string")
    assert [r[0] for r in names.select(external_name(F.col("p"))).collect()] == ["@s/p", "@s", "lodash", "react"]


@pytest.mark.parametrize("text", ["STRASSE", "straße", "ﬁn", "ΣΊΣΥΦΟΣ", "σίσυφος", "İstanbul", "ısı", "ÀÉ ñ", "ŉ", "ſ", ""])
def test_folded_as_casefold(spark, text):
    assert one(spark, X.folded(lit(text))) == text.casefold()


def test_day_labels(spark):
    from quillforge.streaming import operators as T

    label = lambda at: one(spark, T.day_label(F.lit(at).cast("timestamp_ntz"), F.lit("2024-03-05 10:00:00").cast("timestamp_ntz")))
    assert [label(x) for x in ("2024-03-05 00:00:00", "2024-03-05 09:05:30", "2024-03-06 14:20:00", "2024-03-04 23:59:59", "2024-03-03 09:05:00")] == ["Today, 00:00", "Today, 09:05", "Today, 14:20", "Yesterday, 23:59", "3 Mar, 09:05"]


def test_labels_of_any_length(spark):
    long = "a" * 1_500_000
    df = spark.createDataFrame([(f"dir/{long}.py", f"x/{long}", f"1 {'b' * 1_500_000}C_d")], "p string, k string, t string")
    got = df.select(X.fallback_label(F.col("p")), X.fallback_name(F.col("k")), F.size(X.technical_terms(F.col("t")))).first()
    assert got[0] == got[1] == "A" + long[1:] and got[2] == 1
