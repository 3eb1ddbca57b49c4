"""The jobs, run more than once over input that grows."""

import hashlib
import json
import os
import re

import duckdb
import pytest
from jobs import common, passages, transcripts
from jobs import queries as J
from quillforge.functions import text as X

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, hash string, batch int"


def put(spark, folder, rows):
    """One more file of documents."""
    spark.createDataFrame([(*r, "clash", 7) for r in rows], KIND).coalesce(1).write.mode("append").parquet(folder)


def plain_index(docs, lines):
    out = set()
    for doc_id, text, lang, source in docs:
        cut = (text or "").split("\n") if text is not None else []
        for n in range(0, len(cut), lines):
            part = cut[n : n + lines]
            body = "\n".join(part)
            if re.search(r"[^ \t\r\n]", body):
                out.add((doc_id, source, lang, n // lines, n + 1, n + len(part), hashlib.sha256(body.encode()).hexdigest(), len(body)))
    return out


def indexed(spark, out):
    rows = passages.index(spark, out).drop("terms").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture
def growing(spark, tmp_path):
    shared = "\n".join(f"shared line {i} of snake_case" for i in range(4))
    first = [(1, f"{shared}\nown line", "en", "a"), (2, shared, "de", None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t\n", "en", "b"), (5, "twice", "en", "b"), (5, "twice", "en", "b"), (None, "no id", "fr", "c")]
    second = [(2, f"other first line\n{shared}", "de", None), (6, f"{shared}\n" + "x" * 200_000, "en", "a"), (7, "é\nü" * 5000, "fr", "c")]
    return str(tmp_path / "documents"), first, second, str(tmp_path / "index"), str(tmp_path / "state")


def test_two_runs_over_a_growing_folder(spark, growing, monkeypatch):
    docs, first, second, out, state = growing
    settings = passages.DEFAULTS | {"lines": 4}
    put(spark, docs, first)
    assert passages.run(spark, docs, out, state, settings) == {"batches": 1}
    assert indexed(spark, out) == plain_index(first, 4)
    before = passages.read_passages(spark, out).count()

    assert passages.run(spark, docs, out, state, settings) == {"batches": 0}  # nothing new
    assert indexed(spark, out) == plain_index(first, 4)

    put(spark, docs, second)
    assert passages.run(spark, docs, out, state, settings) == {"batches": 1}
    now = [r for r in first if r[0] != 2] + second
    assert indexed(spark, out) == plain_index(now, 4)
    stored = [r["hash"] for r in passages.read_passages(spark, out).collect()]
    assert len(stored) == len(set(stored)) and len(stored) > before  # what was there is not stored again
    again = passages.read_passages(spark, out).where("batch = 1").collect()
    assert not {r["hash"] for r in again} & {r[6] for r in plain_index(first, 4)}


def test_a_batch_that_comes_again_changes_nothing(spark, growing):
    docs, first, second, out, state = growing
    settings = passages.DEFAULTS | {"lines": 4}
    put(spark, docs, first)
    passages.run(spark, docs, out, state, settings)
    put(spark, docs, second)
    passages.run(spark, docs, out, state, settings)
    want, texts = indexed(spark, out), sorted(passages.read_passages(spark, out).collect())
    batch = spark.createDataFrame([(*r, "clash", 7) for r in second], KIND).select("doc_id", "text", "lang", "source")
    for _ in range(2):
        passages.apply_batch(batch, 1, out, 4)
        assert indexed(spark, out) == want
        assert sorted(passages.read_passages(spark, out).collect()) == texts


def test_files_in_batches_give_the_same_passages(spark, growing, tmp_path):
    docs, first, second, out, state = growing
    put(spark, docs, first)
    put(spark, docs, [r for r in second if r[0] != 2])
    one = passages.DEFAULTS | {"lines": 4}
    assert passages.run(spark, docs, out, state, one | {"files_per_batch": 1}) == {"batches": 2}
    passages.run(spark, docs, f"{tmp_path}/other", f"{tmp_path}/other_state", one)
    assert indexed(spark, out) == indexed(spark, f"{tmp_path}/other")
    kept = lambda o: sorted((r["hash"], r["text"]) for r in passages.read_passages(spark, o).collect())
    assert kept(out) == kept(f"{tmp_path}/other")


def test_an_output_needs_its_checkpoint(spark, growing, tmp_path):
    docs, first, _, out, state = growing
    put(spark, docs, first)
    passages.run(spark, docs, out, state)
    with pytest.raises(ValueError, match="checkpoint"):
        passages.run(spark, docs, out, f"{tmp_path}/new_state")
    with pytest.raises(ValueError, match="line or more"):
        passages.run(spark, docs, out, state, passages.DEFAULTS | {"lines": 0})


def test_empty_documents(spark, tmp_path):
    put(spark, f"{tmp_path}/d", [])
    passages.run(spark, f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/s")
    put(spark, f"{tmp_path}/d", [(1, "some text", "en", "a")])
    passages.run(spark, f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/s")
    assert len(indexed(spark, f"{tmp_path}/o")) == 1


def test_terms_are_identifiers(spark):
    row = passages.cut(spark.createDataFrame([(1, "call run_layer and os.path in main.py, not words", "en", "a")], "doc_id long, text string, lang string, source string"), 20)
    assert sorted(row.select(X.technical_terms(row.text).alias("t")).first()["t"]) == ["main.py", "run_layer"]


# -- transcripts ----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, wer double, backend string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "call run underscore layer now"), (1, 2, "assistant", "call run_layer now"), (1, 3, "user", "call run layer"), (1, 4, "assistant", None),
    (2, 1, "user", "Été"), (2, 2, "assistant", "ete"), (2, 4, "user", "after a gap"), (None, 1, "user", "x"), (3, 1, "user", ""), (3, 2, "assistant", ""), (3, 3, "user", "more words here"),
]


def turns(spark, folder, rows):
    spark.createDataFrame([(*r, 0.5, "clash") for r in rows], TURNS).write.mode("append").parquet(folder)


def test_transcripts_repeat_and_carry_on_by_backend(spark, tmp_path):
    source, out = f"{tmp_path}/c", f"{tmp_path}/o"
    turns(spark, source, ROWS)
    transcripts.run(spark, source, out, transcripts.DEFAULTS | {"backends": ["hosted"]})
    assert {r["backend"] for r in transcripts.read_scores(spark, out).collect()} == {"hosted"}
    transcripts.run(spark, source, out, transcripts.DEFAULTS | {"backends": ["local"]})
    want = sorted(map(repr, transcripts.whole_output(spark, out).collect()))
    got = {(r["conv_id"], r["turn"]): (r["wer"], r["recall"]) for r in transcripts.read_scores(spark, out).collect()}
    assert got == {(1, 1): (0.0, 1.0), (1, 2): (0.666667, 0.5), (1, 3): (1.0, 0.0), (2, 1): (0.0, None), (3, 1): (0.0, None), (3, 2): (1.0, None)}
    for _ in range(2):  # all at once, and again
        assert transcripts.run(spark, source, out)["scores"] == len(got)
        assert sorted(map(repr, transcripts.whole_output(spark, out).collect())) == want
    fresh = f"{tmp_path}/fresh"
    transcripts.run(spark, source, fresh)
    assert sorted(map(repr, transcripts.whole_output(spark, fresh).collect())) == want
    table = spark.read.text(f"{out}/table", wholetext=True).first()[0]
    assert table.startswith("| backend | category |") and "| local | all |" in table


def test_transcripts_of_an_empty_table(spark, tmp_path):
    turns(spark, f"{tmp_path}/c", [])
    assert transcripts.run(spark, f"{tmp_path}/c", f"{tmp_path}/o") == {"turns": 0, "scores": 0, "report": 0}


def test_settings(spark, tmp_path):
    path = f"{tmp_path}/s.json"
    with open(path, "w") as f:
        json.dump({"lines": 3}, f)
    assert common.settings(spark, path, passages.DEFAULTS) == {"lines": 3, "files_per_batch": 0}
    assert common.settings(spark, None, passages.DEFAULTS) == passages.DEFAULTS
    with open(path, "w") as f:
        json.dump({"line": 3}, f)
    with pytest.raises(ValueError, match="unknown"):
        common.settings(spark, path, passages.DEFAULTS)
    root = os.path.dirname(passages.__file__)
    for name, own in (("passages", passages.DEFAULTS), ("transcripts", transcripts.DEFAULTS)):
        assert common.settings(spark, f"{root}/{name}.json", own) == own


@pytest.mark.parametrize("name", ["job1_passages", "job2_transcripts"])
def test_job_queries(spark, name):
    df = J.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(J.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    value = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    rows = lambda data: sorted(repr([value(x) for x in r]) for r in data)
    assert rows(df.select(*names).collect()) == rows(found.fetchall())
