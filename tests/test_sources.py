import hashlib
import io
import random
import zipfile
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from quillforge.operators import extract as E
from quillforge.operators import providers as P
from quillforge.sources import files as S
from quillforge.sources import sinks
from quillforge.streaming import operators as T
from quillforge.streaming import stateful as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_walk(spark, tmp_path):
    tree = {"a.py": b"x = 1\n", "run": b"#!/usr/bin/env -S python3\n", "node_modules/x.js": b"1", "lib/node_modules": b"text", "b.PNG": b"x", "c.txt": b"a\0b", "empty.py": b"", "logs/x.log": b"l", "keep.log": b"l", ".hidden": b"z", "t.tsx": b"1", "big.py": b"x" * 2000}
    for p, data in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    files = S.read_tree(spark, str(tmp_path))
    got = dict(rows(S.walk(files, "*.log\n!keep.log\n# c\n", 1000).select("path", "language")))
    assert got == {"a.py": "python", "run": "python", "lib/node_modules": None, "keep.log": None, ".hidden": None, "t.tsx": "typescript"}


def test_gitignore_forms():
    ignored = S._matcher("/top\nbuild/\ndocs/*.md\n**/deep\n*.tmp\n")
    assert [ignored(p) for p in ("top", "a/top", "build/x", "a/build/x", "docs/a.md", "docs/x/a.md", "q/deep", "a/b.tmp", "a/b.txt")] == [True, False, True, True, True, False, True, True, False]


def test_gitignore_as_columns(spark):
    """The same by column expressions as by Python's patterns."""
    text = "*.log\n!keep.log\n/build\ndocs/\na/**/z\n[!x]y?\n# no\n\\#odd\nsrc/*.py\n"
    paths = ["a.log", "keep.log", "d/keep.log", "build", "build/x", "x/build", "docs/a", "docs", "x/docs/b/c", "a/z", "a/b/c/z", "ayb", "xyb", "d/zyq/f", "#odd", "src/a.py", "src/b/a.py", "a\n.log", "é.log"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.x for r in df.select("p", S.gitignored(text, F.col("p")).alias("x")).collect()}
    assert got == {p: S._matcher(text)(p) for p in paths} and {True, False} == set(got.values())


def test_unzip(spark):
    def archive(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "12345")
        return out.getvalue()

    df = spark.createDataFrame([("ok", archive(["a/b.py", "c"])), ("up", archive(["x", "../y"])), ("big", archive(["x", "y", "z"])), ("bad", b"no zip")], "archive string, content binary")
    got = rows(S.unzip(df, 5, 10).select("archive", "path", "verdict"))
    assert got == [("bad", None, "not a zip file"), ("big", None, "too large"), ("ok", "a/b.py", "ok"), ("ok", "c", "ok"), ("up", None, "outside")]


def test_archives_by_members(spark, tmp_path):
    """Ranges, filters before reading, a broken member, stored and packed ones, folders, guards, files that are no archives."""
    from quillforge.sources import archives as Z

    text = {f"d/{i}.txt": (f"{i} " * i).encode() for i in range(200)}
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("d/", b"")
        for i, (p, c) in enumerate(text.items()):
            z.writestr(p, c, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.writestr("odd.lzma", b"x", zipfile.ZIP_LZMA)
    data = bytearray((tmp_path / "good.zip").read_bytes())
    at = data.index(b"150 150")
    data[at : at + 3] = b"051"
    (tmp_path / "broken.zip").write_bytes(data)
    (tmp_path / "plain.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("../x", b"1")
    names = [str(tmp_path / f"{n}.zip") for n in ("good", "broken", "plain", "up", "gone")] + [None]
    archives = spark.createDataFrame([(n,) for n in names], "archive string")
    got = Z.zip_contents(Z.zip_directory(archives.where("archive LIKE '%good.zip' OR archive LIKE '%broken.zip'")), range_bytes=500).collect()
    good = {r.path: (bytes(r.content) if r.content is not None else None, r.error) for r in got if "good" in r.archive}
    assert good == {p: (c, None) for p, c in text.items()} | {"odd.lzma": (None, "method 14")}
    broken = {r.path: r.error for r in got if "broken" in r.archive}
    assert broken == dict.fromkeys(text) | {"d/150.txt": "wrong checksum", "odd.lzma": "method 14"}
    few = Z.unzip_members(archives, F.col("path").endswith("/7.txt") | F.col("path").endswith("/8.txt"))
    assert sorted((str(r.archive).rsplit("/", 1)[-1], r.verdict, r.path) for r in few.collect()) == sorted(
        [(f"{n}.zip", "ok", p) for n in ("good", "broken") for p in ("d/7.txt", "d/8.txt")] + [("plain.zip", "not a zip file", None), ("gone.zip", "not a zip file", None), ("None", "not a zip file", None), ("up.zip", "outside", None)], key=str)
    assert {r.verdict for r in Z.unzip_members(archives.where("archive LIKE '%good.zip'"), max_files=100).collect()} == {"too many files"}
    assert Z.unzip_members(archives.limit(0)).count() == 0


def test_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{\n "description": "d",\n "clips": [{"id": "1", "reference": "x", "other": 3}, {"id": "2"}]}')
    (tmp_path / "m" / "b.json").write_text("{")
    got = {(r.file.rsplit("/", 1)[-1], r.hash, r.id, r.reference, r.broken) for r in S.manifests(spark, str(tmp_path / "m")).collect()}
    digest = lambda n: hashlib.sha256((tmp_path / "m" / n).read_bytes()).hexdigest()[:12]
    assert got == {("a.json", digest("a.json"), "1", "x", False), ("a.json", digest("a.json"), "2", None, False), ("b.json", digest("b.json"), None, None, True)}


def test_python_units(spark):
    src = '"""Mod."""\nimport a.b as c\nfrom ..x import y as z\n\n@deco(1)\ndef f(a,\n      b=2):\n    """ Doc. """\n    def inner(): pass\n    return g.h(i())\n\nclass WorkerSettings:\n    async def m(self): return FastAPI()\n\nif "__main__" == __name__:\n    uvicorn.run(app)\n'
    facts = E.parse_python(src)
    assert [(u["unit_type"], u["name"], u["line_start"], u["line_end"], u["docstring"]) for u in facts["units"]] == [("module", "", 1, 17, "Mod."), ("function", "f", 5, 10, "Doc."), ("class", "WorkerSettings", 12, 13, None), ("function", "WorkerSettings.m", 13, 13, None)]
    assert [u["signature"] for u in facts["units"]][1:] == ["def f(a, b=2)", "class WorkerSettings", "async def m(self)"]
    assert facts["calls"] == ["deco", "g.h", "i", "FastAPI", "uvicorn.run"] and facts["main_guard"]
    assert [(i["raw"], i["names"], i["level"]) for i in facts["imports"]] == [("a.b", [], 0), ("..x", ["y"], 2)]
    odd = E.parse_python("class A:\n    @deco\n    def x(self): pass\n\ndef g(a: int, *b) -> dict[str, int]: return {}\n")
    assert [(u["name"], u["signature"], u["line_start"]) for u in odd["units"]][1:] == [("A", "class A", 1), ("A.x", "def x(self)", 2), ("g", "def g(a: int, *b) -> dict[str, int]", 5)]
    assert E.parse_python(" \n")["units"] == [] and len(E.parse_python("def (")["units"]) == 1
    files = spark.createDataFrame([("w.py", "python", src), ("manage.py", "python", "")], "path string, language string, text string")
    got = rows(E.entry_points(files, E.parse(files)).select("file", "kind"))
    assert got == [("manage.py", "cli"), ("w.py", "cli"), ("w.py", "http"), ("w.py", "http"), ("w.py", "worker")]


def test_javascript_units():
    src = '/** Doc\n * two */\nexport default function run(a) {\n  if (a) { return 1; }\n}\nexport class K extends B {\n  go(x) {\n    return x;\n  }\n}\nconst f = async (x) => {\n  return x;\n};\nconst v = 3;\n'
    got = [(u["unit_type"], u["name"], u["line_start"], u["line_end"]) for u in E.parse_javascript(src)["units"]]
    assert got == [("module", "", 1, 15), ("function", "run", 3, 5), ("class", "K", 6, 10), ("function", "K.go", 7, 9), ("function", "f", 11, 13)]


JS = r"""// head
import React, { useState } from "react";
import type { X } from './types';
import "./side.css";
import('lazy');
export { a } from "./reexported";

/** Adds.
 *  Two numbers.
 */
export function add(a, b = "}{") {
  const x = require("./inner");
  return a / b / 2; // } not code
}

const greet = async (name: string): Promise<{ a: number }> => {
  return `hi ${name + `${{a: "}"}.a}`} }`;
};
export const short = x => x + 1, other = (a, b) =>
  a
  + b;
const re = /[/}"]+\/"/g, plain = 5;
/** A class. */
// between
export default class Widget<T extends { a: 1 }> extends Base {
  static count = 0;
  field = () => { return 1; };
  constructor(a) { super(a); }
  /** Runs. */
  static async run(x: number): void { if (x) { require('two' ) } }
  get value() { return this.#p; }
  #p = 1
  *gen() { yield "}" }
  sig(a: string): void;
  [computed]() {}
}
function* gen() { }
interface I { f(): void; }
type T2 = { a: string };
function Comp({ a }: { a: string }): JSX.Element {
  return <div className="x" onClick={() => { go("}"); }}>Don't {a ? <b>it's {`x`}</b> : null} {'{'} <br/></div>;
}
let v = <any>foo;
export const generic = <T,>(x: T): T => x;
if (v) { function hidden() {} require(`tpl`); obj.require("no"); require("a", "b"); require("c", 1) }
function overload(a: string): string;
function overload(a: any): any { return a }
module.exports = { f: function () {} };
var old = function named(a) { return a }
"""


def test_javascript_grammar():
    """Braces and quotes in strings, templates, comments, patterns and elements; types; what is no unit and no import."""
    got = E.parse_javascript(JS)
    assert [(u["name"], u["line_start"], u["line_end"], u["signature"], u["docstring"]) for u in got["units"][1:]] == [
        ("add", 11, 14, 'export function add(a, b = "}{")', "Adds.\nTwo numbers."),
        ("greet", 16, 18, "const greet = async (name: string): Promise<{ a: number }> =>", None),
        ("short", 19, 19, "export const short = x =>", None),
        ("other", 19, 21, "export const short = x => x + 1, other = (a, b) =>", None),
        ("Widget", 25, 36, "export default class Widget<T extends { a: 1 }> extends Base", None),
        ("Widget.constructor", 28, 28, "constructor(a)", None),
        ("Widget.run", 30, 30, "static async run(x: number): void", "Runs."),
        ("Widget.value", 31, 31, "get value()", None),
        ("Widget.gen", 33, 33, "*gen()", None),
        ("Widget.[computed]", 35, 35, "[computed]()", None),
        ("Comp", 40, 42, "function Comp({ a }: { a: string }): JSX.Element", None),
        ("generic", 44, 44, "export const generic = <T,>(x: T): T =>", None),
        ("overload", 47, 47, "function overload(a: any): any", None),
        ("old", 49, 49, "var old = function named(a)", None),
    ]
    assert [(i["raw"], i["kind"]) for i in got["imports"]] == [("react", "js_bare"), ("./types", "js_relative"), ("./side.css", "js_relative"), ("./inner", "js_relative"), ("two", "js_bare"), ("c", "js_bare")]


@pytest.mark.parametrize("src", ["function f(){\n", "const a = <div>", "`${", "f(()=>{", "a<", "}", "class A { m() { return `}` } }\n", "/** x */ function f() { return /a}/ }\n", "'", "<a b={", "//", "/*"])
def test_javascript_of_any_form(src):
    """Broken and long sources end, in time that follows their length."""
    assert E.parse_javascript(src * 5000)["units"][0]["unit_type"] == "module"


def test_audio(spark):
    df = spark.createDataFrame([([0.0, 1.0, -2.0], 8000)], "s array<double>, r int")
    wav = df.select(S.wav_bytes("s", "r").alias("w")).first().w
    assert len(wav) == 50 and wav[:4] == b"RIFF" and wav[44:] == b"\x00\x00\xff\x7f\x01\x80"
    assert df.select(S.resample(F.col("s"), 2, 4).alias("x")).first().x == [0.0, 0.5, 1.0, -0.5, -1.0, -1.0]


def test_sinks(spark, tmp_path):
    kind = "snapshot int, v int"
    path = str(tmp_path / "t")
    sinks.overwrite_by_key(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], kind), path, "snapshot")
    for _ in range(2):
        sinks.overwrite_by_key(spark.createDataFrame([(1, 9)], kind), path, "snapshot")
    assert rows(spark.read.parquet(path).select("snapshot", "v")) == [(1, 9), (2, 3)]
    log = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("r", 1, None)], "k string, t int, v string")
    assert rows(sinks.latest_of_log(log, ["k"], [F.col("t")], "v")) == [("q", 3, "b", 2), ("r", 1, None, 1)]


def test_status_and_progress(spark):
    log = spark.createDataFrame([("a", 1, 1, "pending"), ("a", 2, 2, "ready"), ("a", 3, 3, "failed"), ("b", 1, 1, "pending"), ("b", 2, 2, "analyzing"), ("b", 3, 3, "failed")], "k string, t int, i int, status string")
    assert rows(T.final_status(log, "k", "t", "i")) == [("a", "ready", 0), ("b", "failed", 2)]
    assert rows(T.progress(log, log, "k", "t", "i").select("k", "status")) == [("a", "pending"), ("a", "ready"), ("b", "analyzing"), ("b", "failed"), ("b", "pending")]


def test_rate_limit_edges(spark):
    at = [pd.Timestamp(t).to_pydatetime() for t in ("2024-01-01 00:00:00", "2024-01-01 00:59:59", "2024-01-01 01:00:00")]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(at)], "u int, t timestamp, i int")
    assert [tuple(r) for r in T.within_limit(df, "u", "t", "i", 1).orderBy("i").select("n", "allowed").collect()] == [(1, True), (2, False), (1, True)]


def test_streams(spark, tmp_path):
    from quillforge.plans.texts import stream_status

    out = {r.user_id: r.status for r in stream_status(spark, "/root/testdata/sf0.001").collect()}
    assert set(out.values()) <= {"ready", "failed", "parsing", "pending"}
    states = ["pending", "parsing", "ready", "failed"]
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").collect():
        s, now = states[r.event_id % 4], want.get(r.user_id)
        if now != "ready" and not (now == "failed" and s != "ready"):
            want[r.user_id] = s
    assert out == want


def test_provider_failures_lose_only_their_row(spark):
    def opened():
        def rule(t):
            if t == "boom":
                raise ValueError(t)
            return '{"a": 1}' if t == "good" else "{}"

        return P.Canned(rule)

    df = spark.createDataFrame([(1, "good"), (2, "boom"), (3, "other")], "id int, t string")
    assert rows(P.require_parsed(P.per_row(df, "id", "t", opened, ""), "a INT", ["a"])) == [(1, 1)]
    assert P.whole(df, "t", ["id"], opened, "").first().answer == "{}"
    assert S.prompt_blocks("# p\n```\nsys\n```\nx\n```\nuser {a}\n```\n") == ("sys", "user {a}")


def test_published_messages_and_redelivered_batches(spark, tmp_path):
    kind = "k int, status string, error string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "ready", None), (2, "failed", "why")], kind).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(kind).parquet(source)
    T.publish(read(), str(tmp_path / "out"), str(tmp_path / "s1"), "k", "status", "error").trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.schema("k int, message string").json(str(tmp_path / "out")))
    assert got == [(1, '{"status":"ready"}'), (2, '{"status":"failed","error":"why"}')]


def test_each_row_of_a_stream_is_applied_once(spark, tmp_path):
    """Two batches over the same ten keys keep all rows; a lost state, repeated and null keys, a batch that comes again."""
    kind = "id long, k int, v string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda state: T.apply_once(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / state), ["id"]).trigger(availableNow=True).start().awaitTermination()
    want = []
    for n in range(3):
        part = [(50 * n + i, i % 10, f"v{n}") for i in range(50)] + ([(None, 1, "no id"), (3, 3, "v0")] if n != 1 else [])
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        want += [r for r in part if r[0] != 3 or n == 0]
        run("a")
        if n == 1:
            assert T.applied(spark, out, spark.createDataFrame([], kind).schema).count() == 101
    want = sorted(set(want), key=str)
    now = lambda: sorted((tuple(r)[:3] for r in T.applied(spark, out, spark.createDataFrame([], kind).schema).collect()), key=str)
    assert now() == want
    run("a")  # nothing new
    run("b")  # all again, without memory
    assert now() == want


def test_limits_are_decided_as_calls_come(spark, tmp_path):
    """Counted over batches by user and hour, a null user too, late calls on."""
    kind = "u string, at timestamp, id long"
    hour = lambda h, m: datetime(2024, 1, 1, h, m)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    settings = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(x) for x in settings]

    def put(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        with R.keyed_state(spark):
            made = R.limited(spark.readStream.schema(kind).parquet(source), "u", "at", "id", 2)
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {r.id: (r.n, r.allowed) for r in spark.read.parquet(out).collect()}

    got = put([("a", hour(1, 5), 2), ("a", hour(1, 1), 1), ("b", hour(1, 1), 3), (None, hour(1, 1), 4)])
    assert got == {1: (1, True), 2: (2, True), 3: (1, True), 4: (1, True)}
    got = put([("a", hour(1, 0), 5), ("a", hour(2, 0), 6), (None, hour(1, 2), 7)])
    assert got[5] == (3, False) and got[6] == (1, True) and got[7] == (2, True)
    got = put([("a", datetime(2024, 1, 5), 8)])  # the watermark passes: counts are dropped
    assert put([("a", hour(1, 30), 9), ("a", datetime(2024, 1, 5, 0, 1), 10)])[10] == (2, True) and 9 not in got
    # several hours of one user are over at once, the last one is not: only its count goes on
    got = put([("c", datetime(2024, 1, 6, h), 20 + h) for h in (1, 3, 5)] + [("c", datetime(2024, 1, 7, 5, 30), 30)])
    assert [got[x][0] for x in (21, 23, 25, 30)] == [1, 1, 1, 1]
    got = put([("c", datetime(2024, 1, 7, 5, 31), 31), ("c", datetime(2024, 1, 6, 5, 40), 32)])
    assert got[31] == (2, True) and got[32] == (2, True)
    assert [spark.conf.get(x) for x in settings] == before


def plain_subscriber(rows, poll=5):
    """(tie, status, via) of one key's rows (second, tie, status, via), second by second."""
    rows, out = sorted(rows, key=lambda r: (r[0], r[1], r[3] != "table")), []
    if not rows:
        return out
    row, timer, end = None, None, max(r[0] for r in rows) + 2 * poll
    for second in range(rows[0][0], end + 1):
        if timer is not None and second > timer:  # what comes in the same second comes first
            if row[1] in T.TERMINAL:
                return [*out, (*row, "poll")]
            timer += poll
        for _, tie, status, via in [r for r in rows if r[0] == second]:
            if row is not None and row[1] in T.TERMINAL and (via == "table" or tie != row[0]):
                continue
            if via == "table":
                if row is None:
                    out.append((tie, status, via))
                    timer = second + poll
                row = (tie, status)
            elif row is not None:
                out.append((tie, status, via))
                timer = second + poll
            if out and out[-1][1] in T.TERMINAL:
                return out
    return out


def test_subscribers_against_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    kind = "k string, at timestamp, tie long, status string, via string"
    parts, keys = [[], [], []], {}
    for k in range(25):
        t, rows = rng.randint(0, 9), []
        for tie in range(rng.randint(1, 8)):
            status = rng.choice([*T.STAGES, *T.TERMINAL]) if rng.random() < 0.5 else rng.choice(T.STAGES)
            rows.append((t, tie, status, "table"))
            if rng.random() < 0.6:
                rows.append((t, tie, status, "message"))
            if status in T.TERMINAL:
                break
            t += rng.choice([1, 3, 5, 7, 12])
        keys[f"k{k}"] = rows
        for r in rows:
            parts[min(r[0] // 12, 2)].append((f"k{k}", datetime(2024, 1, 1) + timedelta(seconds=r[0]), *r[1:]))
    parts.append([(None, datetime(2030, 1, 1), 0, "pending", "tick")])
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        with R.keyed_state(spark):
            made = R.subscribed(spark.readStream.schema(kind).parquet(source), "k", "1 second")
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("k string, tie long, status string, via string").parquet(out).collect())
    assert got == sorted((k, *r) for k, rows in keys.items() for r in plain_subscriber(rows))
    assert {r[3] for r in got} == {"table", "message", "poll"}


def test_prompt_versions(tmp_path):
    (tmp_path / "p.v2.md").write_text("```\na\n```\n```\nb {x}\n```\n")
    assert S.load_prompt(str(tmp_path), "p", "v2") == ("a", "b {x}")


def test_repositories(spark, tmp_path):
    """A pinned commit, the tip, an empty repository, one that is not there, a link, a file that is too large."""
    from quillforge.sources import repositories as V

    run = lambda *a: V._git("-c", "user.name=q", "-c", "user.email=q@localhost", *a, seconds=30, cwd=str(tmp_path / "a"))
    for name in ("a", "empty"):
        (tmp_path / name).mkdir()
        V._git("init", "--quiet", seconds=30, cwd=str(tmp_path / name))
    run("config", "uploadpack.allowReachableSHA1InWant", "true")
    (tmp_path / "a" / "app.py").write_bytes(b"x = 1\n")
    (tmp_path / "a" / "big").write_bytes(b"y" * 100)
    (tmp_path / "a" / "link").symlink_to("app.py")
    run("add", "--all")
    run("commit", "--quiet", "-m", "one")
    first = run("rev-parse", "HEAD").decode().strip()
    (tmp_path / "a" / "app.py").write_bytes(b"x = 2\n")
    run("commit", "--quiet", "-a", "-m", "two")
    second = run("rev-parse", "HEAD").decode().strip()
    url = f"file://{tmp_path}/a"
    rows = [(url, first), (url, None), (f"file://{tmp_path}/empty", None), (f"file://{tmp_path}/none", None), (url, "0" * 40), (None, None)]
    got = V.git_files(spark.createDataFrame(rows, "url string, commit string"), most_bytes=50).collect()
    assert sorted((r.commit, r.path, r.content and bytes(r.content), r.length) for r in got if r.path) == sorted([(first, "app.py", b"x = 1\n", 6), (first, "big", None, 100), (second, "app.py", b"x = 2\n", 6), (second, "big", None, 100)])
    assert sorted((str(r.url).rsplit("/", 1)[-1], bool(r.error)) for r in got if not r.path) == [("None", True), ("a", True), ("empty", False), ("none", True)]
    heads = {str(r.url).rsplit("/", 1)[-1]: (r.reachable, r["head"]) for r in V.remote_heads(spark.createDataFrame([(u,) for u in {r[0] for r in rows}], "url string")).collect()}
    assert heads == {"a": (True, second), "empty": (True, None), "none": (False, None), "None": (False, None)}


def test_a_hung_remote_is_killed(tmp_path):
    import subprocess
    import time

    from quillforge.sources import repositories as V

    slow = tmp_path / "git-remote-slow"
    slow.write_text("#!/bin/sh\nexec sleep 60\n")
    slow.chmod(0o755)
    began = time.monotonic()
    with pytest.raises((subprocess.TimeoutExpired, subprocess.CalledProcessError)):
        V._git("-c", "protocol.allow=always", "ls-remote", f"ext::{slow} x", seconds=1)
    assert time.monotonic() - began < 20


def test_snapshots_are_published_whole(spark, tmp_path):
    """A version whose second table fails leaves the old one readable, and is written again."""
    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="nothing"):
        sinks.published(spark, root, "x")
    sinks.publish({"x": one, "y": one}, root, 1)
    two = spark.createDataFrame([(2,)], "a int")
    with pytest.raises(Exception, match="stopped"):
        sinks.publish({"x": two, "y": one.select(F.raise_error(F.lit("stopped")).alias("a"))}, root, 2)
    assert rows(sinks.published(spark, root, "x")) == [(1,)]
    sinks.publish({"x": two, "y": two}, root, 2)
    assert rows(sinks.published(spark, root, "x")) == rows(sinks.published(spark, root, "y")) == [(2,)]
    sinks.publish({"x": one, "y": one}, root, 2)  # what is published stays
    assert rows(sinks.published(spark, root, "y")) == [(2,)] and rows(sinks.published(spark, root, "x", 1)) == [(1,)]
    with pytest.raises(ValueError, match="7"):
        sinks.published(spark, root, "x", 7)


def test_schema_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    put = lambda v, data, kind: spark.createDataFrame(data, kind).write.parquet(f"{root}/schema_version={v}")
    put(1, [(1, 5)], "id long, n int")
    put(2, [(2, 6, None), (3, 7, "x")], "id long, n long, s string")
    kind = spark.createDataFrame([], "id long, n long, s string, f double").schema
    assert rows(sinks.evolved(spark, root, kind, {"s": F.lit("-")}).na.fill("null", ["s"])) == [(1, 5, "-", None), (2, 6, "null", None), (3, 7, "x", None)]
    with pytest.raises(ValueError, match="lost"):
        sinks.evolved(spark, root, spark.createDataFrame([], "id long, n long").schema, {})
    with pytest.raises(ValueError, match="n is bigint, not int"):
        sinks.evolved(spark, root, spark.createDataFrame([], "id long, n int, s string").schema, {})


def test_calls_are_cached(spark, tmp_path):
    """Equal inputs are one call; a second run asks only what is new or has failed; another version or model asks anew."""
    calls = spark.sparkContext.accumulator(0)

    def opened():
        def rule(t):
            calls.add(1)
            if t == "boom":
                raise ValueError(t)
            return t.upper()

        return P.Canned(rule)

    cache = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "boom"), (4, "b"), (5, "")], "id int, t string")
    ask = lambda rows_, version="v1", model="m": P.cached(rows_, "id", "t", opened, "s", version, model, cache)
    want = [(1, "A"), (2, "A"), (3, "B"), (4, "B"), (4, None), (5, "")]
    got = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    assert got(ask(df)) == want and calls.value == 4
    assert got(ask(df)) == want and calls.value == 5  # the failed one
    assert got(ask(df.where("t <> 'boom'").unionByName(df.limit(0)))) == [r for r in want if r[1] is not None] and calls.value == 5
    ask(df, version="v2"), ask(df, model="n")
    assert calls.value == 13


def test_versioned_update(spark):
    have = spark.createDataFrame([("a", 1, "old"), ("b", 4, "old"), ("c", 2, "old")], "k string, version int, value string")
    writes = spark.createDataFrame([("a", 1, "second", 2), ("a", 1, "first", 1), ("a", 2, "early", 0), ("b", 3, "stale", 1), ("d", 1, "unknown", 1), ("c", None, "blind", 1)], "k string, version int, value string, at int")
    after, refused = sinks.versioned_update(have, writes, "k", ["at"])
    assert rows(after) == [("a", 2, "first"), ("b", 4, "old"), ("c", 2, "old")]
    assert sorted(r.value for r in refused.collect()) == ["blind", "early", "second", "stale", "unknown"]


def test_queue_and_polls(spark):
    stamp = lambda s: F.timestamp_seconds(F.lit(s) + F.col("at"))
    log = spark.createDataFrame([("done", "start", 0, 1), ("done", "done", 1800, 2), ("done", "start", 1900, 3), ("late", "start", 0, 1), ("late", "done", 1801, 2), ("late", "start", 1802, 3), ("now", "start", 3000, 1), ("odd", "done", 5, 1)], "job string, event string, at long, n int")
    got = T.job_outcomes(log.withColumn("at", stamp(0)), "job", "at", "n", "event", F.timestamp_seconds(F.lit(4000)))
    assert {r.job: (r.deliveries, r.outcome) for r in got.collect()} == {"done": (1, "done"), "late": (2, "timed out"), "now": (1, "running"), "odd": (0, "queued")}
    states = spark.createDataFrame([("a", "pending", 0), ("a", "ready", 4), ("b", "failed", 5), ("b", "ready", 6), ("c", "ready", 301), ("d", "parsing", 1), ("e", "ready", 300)], "k string, status string, at long")
    got = T.polled(states.withColumn("at", stamp(0)), "k", "at", F.timestamp_seconds(F.lit(0)))
    assert {r.k: (r.polls, r.seen) for r in got.collect()} == {"a": (3, "ready"), "b": (4, "failed"), "c": (151, None), "d": (151, None), "e": (151, "ready")}


def test_prompts_of_all_versions(spark):
    body = "# x\n```a\nsystem\n lines\n```\n\n```\nuser\n```\n```\nmore\n```\n"
    files = spark.createDataFrame([("p/one.v2.md", body), ("one.v10.md", body.replace("user", "you")), ("readme.md", "no blocks")], "path string, text string")
    assert rows(S.prompts(files)) == [("one", 2, "system\n lines", "user"), ("one", 10, "system\n lines", "you")]
    with pytest.raises(Exception, match="two fenced blocks"):
        S.prompts(spark.createDataFrame([("bad.v1.md", "none")], "path string, text string")).collect()


def test_shared_folder_is_refused_on_a_cluster(spark):
    from types import SimpleNamespace

    from quillforge import io as Q

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        Q.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context), "x")
    assert Q.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs://n/c/"), sparkContext=context), "x").startswith("hdfs://n/c/x-")
