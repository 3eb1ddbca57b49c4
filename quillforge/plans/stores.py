"""Queries through sources and sinks: archives, trees, repositories, prompts, repeated and concurrent writes, queues and polls."""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..io import importable, shared_folder, table, written
from ..operators import extract as E
from ..operators import providers as P
from ..sources import archives as Z
from ..sources import files as S
from ..sources import repositories as V
from ..sources import sinks
from ..streaming import operators as T
from ..streaming import stateful as R
from .catalog import register

# -- archives and trees: nations are the files, regions the archives (25 rows at any size)


@register("zip_members", """SELECT r_name AS archive, CASE WHEN r_regionkey < 3 THEN 'ok' WHEN r_regionkey = 3 THEN 'outside' ELSE 'not a zip file' END AS verdict, CASE WHEN r_regionkey < 3 THEN 'src/' || n_name || '.txt' END AS path, CASE WHEN r_regionkey < 3 THEN n_name || ' of ' || r_name END AS text
FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3 UNION SELECT r_name, CASE WHEN r_regionkey = 3 THEN 'outside' ELSE 'not a zip file' END, NULL, NULL FROM region WHERE r_regionkey >= 3""")
def zip_members(spark, d):
    """SRC-02, SRC-03: one archive a region; one has a member outside, one is no archive."""
    importable(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        key, name, data = rows["r_regionkey"].iloc[0], rows["r_name"].iloc[0], io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for n in rows["n_name"]:
                z.writestr(f"src/{n}.txt", f"{n} of {name}")
            if key == 3:
                z.writestr("../up.txt", "x")
        return pd.DataFrame({"archive": [name], "content": [data.getvalue() if key < 4 else b"no archive"]})

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    archives = rows.select("r_regionkey", "r_name", "n_name").groupBy("r_regionkey").applyInPandas(pack, "archive string, content binary")
    return S.unzip(archives).select("archive", "verdict", "path", F.decode("content", "UTF-8").alias("text"))


def _written(spark, name: str, files: dict[str, bytes]) -> str:
    """A few files below a new shared folder."""
    root = shared_folder(spark, name)
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    for path, content in files.items():
        system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{base}/{path}") as f:
            f.write(content)
    return root


@register("tree_files", """WITH f AS (SELECT ['src/', 'node_modules/a/', 'logs/', ''][n_nationkey % 4 + 1] || 'f' || n_nationkey || ['.py', '.ts', '.png', '.log', '.md'][n_nationkey % 5 + 1] AS path, n_name AS text FROM nation)
SELECT path, text, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' END AS language, CAST(strlen(text) AS BIGINT) AS length FROM f WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE 'logs/%' AND path NOT LIKE '%.png' AND (path NOT LIKE '%.log' OR path LIKE '%f3.log') UNION ALL SELECT '.gitignore', 'logs/' || chr(10) || '*.log' || chr(10) || '!f3.log' || chr(10), NULL, 20""")
def tree_files(spark, d):
    """SRC-04..09: a tree with ignored folders, a binary file by its name and a .gitignore."""
    rules = "logs/\n*.log\n!f3.log\n"
    nations = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    files = {["src/", "node_modules/a/", "logs/", ""][k % 4] + f"f{k}" + [".py", ".ts", ".png", ".log", ".md"][k % 5]: n.encode() for k, n in nations}
    root = _written(spark, "tree", {**files, ".gitignore": rules.encode()})
    return S.walk(S.read_tree(spark, root), rules).select("path", F.decode("content", "UTF-8").alias("text"), "language", "length")


@register("git_source", "SELECT 'nations/n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.md' AS path, '# ' || n_name || chr(10) AS text, true AS pinned, true AS at_head FROM nation UNION ALL SELECT NULL, NULL, true, false")
def git_source(spark, d):
    """SRC-01, SRC-10, SRC-11: a repository that a session makes; its first commit is fetched by its name after a second one is its head. One remote is not there."""
    root = _written(spark, "repository", {f"nations/n{k:02d}.md": f"# {n}\n".encode() for k, n in table(spark, d, "nation").select("n_nationkey", "n_name").collect()})  # 25 rows
    folder = fs.FileSystem.from_uri(root)[1]
    run = lambda *a: V._git(*a, seconds=60, cwd=folder)
    who = ("-c", "user.name=q", "-c", "user.email=q@localhost")
    run("init", "--quiet")
    run("config", "uploadpack.allowReachableSHA1InWant", "true")
    run("add", "--all")
    run(*who, "commit", "--quiet", "-m", "one")
    first = run("rev-parse", "HEAD").decode().strip()
    run("rm", "--quiet", "-r", "nations")
    run(*who, "commit", "--quiet", "--allow-empty", "-m", "two")
    second = run("rev-parse", "HEAD").decode().strip()
    remotes = spark.createDataFrame([(root, first), (f"{root}-not-there", first)], "url string, commit string")
    heads = V.remote_heads(remotes)
    files = V.git_files(remotes).join(heads, "url")
    return files.select("path", F.decode("content", "UTF-8").alias("text"), (F.col("commit") == first).alias("pinned"), (F.col("reachable") & (F.col("head") == second) & F.col("error").isNull()).alias("at_head"))


@register("archive_members", """SELECT 'a' || doc_id // 64 AS archive, 'ok' AS verdict, 'src/d' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS hash FROM documents WHERE strlen(text) > 100
UNION ALL SELECT 'none', 'not a zip file', NULL, NULL, NULL UNION ALL SELECT DISTINCT 'x' || doc_id // 640, 'outside', NULL, NULL, NULL FROM documents""")
def archive_members(spark, d):
    """SRC-02, SRC-03: the texts in archives of some 64; those of more than 100 bytes are read back by their ranges. Every tenth archive has a twin with a member outside; one address holds nothing."""
    docs, folder = table(spark, d, "documents").where("text IS NOT NULL"), shared_folder(spark, "archives")
    file = docs.select(F.concat(F.lit("a"), F.expr("doc_id div 64")).alias("name"), F.concat(F.lit("src/d"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    odd = docs.select(F.concat(F.lit("x"), F.expr("doc_id div 640")).alias("name"), F.concat(F.lit("../up"), "doc_id").alias("path"), F.encode("lang", "UTF-8").alias("content")).where("content IS NOT NULL")
    index = written(Z.pack_zip(file.unionByName(odd), folder), "archive-index").select("archive")
    missing = spark.range(1).select(F.lit(f"{folder}/none.zip").alias("archive"))
    got = Z.unzip_members(index.unionByName(missing), F.col("length") > 100)
    return got.select(F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "verdict", "path", "length", F.sha2("content", 256).alias("hash"))


@register("manifest_items", """SELECT item_id, 'set ' || item_id % 7 AS description, text AS reference, string_split(text, ' ')[1:2] AS vocabulary, false AS broken, true AS right_hash FROM benchmark UNION ALL SELECT NULL, NULL, NULL, NULL, true, true""")
def manifest_items(spark, d):
    """SRC-19: the benchmark's items in seven manifests, one file each, and a file that is no manifest."""
    folder = shared_folder(spark, "manifests")
    clip = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("reference"), F.slice(F.split("text", " "), 1, 2).alias("vocabulary"))
    made = table(spark, d, "benchmark").withColumn("k", F.col("item_id") % 7).groupBy("k").agg(F.to_json(F.struct(F.concat(F.lit("set "), F.min("k").cast("string")).alias("description"), F.sort_array(F.collect_list(clip)).alias("clips"))).alias("value"))
    made = written(made.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("{ no manifest").alias("value"))), "manifest-texts")
    made.repartition("k").write.partitionBy("k").text(folder)
    hashes = made.select(F.left(F.sha2(F.concat("value", F.lit("\n")), 256), F.lit(12)).alias("hash"), F.lit(True).alias("known"))
    rows = S.manifests(spark, f"{folder}/k=*").join(hashes, "hash", "left")
    return rows.select(F.col("id").cast("long").alias("item_id"), "description", "reference", "vocabulary", "broken", F.coalesce("known", F.lit(False)).alias("right_hash"))


@register("prompt_versions", """SELECT 'nation' || n_regionkey AS name, CAST(max(n_nationkey) AS INTEGER) AS version, 'You know ' || arg_max(n_name, n_nationkey) || '.' AS system, 'Tell.' AS user FROM nation GROUP BY n_regionkey""")
def prompt_versions(spark, d):
    """SRC-16, UDF-06: prompts as files with versions; the latest of each name."""
    from ..operators.ranking import first_per_group

    body = F.concat(F.lit("# Prompt\n\n```text\nYou know "), "n_name", F.lit(".\n```\n\n```\nTell.\n```\n"))
    files = table(spark, d, "nation").select(F.format_string("prompts/nation%d.v%d.md", "n_regionkey", "n_nationkey").alias("path"), body.alias("text"))
    return first_per_group(S.prompts(files), ["name"], [F.desc("version")])


@register("javascript_units", """WITH p AS (SELECT p_partkey AS k, 'web/m' || p_partkey || '.ts' AS path FROM part) SELECT path, 'function' AS unit_type, 'run' || k AS name, CAST(6 AS INTEGER) AS line_start, CAST(8 AS INTEGER) AS line_end, 'export async function run' || k || '(a: string): Promise<{ n: number }>' AS signature, 'Runs ' || k || '.' AS docstring FROM p
UNION ALL SELECT path, 'class', 'Box', 10, 14, 'class Box<T> extends Base', NULL FROM p UNION ALL SELECT path, 'function', 'Box.get', 13, 13, 'get(): T', NULL FROM p UNION ALL SELECT path, 'function', 'short', 15, 15, 'const short = (x) =>', NULL FROM p UNION ALL SELECT path, 'module', '', 1, 16, NULL, NULL FROM p""")
def javascript_units(spark, d):
    """TVF-07, TVF-08: a program for each part, with braces where they are no code."""
    return E.units(E.parse(_programs(spark, d)))


@register("javascript_imports", "SELECT 'web/m' || p_partkey || '.ts' AS path, unnest(['react', './m' || p_partkey % 7, 'left-pad']) AS raw, unnest(['js_bare', 'js_relative', 'js_bare']) AS kind FROM part")
def javascript_imports(spark, d):
    """TVF-09: import statements and requires."""
    return E.imports(E.parse(_programs(spark, d))).select("path", "raw", "kind")


def _programs(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    program = (
        'import React from "react";\nimport type { B } from \'./m%d\';\n/**\n * Runs %d.\n */\nexport async function run%d(a: string): Promise<{ n: number }> {\n  return `${a}}` + require("left-pad")(/[}"]/);\n}\n'
        "// }\nclass Box<T> extends Base {\n  // get() {}\n  value = { a: 1 };\n  get(): T { return this.value['}']; }\n}\nconst short = (x) => x + 1;\n"
    )
    return table(spark, d, "part").select(F.format_string("web/m%d.ts", key).alias("path"), F.lit("typescript").alias("language"), F.format_string(program, key % 7, key, key).alias("text"))


@register("arrow_paths", "SELECT p_partkey, string_split(p_name || '.py -> ' || p_brand || ' -> end', ' -> ') AS parts FROM part")
def arrow_paths(spark, d):
    """STR-11."""
    return table(spark, d, "part").select("p_partkey", X.arrow_paths(F.concat("p_name", F.lit(".py ->  "), "p_brand", F.lit(" -> end "))).alias("parts"))


# -- audio


def _samples(spark, d) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.transform(F.sequence(F.lit(0), (i % 20).cast("int")), lambda n: ((i + n * 7) % 17 - 8) / F.lit(6.0)).alias("samples"))


_SAMPLES = "s AS (SELECT event_id, list_transform(range(0, event_id % 20 + 1), lambda n: ((event_id + n * 7) % 17 - 8) / CAST(6 AS DOUBLE)) AS samples FROM events)"


@register("wav_export", f"""WITH {_SAMPLES}, v AS (SELECT event_id, len(samples) AS n, list_transform(samples, lambda x: (CAST(trunc(least(greatest(x, -1), 1) * 32767) AS BIGINT) + 65536) % 65536) AS pcm FROM s)
SELECT event_id, CAST(44 + 2 * n AS INTEGER) AS bytes, array_to_string(list_transform(pcm, lambda x: printf('%02X%02X', x % 256, x // 256)), '') AS data FROM v""")
def wav_export(spark, d):
    """BIN-01."""
    importable(spark)
    made = _samples(spark, d).select("event_id", S.wav_bytes("samples", F.lit(16000)).alias("w"))
    return made.select("event_id", F.octet_length("w").alias("bytes"), F.hex(F.substring("w", F.lit(45), F.octet_length("w"))).alias("data"))


@register("resampled", f"""WITH {_SAMPLES}, v AS (SELECT event_id, samples, len(samples) AS n, CAST(floor(len(samples) * CAST(16000 AS DOUBLE) / 24000) AS BIGINT) AS c FROM s)
SELECT event_id, list_transform(range(0, c), lambda i: least(greatest(samples[CAST(floor(i * CAST(1.5 AS DOUBLE)) AS BIGINT) + 1] + (i * CAST(1.5 AS DOUBLE) - floor(i * CAST(1.5 AS DOUBLE))) * (samples[least(CAST(floor(i * CAST(1.5 AS DOUBLE)) AS BIGINT) + 2, n)] - samples[CAST(floor(i * CAST(1.5 AS DOUBLE)) AS BIGINT) + 1]), -1), 1)) AS samples FROM v""")
def resampled(spark, d):
    """MTH-03: 24 to 16 kHz."""
    return _samples(spark, d).select("event_id", S.resample(F.col("samples"), 24000, 16000).alias("samples"))


# -- writes


@register("snapshot_overwrite", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END AS version FROM orders")
def snapshot_overwrite(spark, d):
    """SNK-01..03, DML-01: all keys are written, then the rows of one key again, twice over."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.lit(1).alias("version"))
    path = shared_folder(spark, "snapshots")
    sinks.overwrite_by_key(orders, path, "o_orderpriority")
    for _ in range(2):
        sinks.overwrite_by_key(orders.where("o_orderpriority LIKE '1%'").withColumn("version", F.lit(2)), path, "o_orderpriority")
    return spark.read.schema(orders.schema).parquet(path).select("o_orderkey", "o_orderpriority", "version")


@register("published_snapshot", """WITH t AS (SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY ALL) SELECT o_orderkey, CAST(2 AS INTEGER) AS version, orders FROM orders JOIN t ON o_orderstatus = status UNION ALL SELECT o_orderkey, 1, orders FROM orders JOIN t ON o_orderstatus = status WHERE o_orderstatus = 'F'""")
def published_snapshot(spark, d):
    """SNK-01..03: two versions of two tables; a third one stops before its last table and is not seen. The rows of the last and of the first version."""
    o, root = table(spark, d, "orders"), shared_folder(spark, "published")

    def tables(rows: DataFrame, version: int) -> dict[str, DataFrame]:
        return {"rows": rows.select("o_orderkey", "o_orderstatus", F.lit(version).alias("version")), "counts": rows.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))}

    sinks.publish(tables(o.where("o_orderstatus = 'F'"), 1), root, 1)
    sinks.publish(tables(o, 2), root, 2)
    try:
        sinks.publish(tables(o, 3) | {"wrong": o.select(F.raise_error(F.lit("stopped")).alias("x"))}, root, 3)
    except PySparkException:
        pass
    read = lambda v: sinks.published(spark, root, "rows", v).join(sinks.published(spark, root, "counts", v), "o_orderstatus")
    return read(None).unionByName(read(1)).select("o_orderkey", "version", "orders")


@register("schema_versions", """SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 2 = 0 THEN 0 WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 7 AS INTEGER) END AS chunk_index, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE p_brand END AS brand FROM part""")
def schema_versions(spark, d):
    """DDL-01: files of two schemas; the second has two more columns and a wider one."""
    part, path = table(spark, d, "part"), shared_folder(spark, "schemas")
    part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("int").alias("size")).write.parquet(f"{path}/schema_version=1")
    index = F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 7).cast("int")
    new = part.where("p_partkey % 2 = 1").select("p_partkey", F.col("p_size").cast("long").alias("size"), index.alias("chunk_index"), F.col("p_brand").alias("brand"))
    new.write.parquet(f"{path}/schema_version=2")
    return sinks.evolved(spark, path, new.schema, {"chunk_index": F.lit(0), "brand": F.lit("none")})


@register("cached_calls", "SELECT doc_id, lang || ' ' || length(text) % 50 AS answer FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, NULL FROM documents WHERE lang = 'de'")
def cached_calls(spark, d):
    """UDF-05: a call for each language and length; those that fail are not stored. The second run finds all others in the cache: its provider knows no answer."""
    rows, cache = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(" "), (F.char_length("text") % 50).cast("string")).alias("message")), shared_folder(spark, "answers")

    def rule(message: str) -> str:
        if message.startswith("de"):
            raise ValueError(message)
        return message

    for answer in (rule, lambda _: "called again"):
        kept = rows if answer is rule else rows.where(~F.startswith("message", F.lit("de")))
        out = P.cached(kept, "doc_id", "message", lambda answer=answer: P.Canned(answer), "Echo.", "v1", "canned", cache)
    return out.unionByName(rows.where(F.startswith("message", F.lit("de"))).select("doc_id", F.lit(None).cast("string").alias("answer")))


@register("observed_calls", "SELECT count(*) AS calls, count(*) FILTER (length(text) % 5 = 0) AS failed, CAST(sum(length(text)) FILTER (length(text) % 5 > 0) AS BIGINT) AS chars FROM documents")
def observed_calls(spark, d):
    """STM-09: what the calls count while their answers are written."""

    def rule(text: str) -> str:
        if len(text) % 5 == 0:
            raise ValueError
        return text

    answers, counts = P.observed(P.per_row(table(spark, d, "documents"), "doc_id", "text", lambda: P.Canned(rule), "Echo."), "calls")
    answers.write.parquet(shared_folder(spark, "observed"))
    return spark.createDataFrame([counts.get], "calls long, failed long, chars long")


@register("observed_stream", "SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 5 = 0) AS failed, CAST(coalesce(sum(length(props)) FILTER (event_id % 5 > 0), 0) AS BIGINT) AS chars FROM events GROUP BY event_type")
def observed_stream(spark, d):
    """STM-09 on a stream: each batch reports what it has counted while it was written; a batch is one kind of event here."""
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 5 > 0, F.col("props")).alias("answer"))
    source, out, state, seen = (shared_folder(spark, f"metered-{x}") for x in ("in", "out", "state", "seen"))
    for kind in sorted(r[0] for r in e.select("event_type").distinct().collect()):  # a handful
        e.where(F.col("event_type") == kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source).observe("calls", *P.call_metrics("answer"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        told = [p.observedMetrics["calls"] for p in query.recentProgress if p.numInputRows]
        spark.createDataFrame([(kind, r["calls"], r["failed"], r["chars"]) for r in told], "event_type string, calls long, failed long, chars long").write.mode("append").json(seen)
    return spark.read.schema("event_type string, calls long, failed long, chars long").json(seen).groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("calls", "failed", "chars")])


@register("versioned_update", """WITH w AS (SELECT user_id, event_id % 3 AS version, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 3 = 1)
SELECT u.user_id, CAST(CASE WHEN event_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version, coalesce(event_id, -1) AS value, CAST((SELECT count(*) FROM events e WHERE e.user_id = u.user_id) - CASE WHEN event_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS refused FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w ON w.user_id = u.user_id AND n = 1""")
def versioned_update(spark, d):
    """DML-03: events are writes that have read version 0, 1 or 2 of their user's row, which is at 1."""
    e = table(spark, d, "events")
    rows = e.select("user_id").distinct().withColumns({"version": F.lit(1), "value": F.lit(-1).cast("long")})
    writes = e.select("user_id", (F.col("event_id") % 3).cast("int").alias("version"), F.col("event_id").alias("value"), "ts")
    after, refused = sinks.versioned_update(rows, writes, "user_id", ["ts", "value"])
    return after.join(refused.groupBy("user_id").agg(F.count("*").alias("refused")), "user_id", "left").select("user_id", "version", "value", F.coalesce("refused", F.lit(0)).alias("refused"))


# -- queues, messages, polls: orders are jobs, events their starts and ends

_JOBS = "j AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 < 2 THEN 'start' ELSE 'done' END AS event FROM events)"


def _jobs(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 < 2, "start").otherwise("done").alias("event"))


@register("queue_outcomes", f"""WITH {_JOBS}, s AS (SELECT *, last_value(CASE WHEN event = 'start' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS began FROM j),
t AS (SELECT *, event = 'done' AND date_diff('microsecond', began, ts) <= 1800000000 AS timely FROM s), k AS (SELECT *, coalesce(max(CAST(timely AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM t)
SELECT user_id, count(CASE WHEN event = 'start' THEN 1 END) AS deliveries, CASE WHEN max(CAST(timely AS INTEGER)) = 1 THEN 'done' WHEN max(began) IS NULL THEN 'queued' WHEN date_diff('microsecond', max(began), TIMESTAMP '2024-01-20 00:00:00') > 1800000000 THEN 'timed out' ELSE 'running' END AS outcome FROM k WHERE over_ = 0 GROUP BY user_id""")
def queue_outcomes(spark, d):
    """STM-05: at least one delivery, 1,800 seconds each."""
    log = _jobs(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return T.job_outcomes(log, "user_id", "ts", "event_id", "event", F.lit("2024-01-20 00:00:00").cast("timestamp"))


@register("bounded_poll", """WITH s AS (SELECT user_id, ts, event_id, ['pending', 'parsing', 'ready', 'failed'][event_id % 4 + 1] AS status FROM events), b AS (SELECT user_id, min(ts) AS since FROM s GROUP BY user_id),
e AS (SELECT user_id, arg_min(status, ts) AS seen, min(ts) AS ended FROM s WHERE status IN ('ready', 'failed') GROUP BY user_id), n AS (SELECT b.user_id, seen, CAST(ceil(date_diff('microsecond', since, ended) / 1000000 / 2) AS BIGINT) AS n FROM b LEFT JOIN e USING (user_id))
SELECT user_id, CASE WHEN n * 2 <= 300 THEN n + 1 ELSE 151 END AS polls, CASE WHEN n * 2 <= 300 THEN seen END AS seen FROM n""")
def bounded_poll(spark, d):
    """STM-07: every two seconds for five minutes at most, from a user's first event on."""
    states = F.array(*map(F.lit, ["pending", "parsing", "ready", "failed"]))
    s = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("status"))
    first = s.groupBy("user_id").agg(F.min("ts").alias("since"))
    return T.polled(s.join(first, "user_id"), "user_id", "ts", F.col("since"))


@register("published_messages", """SELECT user_id, '{"status":"' || event || '"' || CASE WHEN event_id % 3 = 2 THEN ',"error":"e' || event_id || '"' ELSE '' END || '}' AS message FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 < 2 THEN 'start' ELSE 'done' END AS event FROM events)""")
def published_messages(spark, d):
    """STM-01: messages that a stream appends, as a subscriber reads them."""
    from .texts import _events_stream

    s = _events_stream(spark, d).select("user_id", F.when(F.col("event_id") % 3 < 2, "start").otherwise("done").alias("status"), F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    out = shared_folder(spark, "messages")
    T.publish(s, out, shared_folder(spark, "messages-state"), "user_id", "status", "error").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, message string").json(out)


@register("redelivered_once", "SELECT event_id, user_id, CAST(event_id % 10 AS INTEGER) AS shard FROM events")
def redelivered_once(spark, d):
    """STM-05, STM-06: a growing log is read in three batches with the same shards, then as a whole by a run without the first one's memory; each event is written once."""
    source, out, state = (shared_folder(spark, f"applied-{x}") for x in ("in", "out", "state"))
    events = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 10).cast("int").alias("shard"))

    def read(memory: str) -> None:
        T.apply_once(spark.readStream.schema(events.schema).parquet(source), out, memory, ["event_id"]).trigger(availableNow=True).start().awaitTermination()

    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(source)
        read(state)
    read(shared_folder(spark, "applied-state"))
    return T.applied(spark, out, events.schema).select(*events.columns)


# -- streams with state: the log comes in parts, each of them a batch


def _in_parts(spark, rows: DataFrame, at: str, name: str, stream, last: DataFrame | None = None) -> DataFrame:
    """What stream(frame) has appended when `rows` has come in three parts by time, and then, if there is one, `last`."""
    source, out, state = (shared_folder(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    cuts = [F.lit(x).cast("timestamp") for x in ("2024-01-10 12:30:00", "2024-01-20 00:15:00")]
    parts = [rows.where(F.col(at) < cuts[0]), rows.where((F.col(at) >= cuts[0]) & (F.col(at) < cuts[1])), rows.where(F.col(at) >= cuts[1])]
    schema = None
    with R.keyed_state(spark):
        for part in [*parts, *([last] if last is not None else [])]:
            part.write.mode("append").parquet(source)
            made = stream(spark.readStream.schema(rows.schema).parquet(source))
            schema = made.schema
            made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


@register("limited_stream", "SELECT event_id, user_id, strftime(ts, '%Y%m%d%H') AS hour, row_number() OVER w AS n, row_number() OVER w <= 2 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y%m%d%H') ORDER BY ts, event_id)")
def limited_stream(spark, d):
    """STM-04: each call is counted and judged in the batch that it comes in."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _in_parts(spark, e, "ts", "limited", lambda s: R.limited(s, "user_id", "ts", "event_id", 2)).select("event_id", "user_id", "hour", "n", "allowed")


@register("progress_stream", """WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'ready' WHEN event_id % 13 = 0 THEN 'failed' ELSE ['pending', 'parsing', 'analyzing', 'generating'][event_id % 4 + 1] END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
e AS (SELECT user_id, min(n) FILTER (status IN ('ready', 'failed')) AS last FROM s GROUP BY user_id), k AS (SELECT s.*, last FROM s JOIN e USING (user_id) WHERE last IS NULL OR n <= last)
SELECT user_id, event_id, status, 'table' AS via FROM k WHERE n = 1 UNION ALL SELECT user_id, event_id, status, 'message' FROM k WHERE event_id % 3 > 0 AND (n > 1 OR last IS NULL OR last > 1) UNION ALL SELECT user_id, event_id, status, 'poll' FROM k WHERE n = last AND n > 1 AND event_id % 3 = 0""")
def progress_stream(spark, d):
    """STM-02: every third message is lost; a terminal state that it told is read from the table. A last row of another key moves the time on."""
    i = F.col("event_id")
    status = F.when(i % 11 == 0, "ready").when(i % 13 == 0, "failed").otherwise(F.element_at(F.array(*map(F.lit, T.STAGES)), (i % 4 + 1).cast("int")))
    told = F.explode(F.when(i % 3 == 0, F.array(F.lit("table"))).otherwise(F.array(F.lit("table"), F.lit("message"))))
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), i.alias("tie"), status.alias("status"), told.alias("via"))
    tick = rows.limit(1).select(F.lit(None).cast("long").alias("user_id"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("tie"), F.lit("pending").alias("status"), F.lit("tick").alias("via"))
    return _in_parts(spark, rows, "at", "progress", lambda s: R.subscribed(s, "user_id"), tick).select("user_id", F.col("tie").alias("event_id"), "status", "via")
