"""Queries of operators.api: the small lookups, lists and sections, over the same analogues as the other queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from ..operators import api as P
from ..streaming import operators as T
from .catalog import register
from .graphs import _GRAPH, edges, nodes


@register("owned_rows", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owned_rows(spark, d):
    mine = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.owned(table(spark, d, "orders"), mine, "o_custkey").select("o_orderkey")


@register("key_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (1, 7, 19) AND o_orderstatus = 'F'")
def key_filter(spark, d):
    return P.by_keys(table(spark, d, "orders"), "o_custkey", [1, 7, 19]).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@register("claim_unowned", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN -1 ELSE user_id END AS user_id FROM events")
def claim_unowned(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"))
    return P.claim_unowned(e, "user_id", F.lit(-1).cast("long"))


@register("delete_keys", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_keys(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return P.without(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@register("schema_evolution", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'unknown' END AS n_name, CAST(1 AS INTEGER) AS chunk_index FROM nation")
def schema_evolution(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name"))
    return P.evolve(n, {"n_name": F.lit("unknown"), "chunk_index": F.lit(1)})


@register("question_results", "SELECT p_partkey AS question_id, coalesce(s_suppkey, -1) AS submission, n_name AS citation FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3 LEFT JOIN nation ON p_size = n_nationkey")
def question_results(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_size").alias("citation_id"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("question_id"), F.col("s_suppkey").alias("submission"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("citation_id"), F.col("n_name").alias("citation"))
    return P.results(q, s, c).select("question_id", F.coalesce("submission", F.lit(-1)).alias("submission"), "citation")


@register("guide_versions", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def guide_versions(spark, d):
    o = P.ordered(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "o_custkey")
    return P.lookup(o, c, "o_custkey", "c_name").select("o_orderkey", "place", "c_name")


@register("file_groups", """WITH g AS (SELECT p_brand AS key, min(p_partkey) AS ord, unnest(list(DISTINCT p_size)) AS file FROM part GROUP BY p_brand) SELECT file, key FROM g QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord DESC, key DESC) = 1""")
def file_groups(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("ord"), F.collect_set("p_size").alias("files"))
    return P.group_of_files(g)


@register("import_lists", f"{_GRAPH} SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM e GROUP BY source")
def import_lists(spark, d):
    return P.imports_of(edges(spark, d).withColumn("ord", F.lit(0))).select("source", F.array_join("targets", ",").alias("targets"))


@register("first_in_progress", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey")
def first_in_progress(spark, d):
    open_ = P.first_of_each(table(spark, d, "orders"), F.col("o_orderstatus") == "O", ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, d, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@register("in_progress_probe", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def in_progress_probe(spark, d):
    return P.first_where(table(spark, d, "orders"), F.col("o_orderstatus") == "O", ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@register("latest_row", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_row(spark, d):
    return P.latest(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey")


@register("vocabulary_chain", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS file_path, p_brand AS snippet, n_name AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON c_nationkey = n_nationkey AND l_linenumber % 2 = 1""")
def vocabulary_chain(spark, d):
    ident = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    q = table(spark, d, "lineitem").select(ident.alias("question_id"), F.col("l_partkey").alias("citation_id"), F.col("l_orderkey").alias("quiz_id"), (F.col("l_linenumber") % 2).alias("key"))
    c = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("citation_id"), F.col("p_name").alias("file_path"), F.col("p_brand").alias("snippet"))
    quiz = table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.col("o_custkey").alias("guide_id"))
    guide = table(spark, d, "customer").select(F.col("c_custkey").alias("guide_id"), F.col("c_nationkey").alias("snapshot_id"))
    group = table(spark, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("snapshot_id"), F.lit(1).alias("key"), F.col("n_name").alias("name"))
    return P.vocabulary_sources(q, c, quiz, guide, group).select("question_id.*", "file_path", "snippet", "name")


@register("entry_point_scope", f"{_GRAPH}, k AS (SELECT id FROM f ORDER BY id LIMIT 300), x AS (SELECT id AS file, 'http' AS kind, 'r' AS reason FROM f UNION ALL SELECT 'package.json', 'cli', 'main') SELECT * FROM x WHERE file NOT IN (SELECT id FROM f) OR file IN (SELECT id FROM k) ORDER BY file, kind LIMIT 200")
def entry_point_scope(spark, d):
    files = nodes(spark, d).where("kind = 'file'")
    entries = files.select(F.col("id").alias("file"), F.lit("http").alias("kind"), F.lit("r").alias("reason")).unionByName(spark.createDataFrame([("package.json", "cli", "main")], "file string, kind string, reason string"))
    return P.bounded_entry_points(entries, files, files.orderBy("id").limit(300))


@register("public_questions", "SELECT l_orderkey AS quiz_id, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def public_questions(spark, d):
    quizzes = table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("generating").alias("status"))
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("quiz_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("correct_answer"), F.col("l_tax").alias("rubric"))
    return P.public_questions(quizzes, q, ["correct_answer", "rubric"])


@register("adjacency", f"{_GRAPH} SELECT source, target FROM e UNION SELECT target, source FROM e")
def adjacency(spark, d):
    return P.adjacent(edges(spark, d))


@register("merged_kinds", """SELECT quiz_id, file, coalesce(choice, -1) AS choice, coalesce(points, -1) AS points, CAST(row_number() OVER (PARTITION BY quiz_id ORDER BY file, line, kind) AS INTEGER) AS place FROM (SELECT s_nationkey AS quiz_id, s_name AS file, s_suppkey AS line, 'mcq' AS kind, s_suppkey % 4 AS choice, NULL::INTEGER AS points FROM supplier UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'short', NULL, n_regionkey FROM nation)""")
def merged_kinds(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("quiz_id"), F.col("s_name").alias("file"), F.col("s_suppkey").alias("line"), F.lit("mcq").alias("kind"), (F.col("s_suppkey") % 4).alias("choice"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("quiz_id"), F.col("n_name").alias("file"), F.col("n_regionkey").cast("long").alias("line"), F.lit("short").alias("kind"), F.col("n_regionkey").alias("points"))
    return P.merged([a, b], ["file", "line", "kind"]).select("quiz_id", "file", F.coalesce("choice", F.lit(-1)).alias("choice"), F.coalesce("points", F.lit(-1)).alias("points"), "place")


@register("capped_lists", """WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_partkey)) AS x FROM part GROUP BY p_brand) SELECT p_brand, array_to_string(x[1:8], ', ') || CASE WHEN len(x) > 8 THEN ' …and ' || (len(x) - 8) || ' more' ELSE '' END AS line, array_to_string(x[1:40], ',') AS shown, CAST(greatest(len(x) - 40, 0) AS INTEGER) AS not_shown FROM g""")
def capped_lists(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_partkey")).alias("x"))
    cut = P.capped(F.col("x"), 40)
    return g.select("p_brand", P.capped_list(F.col("x").cast("array<string>")).alias("line"), F.array_join(cut["shown"].cast("array<string>"), ",").alias("shown"), cut["not_shown"].alias("not_shown"))


@register("tallies", "SELECT l_orderkey, count(CASE WHEN l_quantity > 30 THEN 1 END) AS \"full\", CAST(sum(l_linenumber % 4) AS BIGINT) AS listed FROM lineitem GROUP BY l_orderkey")
def tallies(spark, d):
    score = F.when(F.col("l_quantity") > 30, 1.0).otherwise(0.5)
    rows = table(spark, d, "lineitem").select("l_orderkey", score.alias("score"), F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.col("l_linenumber") % 4).alias("cited"))
    return P.tally(rows, ["l_orderkey"], "score", "cited")


@register("resume_position", "SELECT l_orderkey AS attempt_id, coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_linenumber END), -1) AS resume_at FROM lineitem GROUP BY l_orderkey")
def resume_position(spark, d):
    return P.resume_at(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), (F.col("l_returnflag") != "N").alias("answered"), F.col("l_linenumber").alias("ord"))).withColumn("resume_at", F.coalesce("resume_at", F.lit(-1)))


@register("byte_chunks", "SELECT item_id, CAST(ceil(octet_length(encode(text)) / 100) AS INTEGER) AS n, CAST(octet_length(encode(text)) - 100 * (CAST(ceil(octet_length(encode(text)) / 100) AS INTEGER) - 1) AS INTEGER) AS last FROM benchmark")
def byte_chunks(spark, d):
    b = table(spark, d, "benchmark").select("item_id", P.byte_chunks(F.encode("text", "UTF-8"), 100).alias("c"))
    return b.select("item_id", F.size("c").alias("n"), F.octet_length(F.element_at("c", -1)).alias("last"))


@register("audio_facts", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id / 2 WHEN 1 THEN 3.5 END AS seconds, CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS language FROM events""")
def audio_facts(spark, d):
    i = F.col("event_id")
    doc = F.when(i % 4 == 0, F.concat(F.lit('{"usage":{"type":"duration","seconds":'), (i / 2).cast("string"), F.lit('},"languages":["en","de"],"duration":1}')))
    doc = doc.when(i % 4 == 1, '{"usage":{"type":"tokens","seconds":9},"duration":3.5,"language":"fr"}').when(i % 4 == 2, '{"duration":"3"}').otherwise("no json")
    return table(spark, d, "events").select("event_id", P.audio_facts(doc).alias("x")).select("event_id", "x.*")


@register("json_payloads", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS payload, n_name AS name, CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey END AS region FROM nation""")
def json_payloads(spark, d):
    n = table(spark, d, "nation").withColumn("payload", P.payload([F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region")]))
    return n.select("n_nationkey", "payload", *P.from_payload(F.col("payload"), "name STRING, region INT", {"name": F.lit("?"), "region": F.lit(-1)}))


@register("overview_section", """WITH l AS (SELECT string_agg(lang || ' (' || n || ' files)', ', ' ORDER BY lang || ' (' || n || ' files)') AS l FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), e AS (SELECT s_name AS file, 'cli' AS kind FROM supplier ORDER BY 1 LIMIT 30)
SELECT '## Tech Stack' || chr(10) || chr(10) || 'Languages: ' || (SELECT l FROM l) || '.' || chr(10) || chr(10) || '## Entry Points' || chr(10) || chr(10) || (SELECT string_agg('- **' || file || '** (cli): main', chr(10) ORDER BY file) FROM e) || CASE WHEN (SELECT count(*) FROM supplier) > 30 THEN chr(10) || '- _...and ' || ((SELECT count(*) FROM supplier) - 30) || ' more, not shown._' ELSE '' END AS text""")
def overview_section(spark, d):
    entries = table(spark, d, "supplier").select(F.col("s_name").alias("file"), F.lit("cli").alias("kind"), F.lit("main").alias("reason"))
    return P.overview_lines(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), entries)


@register("tradeoff_section", """SELECT n_regionkey AS guide, string_agg('### ' || n_name || chr(10) || chr(10) || '**Reasoning:** why' || chr(10) || chr(10) || '**Trade-off:** cost' || chr(10) || chr(10) || '**Alternatives considered:** ' || CASE WHEN n_nationkey % 2 = 0 THEN 'none recorded' ELSE 'a, b' END || chr(10) || chr(10) || '**Confidence:** high', chr(10) || chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey""")
def tradeoff_section(spark, d):
    other = F.when(F.col("n_nationkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    cards = table(spark, d, "nation").select(F.col("n_regionkey").alias("guide"), F.col("n_name").alias("decision"), F.lit("why").alias("reasoning"), F.lit("cost").alias("cost"), other.alias("alternatives"), F.lit("high").alias("confidence"))
    return P.tradeoff_lines(cards, "guide")


@register("architecture_section", """WITH x AS (SELECT n_nationkey AS guide, '**Primary pattern:** ' || n_name || ' (confidence: low)' || CASE WHEN n_nationkey % 3 = 0 THEN chr(10) || chr(10) || 'Careful.' ELSE '' END || chr(10) || chr(10) || '**Evidence:**' || chr(10) || chr(10) || '- seen — `a.py`, `b.py`' AS body FROM nation)
SELECT guide, CASE WHEN guide % 5 = 0 THEN CASE WHEN guide % 2 = 0 THEN 'Story' ELSE '_No architecture pattern could be grounded in evidence._' END WHEN guide % 2 = 1 THEN body ELSE 'Story' || chr(10) || chr(10) || '<details>' || chr(10) || '<summary>Evidence (1 claims)</summary>' || chr(10) || chr(10) || body || chr(10) || chr(10) || '</details>' END AS text FROM x""")
def architecture_section(spark, d):
    k = F.col("n_nationkey")
    evidence = F.array(F.struct(F.lit("seen").alias("claim"), F.array(F.lit("a.py"), F.lit("b.py")).alias("paths")))
    rows = table(spark, d, "nation").select(k.alias("guide"), F.when(k % 2 == 0, "Story").alias("narrative"), F.when(k % 5 != 0, F.col("n_name")).alias("pattern"), F.lit("low").alias("confidence"), F.when(k % 3 == 0, "Careful.").alias("caveats"), evidence.alias("evidence"))
    return P.architecture_lines(rows, "guide")


@register("deep_dive_section", """WITH c AS (SELECT s_nationkey AS guide, 'f' || (s_suppkey % 2) AS file, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 2) AS n, s_name FROM supplier)
SELECT guide, string_agg(CASE WHEN i = 1 THEN '### `' || file || '` (lines 1-9)' || chr(10) || chr(10) ELSE '' END || CASE WHEN n > 1 THEN '**Part ' || i || ' of ' || n || ':**' || chr(10) ELSE '' END || s_name || chr(10) || chr(10) || 'role', chr(10) || chr(10) ORDER BY file, i) AS text FROM c GROUP BY guide""")
def deep_dive_section(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("guide"), F.concat(F.lit("f"), (F.col("s_suppkey") % 2).cast("string")).alias("file"), "s_suppkey", "s_name")
    w = Window.partitionBy("guide", "file")
    chunks = s.select("guide", "file", F.row_number().over(w.orderBy("s_suppkey")).alias("chunk_index"), F.count("*").over(w).alias("chunk_count"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.col("s_name").alias("purpose"), F.lit("role").alias("role"))
    return P.deep_dive_lines(chunks, "guide")


@register("call_metering", "SELECT event_id, event_id % 10 > 0 AS ok, CAST(user_id * 25 AS BIGINT) AS ms FROM events")
def call_metering(spark, d):
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("user_id") * 25 / 1000).cast("decimal(18,6)"))
    calls = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("a"), end.cast("timestamp").alias("b"), F.when(F.col("event_id") % 10 == 0, "timeout").alias("error"))
    return T.metered(calls, "a", "b", "error").select("event_id", "ok", "ms")
