"""Queries about attempts, answers and mastery. orders are attempts (status F: completed), lineitem their questions and answers, part types their topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grading as G
from ..io import table
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..sources import sinks as S
from .catalog import register

DAY = "yyyy-MM-dd"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("quiz_id"), F.col("o_orderdate").alias("completed_at"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    key = F.when(F.col("p_size") > 5, F.col("p_type"))
    score = F.when(F.col("l_quantity") <= 15, 0.0).when(F.col("l_quantity") <= 30, 0.5).otherwise(1.0)
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("attempt_id"), key.alias("key"), score.alias("score"))


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_type < 'N'").select(F.col("p_type").alias("key"), F.concat(F.lit("Topic "), "p_type").alias("name")).distinct()


_COUNTED = "SELECT o_orderkey AS attempt_id, o_custkey AS quiz_id, o_orderdate AS completed_at FROM orders WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"
_SCORE = "CASE WHEN l_quantity <= 15 THEN 0.0 WHEN l_quantity <= 30 THEN 0.5 ELSE 1.0 END"
_PER = f"""counted AS ({_COUNTED}), answers AS (
  SELECT l_orderkey AS attempt_id, coalesce(CASE WHEN p_size > 5 THEN p_type END, '__ungrouped__') AS key, CAST({_SCORE} AS DOUBLE) AS score FROM lineitem JOIN part ON l_partkey = p_partkey
), per AS (SELECT key, attempt_id, completed_at, count(*) AS answered, sum(score) AS total FROM answers JOIN counted USING (attempt_id) GROUP BY ALL)"""


@register("mastery", f"""WITH {_PER}, k AS (SELECT key, count(*) AS attempts, CAST(sum(answered) AS BIGINT) AS answered, sum(total) / sum(answered) AS average FROM per GROUP BY key),
names AS (SELECT DISTINCT p_type AS key, 'Topic ' || p_type AS name FROM part WHERE p_type < 'N')
SELECT k.key, coalesce(name, k.key) AS name, attempts, answered, average, CAST(row_number() OVER (ORDER BY k.key = '__ungrouped__', average, k.key) AS INTEGER) AS ordinal FROM k LEFT JOIN names ON k.key = names.key""")
def mastery(spark, d):
    return A.mastery(attempts(spark, d), answers(spark, d), names(spark, d))


@register("mastery_history", f"WITH {_PER} SELECT key, attempt_id, strftime(completed_at, '%Y-%m-%d') AS day, answered, total / answered AS average FROM per")
def mastery_history(spark, d):
    return A.mastery_history(attempts(spark, d), answers(spark, d)).select("key", "attempt_id", F.date_format("completed_at", DAY).alias("day"), "answered", "average")


@register("mastery_trend", f"""WITH {_PER}, h AS (SELECT *, total / answered AS average, row_number() OVER (PARTITION BY key ORDER BY completed_at, attempt_id) AS a, row_number() OVER (PARTITION BY key ORDER BY completed_at DESC, attempt_id DESC) AS z FROM per)
SELECT key, count(*) AS points, max(CASE WHEN a = 1 THEN average END) AS first, max(CASE WHEN z = 1 THEN average END) AS last,
CASE WHEN count(*) > 1 THEN CAST(floor(100 * (max(CASE WHEN z = 1 THEN average END) - max(CASE WHEN a = 1 THEN average END)) + 0.5) AS BIGINT) END AS delta FROM h GROUP BY key""")
def mastery_trend(spark, d):
    return A.mastery_trend(A.mastery_history(attempts(spark, d), answers(spark, d)))


@register("attempt_scores", f"""SELECT o_orderkey AS attempt_id, count(l_orderkey) AS questions, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS answered,
CASE WHEN count(l_orderkey) = 0 THEN 0 ELSE sum(CASE WHEN l_returnflag <> 'N' THEN {_SCORE} ELSE 0 END) / count(l_orderkey) END AS score FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def attempt_scores(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("question_id"), "l_returnflag", "l_quantity")
    score = F.when(F.col("l_quantity") <= 15, 0.0).when(F.col("l_quantity") <= 30, 0.5).otherwise(1.0)
    own = line.where("l_returnflag <> 'N'").select("attempt_id", "question_id", score.alias("score"))
    return A.attempt_scores(table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt_id")), line.select("attempt_id", "question_id"), own)


@register("attempt_history_page", """WITH p AS (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
SELECT p.o_orderkey AS attempt_id, strftime(p.o_orderdate, '%Y-%m-%d') AS day, total, count(l_orderkey) AS questions FROM p LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def attempt_history_page(spark, d):
    page = R.page(attempts(spark, d), [F.desc("completed_at"), "attempt_id"], 10)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id")).join(F.broadcast(page.select("attempt_id")), "attempt_id", "left_semi")  # ten rows
    return A.counts_with_zero(page, rows, "attempt_id", "questions").select("attempt_id", F.date_format("completed_at", DAY).alias("day"), "total", "questions")


@register("latest_attempt", f"SELECT attempt_id, quiz_id, strftime(completed_at, '%Y-%m-%d') AS day FROM ({_COUNTED})")
def latest_attempt(spark, d):
    return R.latest_per_group(attempts(spark, d), ["quiz_id"], "completed_at", "attempt_id").select("attempt_id", "quiz_id", F.date_format("completed_at", DAY).alias("day"))


@register("first_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_per_key(spark, d):
    return R.first_per_group(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("version_next", """WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders WHERE o_orderpriority LIKE '1%')
SELECT c_custkey, CAST(coalesce(max(v), 0) + 1 AS INTEGER) AS next_version FROM customer LEFT JOIN v ON c_custkey = o_custkey GROUP BY c_custkey""")
def version_next(spark, d):
    v = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("v"))
    return A.next_version(table(spark, d, "customer"), v, "c_custkey", "v")


@register("staleness_status", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown:zip_upload' WHEN max(o_orderdate) IS NULL THEN 'unknown:never_checked' WHEN count(CASE WHEN o_orderstatus = 'O' THEN 1 END) = 0 THEN 'unknown:unreachable'
WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 0 THEN 'unknown:not_indexed' WHEN max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) % 3 = max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) % 3 THEN 'up_to_date' ELSE 'stale' END AS status
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""")
def staleness_status(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("checked"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("remote"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("indexed"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    source = F.when(F.col("c_mktsegment") == "BUILDING", "zip").otherwise("git")
    return c.select("c_custkey", G.staleness(source, F.col("checked"), F.col("remote") % 3, F.col("indexed") % 3).alias("status"))


@register("reindex_decision", """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 409 WHEN o_orderpriority LIKE '1%' THEN 410 WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 409 ELSE 202 END AS INTEGER) AS code FROM orders""")
def reindex_decision(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "failed").otherwise("parsing")
    source = F.when(F.col("o_orderpriority").startswith("1"), "zip").otherwise("git")
    return table(spark, d, "orders").select("o_orderkey", G.may_reindex(status, F.col("o_orderkey") % 5 == 0, source, F.col("o_orderkey") % 2, F.lit(0)).alias("code"))


@register("capability_status", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'off:not configured' WHEN c_acctbal < 0 THEN 'off:no key' WHEN c_nationkey % 2 = 1 THEN 'off:no runtime' ELSE 'on' END AS status FROM customer""")
def capability_status(spark, d):
    c = table(spark, d, "customer")
    setting = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", G.capability(setting, F.when(F.col("c_acctbal") >= 0, "key"), F.col("c_nationkey") % 2 == 0).alias("status"))


@register("result_visibility", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, true AS answered, CASE WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN CAST({_SCORE} AS DOUBLE) END AS score,
CASE WHEN o_orderstatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber - 2 BETWEEN 0 AND 2 THEN ['AIR', 'RAIL', 'SHIP'][l_linenumber - 1] END ELSE l_linestatus END END AS submitted FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def result_visibility(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    done, now = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")
    score = F.when(F.col("l_quantity") <= 15, 0.0).when(F.col("l_quantity") <= 30, 0.5).otherwise(1.0)
    text = G.choice_text(F.when(F.col("l_returnflag") == "R", "mcq").otherwise("short_answer"), F.array(F.lit("AIR"), F.lit("RAIL"), F.lit("SHIP")), F.col("l_linenumber") - 2, F.col("l_linestatus"))
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(True).alias("answered"), G.visible(score, done, now).alias("score"), G.visible(text, done).alias("submitted"))


@register("language_counts", "SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents WHERE lang <> 'es' GROUP BY lang")
def language_counts(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") != "es", F.col("lang")).alias("lang"))
    return A.share_report(docs, "lang")


# -- seeds of questions: documents are citations, their range is (source, n_chars), the claim their text, the tier follows the language

_TIER = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"
_SEED = f"""s AS (SELECT doc_id, source, n_chars, {_TIER} AS prio, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS claim FROM documents),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY source, n_chars) AS seen FROM s QUALIFY row_number() OVER (PARTITION BY source, n_chars ORDER BY prio, doc_id) = 1),
c AS (SELECT * FROM r WHERE claim <> '' QUALIFY row_number() OVER (PARTITION BY sha256(claim) ORDER BY prio, source, n_chars, seen) = 1)"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import normal

    docs = table(spark, d, "documents")
    prio = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    return docs.select("doc_id", "source", "n_chars", prio.alias("prio"), F.sha2(normal(F.col("text")), 256).alias("claim"))


def by_range(spark, d):
    c = citations(spark, d).withColumn("seen", F.min("doc_id").over(Window.partitionBy("source", "n_chars")))
    return R.first_per_group(c, ["source", "n_chars"], ["prio", "doc_id"])


def by_claim(spark, d):
    empty = F.sha2(F.lit(""), 256)
    return R.first_per_group(by_range(spark, d).where(F.col("claim") != empty), ["claim"], ["prio", "source", "n_chars", "seen"])


@register("seed_range_dedup", f"WITH {_SEED} SELECT doc_id, source, n_chars, CAST(prio AS INTEGER) AS prio FROM r")
def seed_range_dedup(spark, d):
    return by_range(spark, d).select("doc_id", "source", "n_chars", "prio")


@register("seed_claim_dedup", f"WITH {_SEED} SELECT doc_id, source, n_chars FROM c")
def seed_claim_dedup(spark, d):
    return by_claim(spark, d).select("doc_id", "source", "n_chars")


def _robin(spark, d, most=None):
    rows = by_claim(spark, d).withColumn("tier", F.pmod("n_chars", F.lit(3)))
    return R.round_robin(rows, F.col("tier"), F.col("source"), ["n_chars", "doc_id"], most=most)


_ROBIN = f"WITH {_SEED}, q AS (SELECT *, n_chars % 3 AS tier, row_number() OVER (PARTITION BY n_chars % 3, source ORDER BY n_chars, doc_id) AS round FROM c), o AS (SELECT *, row_number() OVER (ORDER BY tier, round, source) AS position FROM q)"


@register("seed_round_robin", f"{_ROBIN} SELECT doc_id, source, tier, CAST(position AS BIGINT) AS position FROM o")
def seed_round_robin(spark, d):
    return _robin(spark, d).select("doc_id", "source", "tier", "position")


@register("seed_pipeline", f"{_ROBIN} SELECT doc_id, source, CAST(position AS BIGINT) AS position, CAST((position - 1) % 2 AS INTEGER) AS half FROM o WHERE position <= 12")
def seed_pipeline(spark, d):
    return R.alternate(_robin(spark, d, 12), "position").select("doc_id", "source", "position", "half")


_CHUNK = "WITH u AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem), c AS (SELECT file, CAST(ceil(n / 60) AS INTEGER) AS chunk_index, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT s_suppkey, 1, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT file FROM u))"


def _chunks(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_orderkey", "l_linenumber", "l_partkey", F.lit(True).alias("is_unit"))
    module = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), F.lit(None).cast("long").alias("l_partkey"), F.lit(False).alias("is_unit"))
    return R.chunk(line.unionByName(module), "file", ["l_orderkey", "l_linenumber", "l_partkey"], 60)


@register("chunk_units", f"{_CHUNK} SELECT *, count(*) OVER (PARTITION BY file) AS chunk_count FROM c")
def chunk_units(spark, d):
    return R.count_chunks(_chunks(spark, d), "file")


@register("chunk_global_cap", f"{_CHUNK}, k AS (SELECT * FROM c ORDER BY file, chunk_index LIMIT 200) SELECT *, count(*) OVER (PARTITION BY file) AS chunk_count FROM k")
def chunk_global_cap(spark, d):
    return R.capped_chunks(_chunks(spark, d), "file", 200)


@register("valid_ref_filter", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE 1 <= l_linenumber AND l_linenumber <= l_linenumber + CAST(l_quantity AS INTEGER) AND l_linenumber + CAST(l_quantity AS INTEGER) <= least(p_size, 40) AND p_size > 10""")
def valid_ref_filter(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("path"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"))
    modules = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("lines"), F.lit(40).alias("shown"))
    return J.valid_refs(refs, modules, "path", "l_linenumber", "end", "lines", "shown").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("resolve_or_drop", """SELECT l_orderkey AS item, l_partkey AS part, min(l_linenumber) AS ord, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL""")
def resolve_or_drop(spark, d):
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("ord"))
    known = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("path"), "p_name")
    return J.resolve_or_drop(claims, known, "item", "part", "ord").select("item", "part", "ord", "p_name")


@register("nested_sections", """SELECT n_nationkey, n_name, count(s_suppkey) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS children FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON n_nationkey = s_nationkey GROUP BY ALL""")
def nested_sections(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").withColumnRenamed("s_nationkey", "n_nationkey")
    nested = J.nest(table(spark, d, "nation").select("n_nationkey", "n_name"), s, "n_nationkey", ["s_name"], ["s_suppkey"])
    return nested.select("n_nationkey", "n_name", F.size("children").cast("long").alias("n"), F.array_join(F.transform("children", lambda x: x["s_name"]), ",").alias("children"))


@register("allow_list_merge", """SELECT p_partkey, CASE WHEN p_size > 30 AND p_partkey % 3 <> 0 THEN p_name ELSE 'Part ' || p_partkey END AS label FROM part""")
def allow_list_merge(spark, d):
    part = table(spark, d, "part")
    output = part.where("p_size > 30").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("").alias("label")).unionByName(spark.createDataFrame([(-1, "unknown")], "p_partkey long, label string"))
    return J.allow_list(part.select("p_partkey"), output, "p_partkey", "label", F.concat(F.lit("Part "), "p_partkey"))


@register("insert_if_absent", """WITH old AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), new AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM old)""")
def insert_if_absent(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = R.first_per_group(o.where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderkey"])
    return S.insert_if_absent(old, o.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@register("upsert_latest", """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, CAST(sum(new) OVER (PARTITION BY user_id) AS BIGINT) AS changes FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, d):
    return S.latest_of_log(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id", "event_type", "changes")


@register("uniqueness_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, d):
    from ..io import assert_unique

    return assert_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R")


# -- grading: lineitem rows are answers, part attributes the keys


@register("rubric_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CAST(l_quantity > 10 AS INTEGER) + CAST(l_discount > 0.04 AS INTEGER) + CAST(l_tax > 0.04 AS INTEGER)) / 3 AS score FROM lineitem")
def rubric_score(spark, d):
    hits = F.array(F.col("l_quantity") > 10, F.col("l_discount") > 0.04, F.col("l_tax") > 0.04)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.rubric(hits, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("score"))


@register("mcq_grade", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = l_partkey % 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM lineitem")
def mcq_grade(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.mcq(F.col("l_linenumber") % 4, F.col("l_partkey") % 4).alias("score"))


@register("fill_blank_grade", r"""SELECT p_partkey, CASE WHEN lower(trim(regexp_replace('  ' || upper(p_type) || '  ', '\s+', ' ', 'g'))) IN (lower(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END), lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'x' END)) THEN 1.0
WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN 0.5 WHEN p_size % 4 = 2 THEN 1.0 END::DOUBLE AS score FROM part""")
def fill_blank_grade(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size") % 4
    answer = F.concat(F.lit("  "), F.upper("p_type"), F.lit("  "))
    correct, others = F.when(key % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")), F.array(F.when(key % 3 == 0, F.col("p_type")).otherwise("x"))
    judged = F.when(size == 0, 0.0).when(size == 1, 0.5).when(size == 2, 1.0).otherwise(0.7)
    return table(spark, d, "part").select("p_partkey", G.fill_blank(answer, correct, others, F.when(key % 5 == 0, "code").otherwise("concept"), judged).alias("score"))


@register("output_validators", r"""WITH p AS (SELECT item_id, text, string_split(text, '. ') AS parts FROM benchmark)
SELECT item_id, len(parts) >= 2 AND item_id % 5 < len(parts) AS mcq, trim(text) <> '' AND trim(parts[1]) <> '' AND len(parts) BETWEEN 2 AND 4 AND len(list_filter(parts, lambda x: trim(x) = '')) = 0 AS short,
CASE item_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'concept' ELSE 'other' END IN ('code', 'concept') AND contains(replace(text, 'the ', '___ '), '___') AND trim(parts[1]) <> '' AS blank FROM p""")
def output_validators(spark, d):
    parts, i = F.split("text", r"\. "), F.col("item_id")
    mode = F.when(i % 3 == 0, "code").when(i % 3 == 1, "concept").otherwise("other")
    return table(spark, d, "benchmark").select("item_id", G.valid_mcq(parts, i % 5).alias("mcq"), G.valid_short(F.col("text"), F.get(parts, F.lit(0)), parts).alias("short"), G.valid_blank(mode, F.replace("text", F.lit("the "), F.lit("___ ")), F.get(parts, F.lit(0))).alias("blank"))


@register("answer_dispatch", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber % 4 = l_partkey % 4 THEN 1.0 ELSE 0.0 END WHEN 'A' THEN {_SCORE} ELSE l_linenumber / 7 END::DOUBLE AS score,
CASE WHEN CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber % 4 = l_partkey % 4 THEN 1.0 ELSE 0.0 END WHEN 'A' THEN {_SCORE} ELSE l_linenumber / 7 END::DOUBLE >= 0.7 THEN 'passed' ELSE 'failed' END AS verdict FROM lineitem""")
def answer_dispatch(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "mcq").when(F.col("l_returnflag") == "A", "fill_blank").otherwise("short_answer")
    blank = F.when(F.col("l_quantity") <= 15, 0.0).when(F.col("l_quantity") <= 30, 0.5).otherwise(1.0)
    score = G.graded(kind, G.mcq(F.col("l_linenumber") % 4, F.col("l_partkey") % 4), blank, F.col("l_linenumber") / 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score")).withColumn("verdict", G.judged_once(F.col("score")))
