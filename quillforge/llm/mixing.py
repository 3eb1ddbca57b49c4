"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment (DataFrame and SQL functions only).

Sizes are words. Sources share 150 % of all words by weight; a source's target
stops at twice its size and the excess is shared anew. The target is allocated in
blocks of equal words by the highest quotients target / (2 k + 1), first to the
sources, then within a source to its shards by their sizes. Only quotients near
the cut are formed: three rows for each source or shard, however many blocks there
are. What a source's blocks lack of its target, or have too much, its shards give in
words, one after the other, so that sources smaller than a block get theirs too. In a
shard, documents lie in seeded order and the quota is a seeded run of
blocks that wraps around, after whole rounds where it exceeds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (3, 1, 2)
#: Words that a shard of a source has at most, about, once there are more than the least number of shards.
SHARD_WORDS = 1 << 28

#: Each step is a view over earlier ones; {x} are parameters. `sized` has doc_id, source, size, h.
_STEPS = [
    ("cells", "SELECT source, shard, sum(size) AS cell_size FROM (SELECT source, size, pmod(CAST(conv(substr(h, 1, 8), 16, 10) AS BIGINT), {shards}) AS shard FROM sized) GROUP BY source, shard"),
    ("ranked", "SELECT source, source_size, element_at(array({weights}), CAST(pmod(row_number() OVER (ORDER BY source NULLS LAST) - 1, {n_weights}) AS INT) + 1) AS w FROM (SELECT source, sum(cell_size) AS source_size FROM cells GROUP BY source)"),
    ("filled", "SELECT *, 1.5D * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum(2 * source_size) OVER before, 0) AS cap_before, coalesce(sum(w) OVER before, 0) AS w_before FROM ranked WINDOW before AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    ("capped", "SELECT *, (total - cap_before) / (all_w - w_before) > CAST(2 * source_size AS DOUBLE) / w AS full FROM filled"),
    ("targets", "SELECT source, source_size, total, CASE WHEN full THEN CAST(2 * source_size AS DOUBLE) ELSE (total - sum(CASE WHEN full THEN 2 * source_size ELSE 0 END) OVER ()) / nullif(all_w - sum(CASE WHEN full THEN w ELSE 0 END) OVER (), 0) * w END AS target, CAST(floor(total / {block} + 0.5D) AS BIGINT) AS n, count(*) OVER () AS m FROM capped"),
    ("ideal", "SELECT *, CASE WHEN n > 0 THEN n * (target / total) ELSE 0D END AS q, CASE WHEN n > 0 THEN m / (2D * n) ELSE 0D END AS slack FROM targets"),
    ("floors", "SELECT *, CAST(greatest(floor(q * (1 - slack) - 0.5D), 0) AS BIGINT) AS a, CAST(ceil(q * (1 + slack) + 1.5D) AS BIGINT) AS z FROM ideal"),
    ("quotients", "SELECT source, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS rank, n - sum_a AS seats FROM (SELECT *, explode(sequence(a, z)) AS k FROM (SELECT *, sum(a) OVER () AS sum_a FROM floors))"),
    ("won", "SELECT source AS s, count(*) AS more FROM quotients WHERE rank <= seats GROUP BY source"),
    ("quotas", "SELECT f.source, f.source_size, f.target, f.a + coalesce(w.more, 0) AS quota FROM floors f LEFT JOIN won w ON f.source <=> w.s"),
    ("shares", "SELECT c.source, c.shard, c.cell_size, q.source_size, q.target, q.quota, count(*) OVER (PARTITION BY c.source) AS m, CASE WHEN q.source_size > 0 THEN q.quota * (c.cell_size / CAST(q.source_size AS DOUBLE)) ELSE 0D END AS q FROM cells c JOIN quotas q ON c.source <=> q.source"),
    ("shard_floors", "SELECT *, CAST(greatest(floor(q * (1 - slack) - 0.5D), 0) AS BIGINT) AS a, CAST(ceil(q * (1 + slack) + 1.5D) AS BIGINT) AS z FROM (SELECT *, CASE WHEN quota > 0 THEN m / (2D * quota) ELSE 0D END AS slack FROM shares)"),
    ("shard_quotients", "SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY CAST(cell_size AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS rank, quota - sum_a AS seats FROM (SELECT *, explode(sequence(a, z)) AS k FROM (SELECT *, sum(a) OVER (PARTITION BY source) AS sum_a FROM shard_floors))"),
    ("shard_won", "SELECT source AS s, shard AS t, count(*) AS more FROM shard_quotients WHERE rank <= seats GROUP BY source, shard"),
    ("block_words", "SELECT f.source, f.shard, f.cell_size, f.source_size, f.target, least((f.a + coalesce(w.more, 0)) * {block}, 2 * f.cell_size) AS words FROM shard_floors f LEFT JOIN shard_won w ON f.source <=> w.s AND f.shard = w.t"),
    ("owed", "SELECT *, CAST(floor(target + 0.5D) AS BIGINT) - sum(words) OVER (PARTITION BY source) AS rest, coalesce(sum(2 * cell_size - words) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before, coalesce(sum(words) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM block_words"),
    ("finished", "SELECT source, shard, cell_size, source_size, target, words + CASE WHEN rest >= 0 THEN least(greatest(rest - room_before, 0), 2 * cell_size - words) ELSE -least(greatest(-rest - words_before, 0), words) END AS quota_words FROM owed"),
    (
        "runs",
        "SELECT source, shard, cell_size, source_size, target, CAST(quota_words AS BIGINT) AS quota_words, "
        "pmod(CAST(conv(substr(md5(concat('{seed}/', coalesce(source, ''), '/', shard)), 1, 8), 16, 10) AS BIGINT), greatest(CAST(ceil(cell_size / CAST({block} AS DOUBLE)) AS BIGINT), 1)) * {block} AS start FROM finished",
    ),
]


#: Steps that are written: small tables (a row for each source and shard) that several others read, so that plans stay short.
_WRITTEN = ("cells", "floors", "shard_floors", "runs")


def _upto(spark: SparkSession, last: str, made: dict[str, DataFrame], values: dict) -> DataFrame:
    """The step `last`, from the tables made so far."""
    names = [name for name, _ in _STEPS]
    begin = max([names.index(m) + 1 for m in made if m in names], default=0)
    tables = [f"{m} AS (SELECT * FROM {{{m}_df}})" for m in made]
    steps = [f"{name} AS ({sql.format(**values)})" for name, sql in _STEPS[begin : names.index(last) + 1]]
    return spark.sql("WITH " + ",\n".join([*tables, *steps]) + f"\nSELECT * FROM {last}", **{f"{m}_df": df for m, df in made.items()})


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 32, least_shards: int = 16, seed: str = "mix", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) and the columns `also` for each row of docs(doc_id, text, source).

    taken is the number of words that the mix takes of a document, repeats
    counted: 0 to twice its size. A null text has size 0; a null source is a
    source of its own, the last. Equal rows are told apart by nothing, so one or
    the other may be taken. Other columns are left out. An empty table, or one
    without words, gives targets of 0.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), *also).withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "sizes",
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(least_shards, total // SHARD_WORDS)
    values = {"shards": shards, "weights": ", ".join(map(str, weights)), "n_weights": len(weights), "block": block, "seed": seed}
    made = {"sized": sized}
    for last in _WRITTEN:
        made[last] = written(_upto(spark, last, made, values), last)
    runs = made["runs"]
    placed = spark.sql(
        f"""
        SELECT {", ".join(["doc_id", "source", "size", "shard", *also])}, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
        FROM (SELECT *, pmod(CAST(conv(substr(h, 1, 8), 16, 10) AS BIGINT), {shards}) AS shard FROM {{sized_df}})
        """,
        sized_df=sized,
    )
    joined = placed.join(runs.withColumnsRenamed({"source": "s", "shard": "t"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("t")))
    cell = F.greatest("cell_size", F.lit(1))
    rest = F.col("quota_words") % cell
    end = F.col("start") + rest
    ahead = F.greatest(F.least(F.col("at") + F.col("size"), end) - F.greatest("at", "start"), F.lit(0))
    wrapped = F.greatest(F.least(F.col("at") + F.col("size"), end - F.col("cell_size")) - F.col("at"), F.lit(0))
    rounds = F.floor(F.col("quota_words") / cell)
    taken = F.when(F.col("cell_size") > 0, rounds * F.col("size") + ahead + wrapped).otherwise(0).cast("long")
    return joined.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"), "source", *also)


def _twin() -> str:
    """The same in DuckDB's dialect, with the production parameters."""
    number = lambda h: f"CAST(('0x' || substr({h}, 1, 8)) AS BIGINT)"
    sized = "SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents"
    steps = [("sized", sized), ("shape", f"SELECT greatest(16, coalesce(CAST(sum(size) AS BIGINT), 0) // {SHARD_WORDS}) AS shards FROM sized")]
    steps.append(("dealt", f"SELECT *, {number('h')} % (SELECT shards FROM shape) AS shard FROM sized"))
    steps.append(("cells", "SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM dealt GROUP BY source, shard"))
    steps.append(("ranked", "SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, CAST(sum(cell_size) AS BIGINT) AS source_size FROM cells GROUP BY source)"))
    swap = [("{block}", "32"), ("1.5D", "CAST(1.5 AS DOUBLE)"), ("0.5D", "CAST(0.5 AS DOUBLE)"), ("1.5D", "CAST(1.5 AS DOUBLE)"), ("2D", "CAST(2 AS DOUBLE)"), ("0D", "CAST(0 AS DOUBLE)"), ("explode(sequence(a, z))", "unnest(range(a, z + 1))"), ("<=>", "IS NOT DISTINCT FROM"), ("OVER before", "OVER earlier"), ("WINDOW before", "WINDOW earlier"), ("sum(2 * source_size)", "CAST(sum(2 * source_size) AS BIGINT)")]
    for name, sql in _STEPS[2:-1]:
        for a, b in swap:
            sql = sql.replace(a, b)
        if name == "filled":
            sql = "SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w, coalesce(CAST(sum(2 * source_size) OVER earlier AS BIGINT), 0) AS cap_before, coalesce(CAST(sum(w) OVER earlier AS BIGINT), 0) AS w_before FROM ranked WINDOW earlier AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        if name == "targets":
            sql = "SELECT source, source_size, total, CASE WHEN full_up THEN CAST(2 * source_size AS DOUBLE) ELSE (total - CAST(sum(CASE WHEN full_up THEN 2 * source_size ELSE 0 END) OVER () AS BIGINT)) / nullif(all_w - CAST(sum(CASE WHEN full_up THEN w ELSE 0 END) OVER () AS BIGINT), 0) * w END AS target, CAST(floor(total / 32 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS n, count(*) OVER () AS m FROM capped"
        if name == "capped":
            sql = "SELECT *, (total - cap_before) / (all_w - w_before) > CAST(2 * source_size AS DOUBLE) / w AS full_up FROM filled"
        steps.append((name, sql))
    seeded = number("md5('mix/' || coalesce(source, '') || '/' || shard)")
    steps.append(("runs", f"SELECT source, shard, cell_size, source_size, target, CAST(quota_words AS BIGINT) AS quota_words, ({seeded} % greatest(CAST(ceil(cell_size / CAST(32 AS DOUBLE)) AS BIGINT), 1)) * 32 AS start FROM finished"))
    steps.append(("placed", "SELECT doc_id, source, size, shard, coalesce(CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at_word FROM dealt"))
    steps.append(("met", "SELECT p.doc_id, p.size, p.at_word, r.source_size, r.target, r.cell_size, r.start, r.quota_words // greatest(r.cell_size, 1) AS rounds, r.start + r.quota_words % greatest(r.cell_size, 1) AS stop FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard"))
    last = "SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, coalesce(target, 0) AS target, CAST(CASE WHEN cell_size > 0 THEN rounds * size + greatest(least(at_word + size, stop) - greatest(at_word, start), 0) + greatest(least(at_word + size, stop - cell_size) - at_word, 0) ELSE 0 END AS BIGINT) AS taken FROM met"
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in steps) + "\n" + last


ORACLE_SQL = _twin()
