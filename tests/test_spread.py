"""Work that a table's few bytes would leave to one task."""

from jobs import transcripts
from pyspark.sql import functions as F
from quillforge import io
from quillforge.operators import extract as E
from quillforge.operators import graph as G
from quillforge.plans import catalog
from quillforge.streaming import stateful as R
from test_queries import SF


def test_files_are_parsed_by_many_tasks(spark):
    files = spark.range(400).select(F.format_string("m%d.ts", "id").alias("path"), F.lit("typescript").alias("language"), F.lit("function f() {}").alias("text")).coalesce(1)
    tasks = E.parse(files).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) >= 2 * spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in tasks) < 100


def test_limits_keep_state_for_shares_not_users(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    calls = spark.range(3000).select(F.col("id").alias("u"), F.timestamp_seconds(F.col("id") % 60 + 1_700_000_000).alias("at"), "id")
    calls.coalesce(1).write.parquet(source)
    with R.keyed_state(spark):
        made = R.limited(spark.readStream.schema(calls.schema).parquet(source), "u", "at", "id", 2)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert 0 < kept <= 4 * 256
    assert spark.read.parquet(out).where("n = 1 AND allowed").count() == 3000


def test_turns_are_compared_by_many_tasks(spark):
    turns = spark.range(400).select((F.col("id") / 8).cast("long").alias("conv_id"), (F.col("id") % 8).cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("a few words").alias("text")).coalesce(1)
    tasks = transcripts.pairs(turns).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 350 and len(tasks) >= 2 * spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in tasks) < 100


def test_drawings_are_read_from_the_lines_once(spark):
    """What follows reads the tables written by then, and each round of the matching is one of them."""
    assert not [f for f in catalog.queries()["drawing_grade"](spark, SF).inputFiles() if "lineitem" in f]
    before = len(io._made)
    assert G.matched(spark.createDataFrame([("q", 1, 10, 1.0)], "q string, id long, drawn long, like double"), "q").count() == 1
    assert len(io._made) - before == 2
