"""Job 2: how well transcripts are heard, with and without vocabulary hints.

    python -m jobs.transcripts --conversations PATH --output PATH [--config jobs/transcripts.json]

A turn of a user or assistant is a reference and the next turn of its conversation what a backend heard.
The settings backend, hinted and category are SQL expressions over conversations(conv_id, turn, role, text). Writes

* scores/backend=B/category=C: conv_id, turn, hinted, wer, recall, tokens, one row for each pair of turns;
* report/backend=B: each category and 'all': turns, means and medians without and with hints, and the difference;
* table: the report as Markdown, one text file.

Only partitions that the run has rows for are replaced (a run over some `backends` leaves the others), and the report
is of all scores there are, so that a run can be repeated, or carried on backend by backend, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, told
from quillforge.functions import text as X
from quillforge.io import importable, many_parts
from quillforge.operators import aggregates as A
from quillforge.sources import sinks

DEFAULTS = {"backend": "CASE WHEN conv_id % 2 = 0 THEN 'local' ELSE 'hosted' END", "hinted": "turn % 4 < 2", "category": "role", "least_identifier": 4, "backends": []}
SCORES = "conv_id long, turn int, hinted boolean, wer double, recall double, tokens int, backend string, category string"
REPORT = ", ".join(["category string", "n_plain long", "n_hinted long", *[f"{m}_{k} double" for m in ("wer", "recall") for k in ("plain", "hinted", "change")], "tokens_p50_plain int", "tokens_p50_hinted int", "backend string"])


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, ..., ref, hyp): each turn with the next; joined by conversation and number, so that a long conversation is no single task's. A null text is empty.

    Turns are dealt to many tasks first: comparing two of them takes time by their words, and a table of few bytes would be one task.
    """
    spoken = turns.where("role IN ('user', 'assistant')").repartition(many_parts(turns.sparkSession), "conv_id", "turn").withColumn("ref", X.fold_accents(F.coalesce("text", F.lit(""))))
    following = spoken.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp"))
    return spoken.join(following, ["conv_id", "turn"])


def scored(turns: DataFrame, settings: dict) -> DataFrame:
    """The rows of the table scores."""
    ref, hyp = X.spoken_tokens(F.col("ref")), X.spoken_tokens(F.col("hyp"))
    named = turns.withColumns({c: F.expr(settings[c]) for c in ("backend", "hinted", "category")})
    if settings["backends"]:
        named = named.where(F.col("backend").isin(settings["backends"]))
    rows = pairs(named).select("conv_id", "turn", "hinted", "backend", "category", ref.alias("r"), hyp.alias("h"))
    known = F.filter("r", lambda t: F.length(t) >= int(settings["least_identifier"]))
    return rows.select(
        "conv_id", "turn", "hinted", F.round(X.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"), F.round(X.identifier_recall(known, F.col("h")), 6).alias("recall"),
        F.size("r").alias("tokens"), "backend", "category",
    )


def read_scores(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(f"{output}/scores")


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output}/report")


def whole_output(spark: SparkSession, output: str) -> DataFrame:
    """The rows of both tables; the columns that one of them lacks are null."""
    return read_scores(spark, output).withColumn("part", F.lit("score")).unionByName(read_report(spark, output).withColumn("part", F.lit("report")), allowMissingColumns=True)


def run(spark: SparkSession, conversations: str, output: str, settings: dict = DEFAULTS) -> dict:
    """Scores the turns that the settings pick and renews the report. How many rows it read and wrote."""
    importable(spark)
    turns = spark.read.parquet(conversations).select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    n = told(turns, "read", conversations)
    scored(turns, settings).hint("rebalance", "backend", "category").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backend", "category").parquet(f"{output}/scores")
    scores = read_scores(spark, output)
    m = told(scores, "holds", f"{output}/scores")
    report = A.compared(scores, ["backend"], "category", "hinted", ["wer", "recall"], "tokens")
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backend").parquet(f"{output}/report")
    k = told(read_report(spark, output), "holds", f"{output}/report")
    shown = ["backend", "category", "n_plain", "n_hinted", "wer_plain", "wer_hinted", "wer_change", "recall_plain", "recall_hinted", "recall_change"]
    sinks.report_markdown(read_report(spark, output), shown, ["backend", "category"]).coalesce(1).write.mode("overwrite").text(f"{output}/table")
    log.info("wrote %s", f"{output}/table")
    return {"turns": n, "scores": m, "report": k}


if __name__ == "__main__":
    main("transcripts", ["conversations", "output"], DEFAULTS, run)
