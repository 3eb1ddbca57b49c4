"""Mastery, scores, percentiles, grouped reports and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import latest_per_group

UNGROUPED = "__ungrouped__"


def per_attempt(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """AGG-06, WIN-01, JON-01: (key, attempt_id, completed_at, answered, total) of each quiz's latest attempt.

    attempts(attempt_id, quiz_id, completed_at), answers(attempt_id, key, score);
    answers without a score don't count, an empty or null key is UNGROUPED.
    """
    counted = latest_per_group(attempts, ["quiz_id"], "completed_at", "attempt_id")
    answers = answers.where("score IS NOT NULL").withColumn("key", F.coalesce(F.nullif("key", F.lit("")), F.lit(UNGROUPED)))
    return answers.join(counted.select("attempt_id", "completed_at"), "attempt_id").groupBy("key", "attempt_id", "completed_at").agg(F.count("*").alias("answered"), F.sum("score").alias("total"))


def mastery(attempts: DataFrame, answers: DataFrame, names: DataFrame) -> DataFrame:
    """AGG-05, MAP-01, TOP-09: (key, name, attempts, answered, average, ordinal), weakest first, ungrouped last."""
    per_key = per_attempt(attempts, answers).groupBy("key").agg(F.count("*").alias("attempts"), F.sum("answered").alias("answered"), (F.sum("total") / F.sum("answered")).alias("average"))
    named = per_key.join(names, "key", "left").withColumn("name", F.coalesce("name", "key"))
    place = F.row_number().over(Window.orderBy(F.col("key") == UNGROUPED, "average", "key"))  # topics, not rows
    return named.select("key", "name", "attempts", "answered", "average", place.alias("ordinal"))


def mastery_history(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """AGG-06: a row for each key and attempt."""
    return per_attempt(attempts, answers).select("key", "attempt_id", "completed_at", "answered", (F.col("total") / F.col("answered")).alias("average"))


def mastery_trend(history: DataFrame) -> DataFrame:
    """WIN-12: points from the first to the last average in whole hundredths, half up; null for one point."""
    at = F.struct("completed_at", "attempt_id")
    per_key = history.groupBy("key").agg(F.count("*").alias("points"), F.min_by("average", at).alias("first"), F.max_by("average", at).alias("last"))
    return per_key.withColumn("delta", F.when(F.col("points") > 1, half_up(100 * (F.col("last") - F.col("first")))))


def half_up(x: Column) -> Column:
    """MTH-01: rounds as floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def attempt_scores(attempts: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """AGG-07: score over all questions of an attempt, those without an answer as 0; no question gives 0.

    questions(attempt_id, question_id), answers(attempt_id, question_id, score).
    """
    q = questions.join(answers, ["attempt_id", "question_id"], "left").groupBy("attempt_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("_sum"), F.count("*").alias("questions"), F.count("score").alias("answered"))
    out = attempts.select("attempt_id").join(q, "attempt_id", "left")
    return out.select("attempt_id", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce(F.col("_sum") / F.col("questions"), F.lit(0.0)).alias("score"))


def next_version(parents: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """AGG-03: the greatest version and one, 1 where there is none."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    return parents.select(key).join(top, key, "left").select(key, (F.coalesce("_top", F.lit(0)) + 1).alias("next_version"))


def counts_with_zero(parents: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """AGG-02: how many rows each parent has, 0 for none."""
    return parents.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def share_report(df: DataFrame, key: str) -> DataFrame:
    """AGG-04: count of each value and of all rows, undetected ones (null) only in the total."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("total", df.agg(F.count("*")).scalar())


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """AGG-13: for each group the value at index round-half-even(share * (n - 1)) of the ascending ones; null for none.

    Rows are counted by value before anything is ordered, so a window sees one row
    for each distinct value of a group, however many rows the group has.
    """
    w = Window.partitionBy(*keys)
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    upto = counts.withColumns({"_z": F.sum("_c").over(w.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    at = lambda p: F.bround(F.lit(p) * (F.col("_n") - 1)).cast("long")
    return upto.groupBy(*keys).agg(*[F.min(F.when((F.col("_c") > 0) & (F.col("_z") > at(p)), F.col(value))).alias(n) for n, p in shares.items()])


def report(scores: DataFrame, outer: list[str], inner: str, p50: str = "latency_p50", p95: str = "latency_p95") -> DataFrame:
    """AGG-12..14: means and percentiles by (outer, inner) and by outer alone, labelled 'all'.

    scores has wer, recall (may be null), latency, cost (may be null). Each group
    set is aggregated from one expanded input.
    """
    labelled = scores.withColumn("label", F.explode(F.array(F.col(inner), F.lit("all"))))
    keys = [*outer, "label"]
    sums = labelled.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("wer"), 6).alias("mean_wer"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.sum("cost"), 6).alias("total_cost"))
    return sums.join(nearest_rank(labelled, keys, "latency", {p50: 0.5, p95: 0.95}), keys)


def compared(scores: DataFrame, outer: list[str], inner: str, flag: str, means: list[str], median: str) -> DataFrame:
    """SNK-08: by (outer, inner) and by outer alone ('all'), side by side without and with `flag` (plain, hinted): rows, means, their change, and a median.

    A measure that one side lacks is null there, and so is the change.
    """
    sides = {"plain": ~F.col(flag), "hinted": F.col(flag)}
    labelled = scores.withColumn(inner, F.explode(F.array(F.col(inner), F.lit("all"))))
    keys = [*outer, inner]
    sums = labelled.groupBy(*keys).agg(*[F.count_if(on).alias(f"n_{s}") for s, on in sides.items()], *[F.avg(F.when(on, F.col(m))).alias(f"_{m}_{s}") for m in means for s, on in sides.items()])
    shown = [c for m in means for c in (F.round(f"_{m}_plain", 6).alias(f"{m}_plain"), F.round(f"_{m}_hinted", 6).alias(f"{m}_hinted"), F.round(F.col(f"_{m}_hinted") - F.col(f"_{m}_plain"), 6).alias(f"{m}_change"))]
    half = nearest_rank(labelled.select(*keys, flag, median), [*keys, flag], median, {"p50": 0.5})
    halves = half.groupBy(*keys).agg(*[F.max(F.when(on, F.col("p50"))).alias(f"{median}_p50_{s}") for s, on in sides.items()])
    return sums.join(halves, keys).select(*keys, *[f"n_{s}" for s in sides], *shown, *[f"{median}_p50_{s}" for s in sides])


def cost(rate_per: dict[str, float], model: str, amount: str, per: float) -> Column:
    """AGG-20: rate of the model times amount / per, to 6 places; null for an unknown model or amount."""
    rates = F.create_map(*[F.lit(x) for kv in rate_per.items() for x in kv])
    return F.round(F.try_element_at(rates, F.col(model)) * F.col(amount) / F.lit(per), 6)
