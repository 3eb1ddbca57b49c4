"""Model calls as pluggable functions: one row at a time, or a whole bounded set, with typed output and a canned provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..io import importable, stored


class Provider(Protocol):
    """UDF-01, UDF-03: answers a prompt; opened once in each task."""

    def complete(self, system: str, message: str) -> str: ...


class Canned:
    """A provider for tests: a rule from message to answer."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def complete(self, system: str, message: str) -> str:
        return self.rule(message)


def per_row(rows: DataFrame, key: str, message: str, open_provider: Callable[[], Provider], system: str) -> DataFrame:
    """UDF-04: (key, answer) of a call for each row; a call that fails gives null, so that only its row is lost."""
    importable(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = open_provider()

        def ask(text):
            try:
                return provider.complete(system, text)
            except Exception:  # a provider's errors are its own
                return None

        for batch in batches:
            yield pd.DataFrame({key: batch[key], "answer": [ask(t) for t in batch[message]]})

    return rows.select(key, message).mapInPandas(run, f"{key} {kind}, answer string")


def call_key(message: Column, system: str, version: str, model: str) -> Column:
    """UDF-05: what an answer depends on, as one hash: prompt version, model, instructions and input. A null input is not the empty one."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), F.lit(model).alias("m"), F.lit(system).alias("s"), message.alias("t"))), 256)


def cached(rows: DataFrame, key: str, message: str, open_provider: Callable[[], Provider], system: str, version: str, model: str, cache: str, most_calls_at_once: int = 64) -> DataFrame:
    """UDF-05, SNK-04: (key, answer) for each row, answered from the Parquet folder `cache` (call, answer) where that has the call.

    Equal inputs are one call; only calls that the cache lacks are made, by most_calls_at_once
    tasks at most, and their answers appended. A call that fails is not stored, and so is made
    again by the next run. Where two runs have stored one call, the least answer counts.
    """
    spark = rows.sparkSession
    asked = rows.select(key, F.col(message).alias("_message"), call_key(F.col(message), system, version, model).alias("call"))
    store = lambda: spark.read.schema("call string, answer string").parquet(cache)
    missing = asked.select("call", "_message").dropDuplicates(["call"])
    if stored(spark, cache):
        missing = missing.join(store().select("call").distinct(), "call", "left_anti")
    made = per_row(missing.repartition(most_calls_at_once, "call"), "call", "_message", open_provider, system)
    made.where("answer IS NOT NULL").write.mode("append").parquet(cache)
    return asked.join(store().groupBy("call").agg(F.min("answer").alias("answer")), "call", "left").select(key, "answer")


def observed(answers: DataFrame, name: str, answer: str = "answer") -> tuple[DataFrame, Observation]:
    """STM-09: the answers, and what is counted while they are made: calls, failed ones, and characters; to be read once they have been written."""
    counts = Observation(name)
    return answers.observe(counts, *call_metrics(answer)), counts


def call_metrics(answer: str) -> list[Column]:
    a = F.col(answer)
    return [F.count(F.lit(1)).alias("calls"), F.count_if(a.isNull()).alias("failed"), F.coalesce(F.sum(F.char_length(a)), F.lit(0)).alias("chars")]


def require_parsed(answers: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """UDF-02: answers as typed columns; rows that don't parse or lack a required field go."""
    parsed = answers.withColumn("_p", F.from_json("answer", schema)).where("_p IS NOT NULL")
    for name in required:
        parsed = parsed.where(F.col(f"_p.{name}").isNotNull())
    return parsed.select("*", "_p.*").drop("_p", "answer")


def whole(rows: DataFrame, message: str, order: list[str], open_provider: Callable[[], Provider], system: str, most_rows: int = 500) -> DataFrame:
    """UDF-05: one call over a set bounded by most_rows, in order."""
    lines = rows.orderBy(*order).limit(most_rows).select(*order, F.col(message).alias("line"))
    text = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("message")).withColumn("id", F.lit(1))
    return per_row(text, "id", "message", open_provider, system)
