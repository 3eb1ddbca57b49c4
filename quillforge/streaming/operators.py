"""Rate limits, redelivery, states and progress, over event logs and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..io import stored

#: STM-03: the states in order; failed never replaces ready.
STAGES = ["pending", "parsing", "analyzing", "generating"]
TERMINAL = ["ready", "failed"]


def hour_key(at: Column) -> Column:
    """DAT-03."""
    return F.date_format(at, "yyyyMMddHH")


def within_limit(events: DataFrame, user: str, at: str, tie: str, limit: int) -> DataFrame:
    """STM-04 over a log: each event's number within its user's hour, and whether it is allowed."""
    w = Window.partitionBy(user, hour_key(F.col(at))).orderBy(at, tie)
    return events.withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= limit)


def hourly_counts(stream: DataFrame, user: str, at: str, late: str = "1 hour") -> DataFrame:
    """STM-04 as a stream: events of each user and hour; an hour is given out when the watermark has passed it (update mode: at once)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("hour"), user).agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """STM-06: a redelivered event passes once."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def final_status(log: DataFrame, key: str, at: str, tie: str, status: str = "status") -> DataFrame:
    """STM-03, STM-08: (key, status, stage): ready if ever reached, else failed if that came, else the last; stage is the place of the last state that is not terminal."""
    order = F.struct(F.col(at), F.col(tie))
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col(status)).cast("int") - 1
    g = log.groupBy(key).agg(
        F.max((F.col(status) == "ready").cast("int")).alias("_ready"), F.max((F.col(status) == "failed").cast("int")).alias("_failed"),
        F.max_by(F.col(status), order).alias("_last"), F.max_by(rank, F.when(rank >= 0, order)).alias("stage"),
    )
    return g.select(key, F.when(F.col("_ready") == 1, "ready").when(F.col("_failed") == 1, "failed").otherwise(F.col("_last")).alias("status"), "stage")


def progress(updates: DataFrame, state: DataFrame, key: str, at: str, tie: str, status: str = "status") -> DataFrame:
    """STM-02: what a subscriber sees: the states of stream and table, each once, up to the first terminal one."""
    both = updates.select(key, at, tie, status).unionByName(state.select(key, at, tie, status)).dropDuplicates([key, at, tie, status])
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col(status).isin(TERMINAL).cast("int")).over(w), F.lit(0))
    before = F.lag(status).over(Window.partitionBy(key).orderBy(at, tie))
    return both.withColumns({"_over": over, "_before": before}).where((F.col("_over") == 0) & ~F.col(status).eqNullSafe(F.col("_before"))).drop("_over", "_before")


def status_stream(stream: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """STM-03 as a stream: the status of each key after every batch, kept as state; a batch is taken in the given order."""

    def step(key_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for batch in batches:
            for s in batch.sort_values(order)[status]:
                if now != "ready" and not (now == "failed" and s != "ready"):
                    now = s
        state.update((now,))
        yield pd.DataFrame({key: [key_[0]], "status": [now]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "status string", "update", "NoTimeout")


def expired(expires: Column, now: Column) -> Column:
    """DAT-02: expired when the time is before now; equal is valid."""
    return expires < now


def elapsed_ms(a: Column, b: Column) -> Column:
    """DAT-04: whole milliseconds, cut off."""
    return ((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long")


def day_label(at: Column, now: Column) -> Column:
    """DAT-05: "Today, 14:20", "Yesterday, 09:05" or "3 Aug, 09:05"; a time to come is today's."""
    days = F.datediff(now, at)
    day = F.when(days <= 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(at, "d MMM"))
    return F.concat(day, F.lit(", "), F.date_format(at, "HH:mm"))


def job_outcomes(log: DataFrame, key: str, at: str, tie: str, event: str, now: Column, seconds: int = 1800) -> DataFrame:
    """STM-05: (key, deliveries, outcome): what a queue that delivers at least once makes of each job's events `start` and `done`.

    A start that no `done` follows within `seconds` has timed out and is delivered
    again; a job is done with its first timely `done`, later events change nothing.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = log.withColumn("_start", F.last(F.when(F.col(event) == "start", F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    timely = (F.col(event) == "done") & (F.unix_micros(at) - F.unix_micros("_start") <= seconds * 1_000_000)
    rows = rows.withColumn("_over", F.coalesce(F.max(timely.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.where("_over = 0").groupBy(key).agg(F.count_if(F.col(event) == "start").alias("deliveries"), F.max(timely.cast("int")).alias("_done"), F.max("_start").alias("_last"))
    late = F.unix_micros(now) - F.unix_micros("_last") > seconds * 1_000_000
    return kept.select(key, "deliveries", F.when(F.col("_done") == 1, "done").when(F.col("_last").isNull(), "queued").when(late, "timed out").otherwise("running").alias("outcome"))


def polled(states: DataFrame, key: str, at: str, since: Column, status: str = "status", every: int = 2, most: int = 300) -> DataFrame:
    """STM-07: (key, polls, seen): what a client sees that asks every `every` seconds from `since` on until a state is terminal or `most` seconds are over.

    polls counts the questions up to the first one at or after a terminal state;
    seen is that state, null where the deadline comes first.
    """
    after = F.greatest((F.unix_micros(at) - F.unix_micros(since)) / 1e6, F.lit(0.0))
    ends = states.where(F.col(status).isin(TERMINAL)).groupBy(key).agg(F.min_by(F.struct(F.col(status).alias("s"), F.ceil(after / every).alias("n")), F.col(at)).alias("_e"))
    in_time = F.col("_e.n") * every <= most
    return states.select(key).distinct().join(ends, key, "left").select(key, F.when(in_time, F.col("_e.n") + 1).otherwise(most // every + 1).cast("long").alias("polls"), F.when(in_time, F.col("_e.s")).alias("seen"))


def metered(spark_rows: DataFrame, started: str, ended: str, error: str) -> DataFrame:
    """STM-09: a record for each call: ok or the error, and its duration."""
    return spark_rows.withColumns({"ok": F.col(error).isNull(), "ms": elapsed_ms(F.col(started), F.col(ended))})


def publish(stream: DataFrame, folder: str, state: str, key: str, status: str, error: str):
    """STM-01: a query that appends {status[, error]} messages of each key to a folder that subscribers read as a stream."""
    message = F.to_json(F.struct(F.col(status).alias("status"), F.col(error).alias("error")))
    return stream.select(key, message.alias("message")).writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", state)


def applied(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What apply_once() has written, with the run and batch of each row."""
    return spark.read.schema(StructType([*schema.fields, StructField("run", StringType()), StructField("batch", LongType())])).parquet(path)


def apply_once(stream: DataFrame, path: str, state: str, keys: list[str]):
    """STM-05, STM-06: a query that writes each row of a stream once, whatever is delivered again.

    Each batch has a folder of its own, run=<id of the query, kept in its state>/batch=<number>, which it
    replaces: a batch that comes again after a failure writes the same rows to the same place and takes nothing from others. What
    another batch, or a run whose state is lost, has written by the same keys is passed over; of rows with equal
    keys within a batch one is written. Null keys are equal to each other.
    """
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        new = batch.dropDuplicates(keys)
        if stored(spark, path):
            have = applied(spark, path, schema).where((F.col("run") != run) | (F.col("batch") != number)).select(*[F.col(k).alias(f"_{k}") for k in keys])
            new = new.join(have, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", state)
