"""First, latest, prioritised, interleaved, chunked and capped rows. Every cap has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..io import global_position, written


def first_per_group(df: DataFrame, keys: list, order: list) -> DataFrame:
    """WIN-02..06: the first row of each group; order must be total (end it in a unique column)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def latest_per_group(df: DataFrame, keys: list, at: str, tie: str) -> DataFrame:
    """WIN-01: the latest row of each group; among equals the least tie. Rows without a time don't count."""
    return first_per_group(df.where(F.col(at).isNotNull()), keys, [F.col(at).desc(), F.col(tie).asc()])


def round_robin(df: DataFrame, tier: Column, bucket: Column, order: list, name: str = "position", most: int | None = None) -> DataFrame:
    """WIN-07: tier by tier, one row of each bucket (in order of buckets, null as '') in every round; order must be total.

    With `most`, only the first so many: each bucket hands on that many of its rows
    at most, cut before the shuffle. Without, rows are numbered in their bucket by
    sorted ranges, so that a bucket of any size is no single task's.
    """
    df = df.withColumns({"_tier": tier, "_bucket": F.coalesce(bucket.cast("string"), F.lit(""))})
    if most is not None:
        first = df.withColumn("_round", F.row_number().over(Window.partitionBy("_tier", "_bucket").orderBy(*order))).where(F.col("_round") <= most)
        return top(first, ["_tier", "_round", "_bucket"], most, name).drop("_tier", "_bucket", "_round")
    placed = position_in_group(df, ["_tier", "_bucket"], order, "_round")
    return global_position(placed, ["_tier", "_round", "_bucket"], name).drop("_tier", "_bucket", "_round")


def position_in_group(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Each row's place, from 1, in its group (null keys are a group too), without a task for each group: the place among all rows less that of the group's first."""
    placed = written(global_position(df, [*keys, *order], "_place"), "placed")
    begins = placed.groupBy(*keys).agg(F.min("_place").alias("_begin")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return placed.join(begins, same).withColumn(name, F.col("_place") - F.col("_begin") + 1).select(*df.columns, name)


def top(df: DataFrame, order: list, n: int, name: str = "position") -> DataFrame:
    """TOP-*: the first n rows of the total order with their places; only n rows of each partition are sent."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def chunk(df: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """WIN-08: (group, chunk_index, n) for the groups' rows in chunks of `size`; a row whose `is_unit` is false only makes its group known. Units are numbered by sorted ranges, so a group of any size is no single task's; order must be total within a group."""
    units = position_in_group(df.where("is_unit"), [group], order, "_n")
    full = units.groupBy(group, F.ceil(F.col("_n") / size).cast("int").alias("chunk_index")).agg(F.count("*").alias("n"))
    known = df.groupBy(group).agg(F.coalesce(F.max("is_unit"), F.lit(False)).alias("_any")).where("NOT _any")
    return full.unionByName(known.select(group, F.lit(1).alias("chunk_index"), F.lit(0).cast("long").alias("n")))


def count_chunks(chunks: DataFrame, group: str) -> DataFrame:
    return chunks.withColumn("chunk_count", F.count("*").over(Window.partitionBy(group)))


def capped_chunks(chunks: DataFrame, group: str, most: int) -> DataFrame:
    """WIN-09: only the first `most` chunks in order of groups; counts are of those emitted."""
    return count_chunks(chunks.orderBy(group, "chunk_index").limit(most), group)


def take_while_total(df: DataFrame, keys: list, order: list, cost: Column, most: int) -> DataFrame:
    """WIN-15: rows as long as the running total stays within `most` (costs are positive, so all after the first overrun go)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_total", F.sum(cost).over(w)).where(F.col("_total") <= most).drop("_total")


def guard_archive(df: DataFrame, keys: list, size: str, path: str, max_files: int, max_bytes: int) -> DataFrame:
    """SRC-03: one row for each archive of entries: ok, or the first rule that it breaks: too many files, too large (sizes are not negative), a path outside. Sums only, so no archive is one task's."""
    part = F.split(F.col(path), "/")
    outside = F.col(path).startswith("/") | (F.aggregate(part, F.lit(0), lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).when(p.isin("", "."), d).otherwise(d + 1)) < 0)
    found = df.groupBy(*keys).agg(F.count("*").alias("entries"), F.sum(size).alias("total"), F.max(outside.cast("int")).alias("_outside"))
    verdict = F.when(F.col("entries") > max_files, "too many files").when(F.col("total") > max_bytes, "too large").when(F.col("_outside") == 1, "outside").otherwise("ok")
    return found.withColumn("verdict", verdict).drop("_outside")


def page(df: DataFrame, order: list, n: int) -> DataFrame:
    """TOP-02, AGG-01: the first n rows of 1 to 100, and with each the count of all."""
    if not 1 <= n <= 100:
        raise ValueError("a page has 1 to 100 rows")
    return df.orderBy(*order).limit(n).withColumn("total", df.agg(F.count("*")).scalar())


def alternate(df: DataFrame, position: str) -> DataFrame:
    """WIN-10: which half each row belongs to by its place."""
    return df.withColumn("half", F.pmod(F.col(position) - 1, F.lit(2)).cast("int"))
