"""Writes that can be repeated: overwriting by key, inserting what lacks, and the latest answer of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..io import stored


def overwrite_by_key(df: DataFrame, path: str, key: str) -> None:
    """SNK-01..03, DML-01: replaces the partitions of the keys that come, leaves the others; doing it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def publish(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """SNK-01..03: writes all tables of a version, and then, as its last step, one row that names it.

    Readers (published()) take the greatest version that is named, so they see all tables of
    one version or of the one before, whenever a write stops. A version that was
    not finished is written again from the start; one that is published is left as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    if version in published_versions(spark, root):
        return
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version long, tables array<string>").coalesce(1).write.mode("append").json(f"{root}/published")


def published_versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, ascending."""
    if not stored(spark, f"{root}/published"):
        return []
    return sorted(r["version"] for r in spark.read.schema("version long").json(f"{root}/published").distinct().collect())


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """SNK-01..03: a table of the last published version, or of an older one."""
    have = published_versions(spark, root)
    if not have or (version is not None and version not in have):
        raise ValueError(f"{root}: version {version} is not published" if have else f"{root}: nothing is published")
    return spark.read.parquet(f"{root}/version={have[-1] if version is None else version}/{name}")


#: What a type may become without a loss.
_WIDER = {"byte": 0, "short": 1, "integer": 2, "long": 3}


def evolved(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, Column]) -> DataFrame:
    """DDL-01: rows of all files below path/schema_version=N, as `schema` says.

    A column that a version's files don't have takes its default (null without one); one that they have
    keeps its values, nulls too. Integers may have become wider, float may have become double; any
    other change of type is refused, and so are files with a column that the schema lacks.
    """
    versions = sorted(r["schema_version"] for r in spark.read.parquet(path).select("schema_version").distinct().collect())  # a handful of folders
    parts = []
    for v in versions:
        df = spark.read.parquet(f"{path}/schema_version={v}")
        own, wanted = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
        if gone := sorted(set(own) - set(wanted)):
            raise ValueError(f"schema_version={v}: {gone} would be lost")
        for name, kind in own.items():
            a, b = kind.typeName(), wanted[name].typeName()
            if kind != wanted[name] and not (_WIDER.get(a, 9) < _WIDER.get(b, -1)) and (a, b) != ("float", "double"):
                raise ValueError(f"schema_version={v}: {name} is {kind.simpleString()}, not {wanted[name].simpleString()}")
        parts.append(df.select(*[(F.col(f.name) if f.name in own else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]))
    return reduce(DataFrame.unionByName, parts)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SNK-04, DML-04: all existing rows and the first new row of each key that they lack."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def versioned_update(rows: DataFrame, writes: DataFrame, key: str, order: list, version: str = "version", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """DML-03: the table after a batch of concurrent writes, and the writes refused.

    A table of files has no row lock. Each write names the version that it has
    read; of the writes of a batch to one row, the first by `order` (total) that
    names the row's version wins and raises it, all others are refused and have
    to read again. writes(key, version, value, ...).
    """
    now = writes.join(rows.select(key, F.col(version).alias("_now")), key, "left")
    fits = F.col(version) == F.col("_now")
    nth = F.row_number().over(Window.partitionBy(key, fits).orderBy(*order))
    judged = now.withColumn("_wins", fits & (nth == 1))
    won = judged.where("_wins").select(key, (F.col(version) + 1).alias(version), value)
    after = rows.select(key, version, value).join(won, key, "left_anti").unionByName(won)
    return after, judged.where(~F.coalesce("_wins", F.lit(False))).drop("_now", "_wins")


def latest_of_log(log: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """SNK-05: the last row of each key, with the number of rows that changed anything (a repeated value is no change)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = log.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    ranked = marked.withColumns({"_n": F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])), "changes": F.sum("_new").over(Window.partitionBy(*keys))})
    return ranked.where("_n = 1").drop("_n", "_new")


def markdown(guide: DataFrame, sections: DataFrame, citations: DataFrame) -> DataFrame:
    """SNK-06: (guide_id, text): title, version, commit if any, sections in order with their diagram and their citations by file and line; one line break at the end.

    guide(guide_id, title, version, commit), sections(guide_id, section_id, ord, heading, body, diagram), citations(section_id, file, line_start, line_end).
    """
    from ..operators.graph import joined_lines

    top = guide.select("guide_id", F.lit(-1).alias("ord"), F.lit(0).alias("part"), F.lit("").alias("file"), F.lit(0).alias("at"), F.concat(F.lit("# "), "title", F.lit("\n\nVersion "), F.col("version").cast("string"), F.coalesce(F.concat(F.lit("\n\nCommit "), "commit"), F.lit(""))).alias("line"))
    s = sections.select("guide_id", "section_id", "ord", F.concat(F.lit("\n## "), "heading", F.lit("\n\n"), "body", F.coalesce(F.concat(F.lit("\n\n```mermaid\n"), "diagram", F.lit("\n```")), F.lit(""))).alias("line"))
    cited = citations.join(s.select("guide_id", "section_id", "ord"), "section_id")
    cited = cited.select("guide_id", "ord", F.lit(1).alias("part"), "file", F.col("line_start").alias("at"), F.format_string("- `%s:%d-%d`", "file", "line_start", "line_end").alias("line")).distinct()
    body = s.select("guide_id", "ord", F.lit(0).alias("part"), F.lit("").alias("file"), F.lit(0).alias("at"), "line")
    return joined_lines(top.unionByName(body).unionByName(cited), ["ord", "part", "file", "at"], ["guide_id"]).select("guide_id", F.concat(F.rtrim("text"), F.lit("\n")).alias("text"))


def live_keys(df: DataFrame, now, written_at: str, hours: int = 24) -> DataFrame:
    """SNK-07: entries that have not expired at `now`."""
    return df.where(now < F.col(written_at) + F.expr(f"INTERVAL {hours} HOURS"))


def report_markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """SNK-08: rows as a Markdown table, nulls as a dash."""
    from ..operators.graph import joined_lines

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return joined_lines(rows.select(*order, cells.alias("line")), order).select(F.concat(F.lit(head), "text").alias("text"))
