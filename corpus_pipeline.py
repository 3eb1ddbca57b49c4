"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, packed token ids.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and
works on all that the one before kept. All but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.classifiers import quality_scores
from quillforge.llm.common import prepare, table, written
from quillforge.llm.decontamination import without_leaks
from quillforge.llm.jaccard_join import jaccard_join
from quillforge.llm.mixing import mix_sources
from quillforge.llm.packing import pack_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.3 or more.

    Each row is scored by its text alone: rows without an id, repeated rows and ids
    stay or go by it; a null or empty text scores as one without features. An empty
    table stays empty; columns other than those of `documents` are left out.
    """
    prepare(spark)
    return quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("score >= 0.3").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.8, the one with the least doc_id.

    A document is a doc_id with a text: rows equal in both are one, different texts
    under one doc_id are judged each by itself; they are known by two 64-bit hashes. Rows with a null doc_id are all kept,
    and so are those with a null or empty text, one of each doc_id. An empty table
    stays empty; columns other than those of `documents` are left out.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    two = F.xxhash64(F.lit(1), "doc_id", "text")
    named = docs.where("doc_id IS NOT NULL").withColumns({"_key": F.xxhash64("doc_id", "text"), "_two": two})
    group = jaccard_join(named.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    first = named.select("_key", "doc_id").join(group, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    # documents that one hash does not tell apart: no link of theirs is certain, so they stay
    clash = named.groupBy("_key").agg(F.min("_two").alias("a"), F.max("_two").alias("b")).where("a <> b").select("_key")
    kept = named.join(first.unionByName(clash), "_key", "left_semi").dropDuplicates(["_key", "_two"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each row is judged by its text alone, so repeated rows and ids stay or go alike;
    a null or empty text contains nothing. An empty table, and any against an empty
    benchmark, stays as it is; columns other than those of `documents` are left out.
    """
    prepare(spark)
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0, 1 or 2 times): its words taken over its size, rounded half up.

    Rows with one doc_id (or none), source and text share out what the mix takes of
    them. Rows without words go; a null source is a source of its own; an empty
    table stays empty; columns other than those of `documents` are left out.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    key = ["_no_id", "_id", "_no_source", "_source", "_hash"]
    keyed = lambda df: df.withColumns({"_no_id": F.isnull("doc_id"), "_id": F.coalesce("doc_id", F.lit(0)), "_no_source": F.isnull("source"), "_source": F.coalesce("source", F.lit(""))})
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    taken = keyed(mix_sources(docs, also=("_hash",)).where("size > 0")).groupBy(*key).agg(F.count_if(times == 2).alias("_twice"), F.count_if(times >= 1).alias("_taken")).where("_taken > 0")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("lang", "n_chars"))
    met = keyed(docs).join(taken, key).withColumn("_nth", nth).where("_nth <= _taken")
    return met.withColumn("_time", F.explode(F.sequence(F.lit(1), F.when(F.col("_nth") <= F.col("_twice"), 2).otherwise(1)))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids, of all rows; a null or empty text has none. An empty table gives no rows; other columns are left out."""
    prepare(spark)
    return pack_tokens(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("token ids", pack),
]

#: No stage but the mix can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
