"""Job 1, incremental: an index of passages that a guide can cite, kept up with a growing folder of documents.

    python -m jobs.passages --documents PATH --output PATH --checkpoint PATH [--config jobs/passages.json]

Reads documents(doc_id, text, lang, source) as a file stream, takes what the
checkpoint has not seen, and ends. Each text is cut into passages of `lines` lines. Two
tables are written, a folder `batch=N` for each micro-batch:

* citations/batch=N/lang=L: doc_id, source, ord, line_start, line_end, hash, one row for each passage of each document;
* passages/batch=N: hash, text, n_chars, terms (its identifiers), one row for each text that no earlier batch has: a
  passage that many documents share is stored, and has to be explained, once.

A batch that is delivered again finds what earlier batches have and replaces its own folders, so that it changes nothing.
A document that comes again in a later file replaces its citations: index() takes each document's last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, told
from quillforge.functions import text as X
from quillforge.io import file_stream, stored

DEFAULTS = {"lines": 20, "files_per_batch": 0}
CITATIONS = "doc_id long, source string, ord int, line_start int, line_end int, hash string, batch long, lang string"
PASSAGES = "hash string, text string, n_chars int, terms array<string>, batch long"


def cut(docs: DataFrame, lines: int) -> DataFrame:
    """(doc_id, source, lang, ord, line_start, line_end, hash, text): the passages of each text that have any ink. A null text has none."""
    at = F.sequence(F.lit(0), F.ceil(F.size("l") / lines).cast("int") - 1)
    split = docs.where("text IS NOT NULL").select("doc_id", "source", "lang", F.split("text", "\n").alias("l"))
    parts = F.transform(at, lambda i: F.struct((i * lines + 1).alias("line_start"), F.least((i + 1) * lines, F.size("l")).alias("line_end"), F.array_join(F.slice("l", i * lines + 1, F.lit(lines)), "\n").alias("text")))
    rows = split.select("doc_id", "source", "lang", F.posexplode(parts).alias("ord", "p")).select("doc_id", "source", "lang", "ord", "p.*").where(F.col("text").rlike(r"[^ \t\r\n]"))
    return rows.withColumn("hash", X.token_hash(F.col("text")))


def read_passages(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PASSAGES).parquet(f"{output}/passages")


def read_citations(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CITATIONS).parquet(f"{output}/citations")


def apply_batch(batch: DataFrame, number: int, output: str, lines: int) -> None:
    """Writes one batch of documents; doing it again with the same number changes nothing."""
    spark = batch.sparkSession
    rows = cut(batch, lines)
    rows.drop("text").dropDuplicates().write.mode("overwrite").partitionBy("lang").parquet(f"{output}/citations/batch={number}")
    new = rows.select("hash", "text").dropDuplicates(["hash"])
    if number:
        new = new.join(read_passages(spark, output).where(F.col("batch") < number).select("hash"), "hash", "left_anti")
    terms = F.array_sort(F.array_distinct(X.technical_terms(F.col("text"))))
    new.select("hash", "text", F.char_length("text").alias("n_chars"), terms.alias("terms")).write.mode("overwrite").parquet(f"{output}/passages/batch={number}")
    told(read_citations(spark, output).where(F.col("batch") == number), "wrote", f"{output}/citations/batch={number}")
    told(read_passages(spark, output).where(F.col("batch") == number), "wrote", f"{output}/passages/batch={number}")


def index(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, source, lang, ord, line_start, line_end, hash, n_chars, terms): the citations of each document's last batch, with their passages."""
    cited = read_citations(spark, output)
    last = cited.groupBy("doc_id").agg(F.max("batch").alias("last")).withColumnRenamed("doc_id", "_id")
    now = cited.join(last, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("batch") == F.col("last")))
    return now.join(read_passages(spark, output).select("hash", "n_chars", "terms"), "hash").select("doc_id", "source", "lang", "ord", "line_start", "line_end", "hash", "n_chars", "terms")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict = DEFAULTS) -> dict:
    """Brings the index up to the documents there are now. How many batches it took.

    Batches are numbered by the checkpoint, so output and checkpoint belong together: an output without its checkpoint is refused.
    """
    lines = int(settings["lines"])
    if lines < 1:
        raise ValueError("a passage has a line or more")
    if not stored(spark, checkpoint) and stored(spark, output):
        raise ValueError(f"{output} holds an index whose checkpoint is not {checkpoint}")
    stream = file_stream(spark, documents, int(settings["files_per_batch"])).select("doc_id", "text", "lang", "source")
    took: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, output, lines)
        took.append(number)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %s: batches %s", documents, took)
    return {"batches": len(took)}


if __name__ == "__main__":
    main("passages", ["documents", "output", "checkpoint"], DEFAULTS, run)
