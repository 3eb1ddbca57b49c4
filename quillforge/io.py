"""Tables, shared folders and small helpers on them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_own_folder: list[str] = []


def _temporary() -> str:
    """A folder of this process, removed when it ends."""
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quillforge-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one only where it is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _temporary()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clear_shared(spark: SparkSession) -> int:
    """Removes all that this process has put into shared folders so far; how many paths. Only after the last read of a result: tables given out may still read them."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: the lineage is cut and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many_parts(spark: SparkSession) -> int:
    """Into how many parts to deal rows that are much work each, however few bytes they have as a table: as many as a shuffle has, four for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is any file below a path."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def file_stream(spark: SparkSession, path: str, most_files: int = 0) -> DataFrame:
    """The rows of a Parquet folder, or of a single file, as a stream of its files, with the columns that it has now; most_files: how many files a batch takes (0: all there are).

    A file stream refuses the path of a single file but takes a pattern; this one fits the one path only.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def global_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in the total order, without gathering rows in one task.

    Rows are sorted by range, numbered within their partition, and moved up by
    the counts of the partitions before (one number for each partition).
    """
    row = F.monotonically_increasing_id()
    cut = written(df.orderBy(*order).withColumns({"_part": F.shiftright(row, 33), "_nth": row.bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    counts = sorted((r["_part"], r["n"]) for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return cut.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def assert_unique(df: DataFrame, keys: list[str], where=None) -> DataFrame:
    """The keys that come more than once among the rows that the condition picks, with their counts; none if they are unique."""
    df = df if where is None else df.where(where)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
