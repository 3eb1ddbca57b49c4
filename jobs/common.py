"""What the jobs share: their command line, their config file and their log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillforge.session import build

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, replaced by what a JSON file of one object says; a name that the job doesn't know is an error."""
    if path is None:
        return dict(defaults)
    row = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    own = row.asDict(recursive=True) if row else {}
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"{path}: unknown settings {unknown}")
    return defaults | own


def told(df: DataFrame, what: str, path: str) -> int:
    """Logs and gives the number of rows."""
    n = df.count()
    log.info("%s %d rows: %s", what, n, path)
    return n


def main(name: str, paths: list[str], defaults: dict, run: Callable[..., dict]) -> None:
    """A command line with one argument for each path and --config; makes the session and stops it."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help="a path that Spark can open")
    parser.add_argument("--config", help="a JSON file of settings: " + ", ".join(defaults))
    parser.add_argument("--master", help="where to run; else what spark-submit says")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build(name, args.master)
    try:
        done = run(spark, *[getattr(args, p) for p in paths], settings(spark, args.config, defaults))
        log.info("%s done: %s", name, done)
    finally:
        spark.stop()
