"""Queries on edges between parts, where some lines of an order have no number, where some parts have keys below 0, and where there are no lines."""

import pytest
from pyspark.sql import functions as F
from test_large_keys import compare
from test_queries import SF

NAMES = "bfs_depth decision_points degree_all degree_internal diagram_edges diagram_nodes import_lists mermaid_render".split()


def stored(spark, d, part, line):
    for name in ("part", "lineitem", "supplier", "nation", "region"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        {"part": part, "lineitem": line}.get(name, lambda x: x)(t).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def unnumbered(spark, tmp_path_factory):
    numbered = (F.col("l_orderkey") + F.col("l_partkey")) % 5 != 1
    return stored(spark, str(tmp_path_factory.mktemp("unnumbered")), lambda p: p, lambda x: x.withColumn("l_linenumber", F.when(numbered, F.col("l_linenumber"))))


@pytest.fixture(scope="module")
def below(spark, tmp_path_factory):
    return stored(spark, str(tmp_path_factory.mktemp("below")), lambda p: p.withColumn("p_partkey", -F.col("p_partkey")), lambda x: x.withColumn("l_partkey", -F.col("l_partkey")))


@pytest.mark.parametrize("name", NAMES)
def test_lines_without_number(spark, unnumbered, name):
    compare(spark, unnumbered, name)


@pytest.mark.parametrize("name", NAMES)
def test_parts_with_keys_below_zero(spark, below, name):
    compare(spark, below, name)


def test_diagram_of_no_lines(spark, tmp_path):
    compare(spark, stored(spark, str(tmp_path), lambda p: p, lambda x: x.where("false")), "mermaid_render")
