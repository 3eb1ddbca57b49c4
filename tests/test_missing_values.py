"""Queries on groups of parts, where some parts have no brand or no size, so that their group has no name."""

import pytest
from pyspark.sql import functions as F
from test_large_keys import compare
from test_queries import SF


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("missing"))
    for name in ("part", "lineitem", "supplier", "nation", "region"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "part":
            t = t.withColumn("p_brand", F.when(F.col("p_partkey") % 4 != 1, F.col("p_brand"))).withColumn("p_size", F.when(F.col("p_partkey") % 7 != 2, F.col("p_size")))
        t.write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["dependency_diff", "graph_contraction", "leftover_groups"])
def test_parts_without_brand_or_size(spark, folder, name):
    compare(spark, folder, name)
