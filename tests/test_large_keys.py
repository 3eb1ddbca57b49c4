"""Queries whose SQL names parts by keys of a fixed width, on keys that are longer, so that some share a name."""

import duckdb
import pytest
from pyspark.sql import functions as F
from quillforge.plans import catalog
from test_queries import SF, plain

GRAPH = "adjacency bfs_depth decision_points degree_all degree_internal dependency_diff diagram_edges diagram_nodes graph_contraction import_lists leftover_groups mermaid_render neighbours subsystem_diff tradeoff_diff directory_tree".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Half of the parts and suppliers keep keys within the width, the others get keys that begin with the same digits."""
    d = str(tmp_path_factory.mktemp("long"))

    def moved(key, least, width):
        k = F.col(key)
        return F.when(k % 2 == 0, 10**width + k * 7).otherwise(10 ** (width - 1) + k % least).cast("long")

    for name, keys in {"part": {"p_partkey": 6}, "lineitem": {"l_partkey": 6, "l_suppkey": 5}, "supplier": {"s_suppkey": 5}, "nation": {}, "region": {}}.items():
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.withColumns({k: moved(k, 10**5, w) for k, w in keys.items()}).write.parquet(f"{d}/{name}.parquet")
    return d


def compare(spark, d, name):
    got = catalog.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in found.fetchall())
    assert want
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", GRAPH)
def test_long_keys_in_graphs(spark, folder, name):
    compare(spark, folder, name)


@pytest.mark.parametrize("name", ["source_entry_points", "source_units"])
def test_long_keys_in_sources(spark, folder, name):
    compare(spark, folder, name)
