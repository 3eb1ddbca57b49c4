"""Versions of evidence: each line with a date belongs to one of them, and neither has less than what its time gives."""

import datetime

import duckdb
import pytest
from quillforge.plans import catalog
from test_large_keys import compare
from test_missing_values import folder  # noqa: F401
from test_queries import SF


def test_evidence_of_all_years_after_the_first(spark, tmp_path):
    d = str(tmp_path)
    shipped = {1: ["1995-03-01", "1997-05-01"], 2: ["1995-12-31", "1999-02-01"], 3: ["1996-01-01"], 4: ["1995-06-01"], 5: ["1995-01-02", "2001-07-01"], 6: ["2001-11-04"]}
    lines = [(k, datetime.datetime.fromisoformat(t)) for k, times in shipped.items() for t in times]
    spark.createDataFrame(lines, "l_partkey bigint, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, "Brand#1", k) for k in shipped], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    got = {(r.decision, r.kind, r.evidence_key) for r in catalog.queries()["tradeoff_diff"](spark, d).collect()}
    kinds = {1: "same", 2: "same", 3: "added", 4: "removed", 5: "same", 6: "added"}
    assert got == {(f"Brand#1/{k}", kind, f"00000{k}") for k, kind in kinds.items()}


def test_no_less_evidence_than_with_a_gap_between_versions(spark):
    """Lines from 1996 to August 1998 once belonged to no version."""
    con = duckdb.connect()
    parts = "SELECT count(DISTINCT l_partkey) FROM '{}/lineitem.parquet' WHERE l_shipdate {}"
    least = sum(con.execute(parts.format(SF, when)).fetchone()[0] for when in ("< '1996-01-01'", ">= '1998-09-01'"))
    rows = catalog.queries()["tradeoff_diff"](spark, SF).collect()
    assert sum(len(r.evidence_key.split("\n")) * (2 if r.kind in ("same", "changed") else 1) for r in rows) >= least


@pytest.mark.parametrize("name", ["subsystem_diff", "tradeoff_diff"])
def test_versions_of_parts_without_brand_or_size(spark, folder, name):  # noqa: F811
    compare(spark, folder, name)
