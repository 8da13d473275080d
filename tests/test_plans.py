"""Plan shape of some registered queries: no cartesian products, no nested-loop
joins, no row-at-a-time Python."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E
from conftest import SF_SMALL

CHECK = ["a01_total_umis", "a05_classic", "f01b_matrix_follows", "f14_or", "j01_annotate_cells",
         "w01_barcode_ranks", "t07_tag_counts", "t06_kmer_nearest", "e05_loglik_multinomial",
         "p03_categorical_summary"]


@pytest.mark.parametrize("name", CHECK)
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_top5_is_limited_before_shuffle(spark):
    df = E.queries()["p03_categorical_summary"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_parquet_scan_is_pruned(spark):
    from cellgrid.operators.totals import cell_totals
    from cellgrid.plans.fixtures import m1
    df = cell_totals(m1(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_cell_selection_prunes_matrix_with_bloom_filter(spark):
    """Too many cells to broadcast: the runtime bloom filter built from the
    selected cells prunes matrix entries before the semi-join shuffle.  The
    scan-size threshold (10 GB by default, met at scale) is lowered here."""
    keys = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = E.queries()["f01b_matrix_follows"](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_promoted_genes_are_not_dealt_by_gene(spark):
    """A promoted gene has an entry for nearly every cell: its rows stay where they are,
    also where Spark takes no side for small by itself."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = E.queries()["j07_promote"](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert re.findall(r"(\w+) \[gene_idx#\d+L\], \[gene_idx#\d+L\], Inner", plan.split("Initial Plan")[0]) == ["BroadcastHashJoin"]
