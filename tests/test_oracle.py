"""Registered queries against their DuckDB SQL at sf0.001 (one or more per family)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E
from oracle_check import compare, duck
from conftest import SF_SMALL

FAST = ["a02_totals_histogram", "a05_classic", "a06_default_drops", "s10_make_unique", "f04_ne",
        "f12_not_in_list", "f21_nested", "j02_annotate_genes", "j04_replace_cells", "j07_promote",
        "w01_barcode_ranks", "w02_knee_inflection", "p02_numeric_summary", "p03_categorical_summary",
        "t05_corrected_match", "t09_assign", "e03_good_turing", "e05b_loglik_dirichlet", "e08_bh_adjust",
        "d02_ks_uniform", "k05_wide_matrix", "e04_alpha_mle", "e09c_emptydrops_default_few",
        "p07_history_after_saves", "a01b_total_umis_saved"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql_or_is_statistical():
    from cellgrid.plans.catalog import QUERIES

    orc = E.oracle_sql()
    rows_only = {k for k in QUERIES if k not in orc}
    assert rows_only <= {"e06_monte_carlo_pvalues", "e09_emptydrops", "e10_cellranger",
                         "e12_ambient_pvalues", "d05_dispersion_test"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert r["values"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["cell_id", "total_umis"] and df.count() > 0
