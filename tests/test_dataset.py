"""History, parameters, ordered chains, algorithm choices."""

import pytest
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.operators import annotate
from cellgrid.operators.ranks import _algorithm
from cellgrid.plans import run


@pytest.fixture()
def small(spark):
    cells = spark.createDataFrame([(0, "a-1", 5.0, True), (1, "b-1", 50.0, False), (2, "c-1", None, None)],
                                  "cell_idx bigint, cell_id string, n_genes double, flag boolean")
    genes = spark.createDataFrame([(0, "G0"), (1, "G1")], "gene_idx bigint, gene_id string")
    x = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (1, 1, 3.0)], "cell_idx bigint, gene_idx bigint, value double")
    return CellData(cells=cells, genes=genes, x_raw=x)


def test_history_newest_first_and_changed(small):
    assert not small.changed and small.show_history() == ["No history recorded"]
    cd = small.select_cells("n_genes > 1")
    cd = cd.drop_cell_annotation("flag")
    assert cd.changed
    lines = cd.show_history()
    assert "Dropped 'flag'" in lines[0] and "Selection 'n_genes > 1'" in lines[1]
    assert "2 of 3 stay, 1 go" in lines[1]
    verbose = cd.show_history(verbose=True)
    assert any("parameters=" in v for v in verbose)
    frame = cd.history_frame()
    assert frame.count() == 2 and set(frame.columns) >= {"hostname", "user", "python", "operating_system",
                                                          "timestamp", "version", "parameters", "description"}


def test_drop_missing_annotation_is_a_no_op(small):
    cd = small.drop_cell_annotation("nope")
    assert cd is small and not cd.history


def test_parameters(small):
    cd = small.set_parameter("classic_filter", "threshold", 1.5).set_parameter("classic_filter", "threshold", 2.0)
    assert cd.get_parameter("classic_filter", "threshold") == 2.0
    assert small.get_parameter("classic_filter", "threshold") is None


def test_order_of_steps_matters(small):
    a = run(small, [("promote", {"name": "n_genes"}), ("select_genes", {"expr": "gene != 'G0'"})])
    b = run(small, [("select_genes", {"expr": "gene != 'G0'"}), ("promote", {"name": "n_genes"})])
    assert a.shape() == b.shape() == (3, 2)
    assert sorted(r.gene_id for r in a.genes.collect()) == ["G1", "n_genes"]
    c = run(small, [("select_cells", {"expr": "n_genes > 10"}), ("with_total_umis", {})])
    d = run(small.with_total_umis(), [("select_cells", {"expr": "total_umis > 2"})])
    assert [r.cell_id for r in c.cells.collect()] == ["b-1"]
    assert [r.cell_id for r in d.cells.collect()] == ["b-1"]


def test_promote(small):
    cd = small.promote("flag")
    new = cd.genes.where("gene_id = 'flag'").first().gene_idx
    assert new == 2 and "flag" not in cd.cells.columns
    assert {(r.cell_idx, r.value) for r in cd.x.where(F.col("gene_idx") == new).collect()} == {(0, 1.0)}
    assert small.promote("missing") is small


def test_annotation_checks(spark, small):
    ann = spark.createDataFrame([("a-1", 1), ("a-1", 2)], "id string, v int")
    with pytest.raises(ValueError):
        small.annotate_cells(ann, ["v"], [1])
    with pytest.raises(ValueError):
        small.annotate_cells(ann, ["v", "w"], [1])
    ok = spark.createDataFrame([("a", 7)], "id string, v int")
    cd = small.annotate_cells(ok, "v", "1", id_suffix="-1")
    assert {r.cell_id: r.v for r in cd.cells.collect()} == {"a-1": 7, "b-1": None, "c-1": None}


def test_replace_counts_must_match(spark, small):
    new = spark.createDataFrame([("x", 0)], "id string, line_no bigint")
    with pytest.raises(ValueError):
        annotate.replace(small, "cell", new)


def test_algorithm_choice_and_default_method(small):
    assert _algorithm(small) == "unfiltered"
    assert _algorithm(small.set_parameter("classic_filter", "threshold", 1)) == "classic"
    both = small.set_parameter("classic_filter", "threshold", 1).set_parameter("emptydrops", "lower", 1)
    assert _algorithm(both) == "emptydrops"
    with pytest.raises(ValueError):
        small.filter_empty(method="other")


def test_describe_all_parts(small):
    out = small.with_total_umis().describe()
    assert {"brief", "matrix", "cell_names", "cell_numeric", "cell_categorical", "gene_names"} <= set(out)
    num = {r.annotation: r for r in out["cell_numeric"].collect()}
    assert num["n_genes"]["count"] == 2 and num["n_genes"]["median"] == 27.5
    cat = {(r.annotation, r.value): r["count"] for r in out["cell_categorical"].collect()}
    assert cat[("flag", "true")] == 1
    assert out["matrix"].first().nnz == 3


def test_empty_dataset_after_selection(small):
    cd = small.select_cells("n_genes > 1000")
    assert cd.shape() == (0, 2) and cd.x.count() == 0
    assert "0 of " in cd.history[0]["description"]
    t = cd.with_total_umis()
    assert t.cells.count() == 0
    out = t.describe()
    assert out["matrix"].first().nnz == 0


def test_single_cell(spark):
    cells = spark.createDataFrame([(0, "only-1")], "cell_idx bigint, cell_id string")
    genes = spark.createDataFrame([(0, "G0"), (1, "G1")], "gene_idx bigint, gene_id string")
    x = spark.createDataFrame([(0, 1, 4.0)], "cell_idx bigint, gene_idx bigint, value double")
    cd = CellData(cells=cells, genes=genes, x_raw=x).with_total_umis()
    assert cd.cells.first().total_umis == 4.0
    with pytest.raises(ValueError):
        cd.filter_classic(expect=3000)  # position 30 does not exist


def test_all_ambient_emptydrops(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(i, j, float(v)) for i in range(300) for j, v in enumerate(rng.poisson(0.2, size=20)) if v]
    x = spark.createDataFrame(rows, "cell_idx bigint, gene_idx bigint, value double")
    cells = spark.range(300).select(F.col("id").alias("cell_idx"), F.col("id").cast("string").alias("cell_id"))
    genes = spark.range(20).select(F.col("id").alias("gene_idx"), F.col("id").cast("string").alias("gene_id"))
    cd = CellData(cells=cells, genes=genes, x_raw=x)
    out = cd.filter_emptydrops(lower=100, iters=50, retain=1000.0, alpha=float("inf"))
    assert out.cells.count() == 0                  # nothing tested, null FDR -> removed
    kept = cd.filter_emptydrops(lower=100, iters=50, retain=1000.0, alpha=float("inf"), keep_all=True)
    assert kept.cells.where("emptydrops_fdr is not null").count() == 0
    assert kept.get_parameter("emptydrops", "lower") == 100.0
