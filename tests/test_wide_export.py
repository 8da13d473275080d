"""Dense text export at a real width: 30 000 genes."""

from pyspark.sql import functions as F

from cellgrid.data import CellData


def test_thirty_thousand_genes(spark, tmpdir_path):
    n_genes, n_cells, per_cell = 30_000, 40, 200
    genes = spark.range(n_genes).select(F.col("id").alias("gene_idx"), F.concat(F.lit("g"), "id").alias("gene_id"))
    cells = spark.range(n_cells).select(F.col("id").alias("cell_idx"), F.concat(F.lit("c"), "id").alias("cell_id"))
    x = spark.range((n_cells - 1) * per_cell).select(     # the last cell has no entry
        F.expr(f"id div {per_cell}").alias("cell_idx"), F.expr(f"(id * 7919) % {n_genes}").alias("gene_idx"),
        (F.col("id") % 9 + 1).cast("double").alias("value"))
    CellData(cells=cells, genes=genes, x_raw=x).export_textmatrix(f"{tmpdir_path}/wide.tsv", single_file=True)
    want = {}
    for i in range((n_cells - 1) * per_cell):
        at = (i // per_cell, i * 7919 % n_genes)
        want[at] = want.get(at, 0) + i % 9 + 1
    with open(f"{tmpdir_path}/wide.tsv") as f:
        assert next(f).rstrip("\n").split("\t") == ["barcode"] + [f"g{i}" for i in range(n_genes)]
        for c, line in enumerate(f):
            name, *values = line.rstrip("\n").split("\t")
            assert name == f"c{c}" and len(values) == n_genes
            assert {(c, i): int(v) for i, v in enumerate(values) if v != "0"} == {k: v for k, v in want.items() if k[0] == c}
    assert c == n_cells - 1
