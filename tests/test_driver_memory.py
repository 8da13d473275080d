"""What emptyDrops brings to the driver."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.positions import materialize
from cellgrid.operators import emptydrops


def test_proportions_reach_the_driver_as_numbers(spark):
    n = 200_000
    props = materialize(spark.range(n).select((n - F.col("id")).alias("gene_idx"), (F.col("id") + 1.0).alias("prop")).repartition(5))
    cd = CellData(cells=spark.createDataFrame([(1, "a")], "cell_idx bigint, cell_id string"), genes=spark.createDataFrame([], "gene_idx bigint, gene_id string"),
                  x_raw=spark.createDataFrame([(1, 5, 2.0), (1, 9, 1.0)], "cell_idx bigint, gene_idx bigint, value double"))
    tested = spark.createDataFrame([(1, 3.0)], "cell_idx bigint, total double")
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")   # Spark's own default
    tracemalloc.start()
    try:
        got = emptydrops.monte_carlo_pvalues(cd, props, float("inf"), tested, iters=10, seed=1).collect()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert [(r.cell_idx, r.total) for r in got] == [(1, 3.0)]
    assert peak < 60 * n, peak   # row objects took several hundred bytes a gene
    assert np.array_equal(emptydrops._ordered_proportions(props), np.arange(n, 0, -1.0))


def test_proportions_of_many_genes_are_not_broadcast(spark, monkeypatch):
    props = materialize(spark.range(300).select(F.col("id").alias("gene_idx"), F.lit(1 / 300).alias("prop")))
    x = spark.range(900).select((F.col("id") % 7).alias("cell_idx"), (F.col("id") % 300).alias("gene_idx"), F.lit(1.0).alias("value"))
    cd = CellData(cells=spark.createDataFrame([], "cell_idx bigint, cell_id string"), genes=spark.createDataFrame([], "gene_idx bigint, gene_id string"), x_raw=x)
    cells = spark.range(5).select(F.col("id").alias("cell_idx"))
    hinted = lambda df: "rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()
    small = emptydrops.log_likelihoods(cd, props, 25.0, cells)
    assert hinted(small)
    assert emptydrops.PROPS_BYTES <= 16 << 20
    monkeypatch.setattr(emptydrops, "PROPS_BYTES", 0)
    large = emptydrops.log_likelihoods(cd, props, 25.0, cells)
    assert not hinted(large)
    near = lambda df: sorted((r.cell_idx, r.total, round(r.loglik, 9)) for r in df.collect())
    assert near(small) == near(large) and len(near(small)) == 5
