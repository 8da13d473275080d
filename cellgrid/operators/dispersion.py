"""Goodness of fit of the ambient model.

Ambient barcodes tested against their own profile should give uniform
p-values.  D1 draws a reproducible sample (smallest ``md5(seed || id)``,
a top-k, no full sort), D2 runs a one-sample Kolmogorov-Smirnov test against
the uniform distribution, D3 turns it into a verdict, D4 gives the table
behind a uniform probability plot of *all* ambient p-values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.positions import dense_positions, materialize


def sample_pvalues(pvals: DataFrame, n: int = 100, seed: int = 0, key: str = "cell_id",
                   p: str = "pvalue") -> DataFrame:
    """``n`` rows chosen by the smallest ``md5(seed || key)``."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return pvals.where(F.col(p).isNotNull()).withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def ks_uniform(sample: DataFrame, p: str = "pvalue", terms: int = 100) -> DataFrame:
    """D2+D3: one row ``(n, d, ks_pvalue, suitable)``.

    ``D = max(i/n - p_(i), p_(i) - (i-1)/n)``; the p-value uses the Kolmogorov
    series at ``(sqrt(n) + 0.12 + 0.11/sqrt(n)) * D``.  The sample is small
    (``n`` rows), so one ordered window over it is fine.
    """
    w = Window.orderBy(F.col(p), F.col("_h2"))
    whole = Window.partitionBy(F.lit(1))
    s = (sample.withColumn("_h2", F.md5(F.col(p).cast("string"))).withColumn("_i", F.row_number().over(w))
         .withColumn("_n", F.count(F.lit(1)).over(whole)))
    d = s.agg(F.max("_n").alias("n"),
              F.max(F.greatest(F.col("_i") / F.col("_n") - F.col(p),
                               F.col(p) - (F.col("_i") - 1) / F.col("_n"))).alias("d"))
    n = F.col("n")
    d = d.withColumn("lam", (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("d"))
    lam = F.col("lam")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0)
                         * F.exp(-2.0 * j * j * lam * lam))
    pv = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series))
    out = d.select("n", "d", pv.alias("ks_pvalue"))
    return out.withColumn("suitable", F.col("ks_pvalue") >= 0.05)


def probplot_table(pvals: DataFrame, p: str = "pvalue", key: str = "cell_idx") -> tuple[DataFrame, DataFrame]:
    """``(i, theoretical, ordered)`` for all p-values against uniform
    Filliben medians, and one row ``(slope, intercept, r)`` of the least-squares line."""
    v = pvals.where(F.col(p).isNotNull()).select(key, F.col(p).alias("ordered"))
    pos = dense_positions(v, [F.col("ordered"), F.col(key)], name="i", start=1)
    n = v.agg(F.count(F.lit(1))).scalar()
    i = F.col("i")
    med = (F.when(i == 1, 1 - F.pow(F.lit(0.5), 1.0 / n))
           .when(i == n, F.pow(F.lit(0.5), 1.0 / n))
           .otherwise((i - 0.3175) / (n + 0.365)))
    table = pos.select("i", med.alias("theoretical"), "ordered")
    fit = table.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                    F.regr_intercept("ordered", "theoretical").alias("intercept"),
                    F.corr("ordered", "theoretical").alias("r"))
    return table, fit


def _alpha_choice(alpha):
    """A number, None (MLE) or 'non-dirichlet' (multinomial)."""
    if alpha is None:
        return None
    if isinstance(alpha, str):
        if alpha == "non-dirichlet":
            return math.inf
        return float(alpha)
    return float(alpha)


def dispersion_test(cd: CellData, alpha=None, lower: float = 100, sample: int = 100, seed: int = 0,
                    iters: int = 10000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(summary, probplot, fit)`` for the ambient p-values of ``cd``."""
    from cellgrid.operators.emptydrops import ambient_pvalues

    pv = ambient_pvalues(cd, lower=lower, alpha=_alpha_choice(alpha), iters=iters, seed=seed)
    pv = materialize(pv.join(cd.cells.select("cell_idx", "cell_id"), "cell_idx"))  # read three times below
    n_amb = pv.count()
    if n_amb < sample:
        raise ValueError(f"only {n_amb} ambient barcodes, cannot sample {sample}")
    summary = ks_uniform(sample_pvalues(pv, sample, seed)).withColumn("n_ambient", F.lit(n_amb))
    table, fit = probplot_table(pv)
    return summary, table, fit
