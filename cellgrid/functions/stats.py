"""Statistics as Column expressions: log-gamma, Good-Turing, Benjamini-Hochberg.

Spark has no ``lgamma``; ``lgamma`` here is Stirling's series after shifting
the argument by 8 (``lnΓ(z) = lnΓ(z+8) - ln(z(z+1)...(z+7))``), accurate to
about 1e-10 for arguments from 1e-6 up, and pure JVM (whole-stage codegen).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.positions import materialize, running_sums

MIN_FREQUENCIES = 5  # distinct counts below which the regression is not fitted
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def lgamma(z) -> Column:
    """ln Γ(z) for z > 0."""
    z = z if isinstance(z, Column) else F.lit(z)
    w = z + 8.0
    prod = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
    inv = 1.0 / w
    inv2 = inv * inv
    series = inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 * (1.0 / 1680))))
    return (w - 0.5) * F.log(w) - w + _HALF_LOG_2PI + series - F.log(prod)


def good_turing_proportions(counts: DataFrame, key: str = "gene_idx", count: str = "count",
                            conf: float = 1.96) -> DataFrame:
    """Simple Good-Turing proportions for ``(key, count)`` rows (zeros included).

    Frequencies of frequencies ``n_r`` over observed counts ``r``; ``Z_r = 2 n_r /
    (t - q)`` with neighbours ``q < r < t`` (``q = 0`` first, ``t = 2r - q`` last);
    ``ln Z`` regressed on ``ln r``.  The Turing estimate ``(r+1) n_{r+1}/n_r``
    is used while ``r+1`` is observed and it differs from the smoothed
    ``(r+1) S(r+1)/S(r)`` by more than ``conf`` standard deviations; from the
    first failure on, the smoothed value is used.  Unseen genes share
    ``P0 = n_1 / N``; seen genes share ``1 - P0`` in proportion to ``r*``.

    No proportion is zero (a zero would make a barcode with that gene
    impossible): without singletons unseen genes share ``1 / N``, and a profile
    with fewer than five distinct counts, too few for the regression, gets
    add-one smoothing ``(count + 1) / (N + genes)`` instead.
    Returns ``(key, count, prop)``.  The table of distinct counts is small;
    its neighbours come from positions and equi-joins, and its few scalars
    (slope, totals, switch point, normaliser) are single-row aggregations.
    """
    seen = counts.where(F.col(count) > 0)
    ff = seen.groupBy(F.col(count).cast("double").alias("r")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ff = materialize(running_sums(ff, [F.col("r")], {"i": F.lit(1)}))  # distinct counts, read many times
    prev = ff.select((F.col("i") + 1).alias("i"), F.col("r").alias("q"))
    nxt = ff.select((F.col("i") - 1).alias("i"), F.col("r").alias("t"), F.col("n").alias("n_next"))
    # written once, with its neighbours: every scalar below reads it
    z = materialize(ff.join(prev, "i", "left").join(nxt, "i", "left")
                    .withColumn("q", F.coalesce("q", F.lit(0.0)))
                    .withColumn("t_", F.coalesce("t", 2 * F.col("r") - F.col("q")))
                    .withColumn("lz", F.log(2 * F.col("n") / (F.col("t_") - F.col("q"))))
                    .withColumn("lr", F.log("r")))
    # scalars of the small frequency table: one single-row aggregation each step
    row = z.agg(F.regr_slope("lz", "lr").alias("b"), F.sum(F.col("r") * F.col("n")).alias("n_tot"),
                F.sum(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.count(F.lit(1)).alias("rows")).first()
    size = counts.agg(F.count(F.lit(1)).alias("genes"), F.sum(F.col(count).cast("double")).alias("umis"), F.count_if(F.col(count) == 0).alias("n0")).first()
    if row["rows"] < MIN_FREQUENCIES:
        return counts.select(key, count, ((F.col(count) + 1) / F.lit(float(size["umis"] or 0.0) + size["genes"])).alias("prop"))
    b = row["b"] if row["b"] is not None else -1.0  # one distinct count: Zipf-like default
    n_tot, n1 = float(row["n_tot"]), float(row["n1"] or 0.0)
    est = z.select(
        "i", "r", "n",
        ((F.col("r") + 1) * F.pow((F.col("r") + 1) / F.col("r"), F.lit(b))).alias("y"),
        F.when(F.col("t") == F.col("r") + 1, (F.col("r") + 1) * F.col("n_next") / F.col("n")).alias("x"),
        F.when(F.col("t") == F.col("r") + 1,
               F.sqrt(F.pow(F.col("r") + 1, 2) * F.col("n_next") / F.pow(F.col("n"), 2)
                      * (1 + F.col("n_next") / F.col("n")))).alias("sd"))
    switch_at = est.agg(F.min(F.when(F.col("x").isNull() | (F.abs(F.col("x") - F.col("y")) <= F.lit(conf) * F.col("sd")),
                                     F.col("i")))).first()[0]
    switch_at = (1 << 62) if switch_at is None else int(switch_at)
    rstar = est.select("r", "n", F.when(F.col("i") < F.lit(switch_at), F.col("x"))
                       .otherwise(F.col("y")).alias("rstar"))
    norm = float(rstar.agg(F.sum(F.col("n") * F.col("rstar"))).first()[0])
    n0 = size["n0"]
    p0 = (n1 or (1.0 if n0 else 0.0)) / n_tot
    props = rstar.select("r", ((1 - p0) * F.col("rstar") / norm).alias("p_seen"))
    p_unseen = p0 / n0 if n0 else 0.0
    out = counts.join(props, F.col(count).cast("double") == F.col("r"), "left")  # AQE broadcasts it
    return out.select(key, count, F.when(F.col(count) == 0, F.lit(p_unseen)).otherwise(F.col("p_seen")).alias("prop"))


def bh_adjust(pvals: DataFrame, p: str = "pvalue", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg over the non-null ``p`` of the frame.

    Works on the histogram of distinct p-values (at most iterations + 2 rows
    for Monte-Carlo p-values): rank = cumulative count ascending, ``p*m/rank``,
    running minimum from the largest p down, capped at 1, joined back.  Both
    running steps use the distributed ordering helpers, so any number of
    distinct p-values works.
    """
    tested = pvals.where(F.col(p).isNotNull())
    hist = tested.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hist = materialize(running_sums(hist, [F.col("_p")], {"_cum": F.col("_n")}))
    m = hist.agg(F.sum("_n")).scalar()
    raw = hist.select("_p", (F.col("_p") * m / F.col("_cum")).alias("_q"))
    adj = running_sums(raw, [F.col("_p").desc()], {"_qmin": F.col("_q")}, agg="min")
    adj = adj.select("_p", F.least(F.lit(1.0), F.col("_qmin")).alias(out))
    # only tested rows are joined: all others would meet in one null key
    done = tested.join(adj, tested[p] == adj["_p"]).drop("_p")
    return done.unionByName(pvals.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
