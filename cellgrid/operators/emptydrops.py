"""Statistical cell calling against an ambient profile.

E1  ambient barcodes: total <= lower
E2  ambient profile: summed counts per gene over them (genes without any
    count in the matrix are dropped first)
E3  Good-Turing proportions of the profile
E4  Dirichlet-multinomial concentration alpha: given, infinite, or the MLE
E5  log-likelihood of each tested barcode under the profile
E6  Monte-Carlo p-value per barcode: simulated likelihood paths, one random
    stream per iteration id (same answer for any partitioning), counted in the
    tasks that simulate them
E7  retain: barcodes at or above it get p = 0 (default: the knee)
E8  Benjamini-Hochberg over tested barcodes
E9  emptydrops_fdr annotation, parameters, filter

Shuffles: totals; ambient profile; likelihood per cell; counters of the simulation.
The driver only sees scalars and one number per gene (up to ``MAX_GENES``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.data import CellData
from cellgrid.functions.joins import sized
from cellgrid.functions.positions import materialize
from cellgrid.functions.stats import bh_adjust, good_turing_proportions, lgamma
from cellgrid.operators.totals import cell_totals

INF = float("inf")


# ------------------------------------------------------------------ E1-E3
def ambient_profile(cd: CellData, lower: float = 100, totals: DataFrame | None = None) -> DataFrame:
    """E1+E2: ``(gene_idx, count)`` summed over barcodes with total <= lower,
    for every gene with at least one count in the matrix (zeros kept).

    One pass over the matrix: entries are flagged ambient by a join with the
    per-cell totals and summed per gene (genes seen only outside the ambient
    set get 0)."""
    tot = totals if totals is not None else cell_totals(cd)
    flag = tot.select("cell_idx", (F.col("total") <= lower).alias("_amb"))
    return (cd.x.join(flag, "cell_idx").groupBy("gene_idx")
            .agg(F.sum(F.when(F.col("_amb"), F.col("value")).otherwise(F.lit(0.0))).alias("count")))


def ambient_proportions(cd: CellData, lower: float = 100, conf: float = 1.96,
                        totals: DataFrame | None = None) -> DataFrame:
    """``(gene_idx, count, prop)`` (written once: genes-sized, read many times)."""
    prof = materialize(ambient_profile(cd, lower, totals))
    if prof.where(F.col("count") > 0).limit(1).count() == 0:
        raise ValueError(f"no ambient counts: no barcode has a total <= {lower}")
    return materialize(good_turing_proportions(prof, "gene_idx", "count", conf))


# ------------------------------------------------------------------ E4
ALPHA_RANGE = (0.01, 10000.0)
ALPHA_DIGITS = 6   # decimals of an estimate; sums in another order agree to far more


def tail_counts(cd: CellData, props: DataFrame, ambient: DataFrame) -> DataFrame:
    """Stored ``(p, j, w)``: the Dirichlet-multinomial log-likelihood of the barcodes
    ``ambient`` (cell_idx, total) is the sum of ``w * ln(alpha * p + j)``, but for a constant.

    ``lnGamma(x + a) - lnGamma(a)`` is the sum of ``ln(a + j)`` over ``j < x``, so only
    tail counts matter: ``w`` is the number of barcodes with more than ``j`` counts of a
    gene of proportion ``p``, and minus the number with a total above ``j`` for ``p = 1``.
    Counts are made into a histogram first, so there are at most as many rows as genes
    times the largest ambient count, whatever the number of barcodes."""
    genes = (cd.x.join(ambient.select("cell_idx"), "cell_idx", "left_semi")
             .groupBy("gene_idx", "value").agg(F.count(F.lit(1)).alias("n")))
    genes = genes.join(sized(props.select("gene_idx", "prop"), PROPS_BYTES), "gene_idx").select(F.col("prop").alias("p"), F.col("value").alias("x"), "n")
    cells = ambient.groupBy(F.col("total").alias("x")).agg((-F.count(F.lit(1))).alias("n")).select(F.lit(1.0).alias("p"), "x", "n")
    both = genes.unionByName(cells).where("x > 0")
    whole = F.when(F.col("x") == F.floor("x"), F.col("x").cast("bigint")).otherwise(
        F.raise_error(F.lit("alpha needs whole counts: an ambient barcode has a fractional count")).cast("bigint"))
    # genes of one proportion (all unseen ones, say) add up: terms depend on p and j alone
    hist = both.groupBy("p", whole.alias("x")).agg(F.sum("n").alias("n"))
    steps = hist.select("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("x") - 1)).alias("j"), "n")
    return materialize(steps.groupBy("p", "j").agg(F.sum("n").cast("double").alias("w")))


def _slopes(tails: DataFrame, alphas: list[float], second: bool) -> list[float]:
    """Derivative of the log-likelihood by alpha at each of ``alphas``, and the second one
    if asked for, from one aggregation."""
    at = [F.col("p") / (F.lit(a) * F.col("p") + F.col("j")) for a in alphas]
    sums = [F.sum(F.col("w") * d) for d in at] + ([F.sum(-F.col("w") * d * d) for d in at] if second else [])
    return list(tails.agg(*[c.alias(f"s{k}") for k, c in enumerate(sums)]).first())


def estimate_alpha(cd: CellData, props: DataFrame, lower: float = 100,
                   totals: DataFrame | None = None, interval=ALPHA_RANGE, grid: int = 9, steps: int = 12) -> float:
    """MLE of the Dirichlet-multinomial concentration over ambient barcodes.

    The sign of the derivative at ``grid`` points (log scale, one aggregation) brackets
    the maximum; Newton steps in ln(alpha), each one aggregation of two plain sums over
    ``tail_counts``, then settle it (halving the bracket where a step would leave it).
    A likelihood that rises (falls) over the whole interval gives its upper (lower) end.
    """
    tot = totals if totals is not None else cell_totals(cd)
    tails = tail_counts(cd, props, tot.where(F.col("total") <= lower))
    lo, hi = math.log(interval[0]), math.log(interval[1])
    points = [lo + (hi - lo) * k / (grid - 1) for k in range(grid)]
    slopes = _slopes(tails, [math.exp(s) for s in points], second=False)
    if slopes[0] is None or slopes[-1] >= 0:
        return float(interval[1])
    if slopes[0] <= 0:
        return float(interval[0])
    k = next(i for i, d in enumerate(slopes) if d <= 0)
    lo, hi = points[k - 1], points[k]
    s = (lo + hi) / 2
    for _ in range(steps):
        a = math.exp(s)
        d1, d2 = _slopes(tails, [a], second=True)
        lo, hi = (s, hi) if d1 > 0 else (lo, s)
        slope, bend = a * d1, a * d1 + a * a * d2   # by ln(alpha)
        new = s - slope / bend if bend < 0 else (lo + hi) / 2
        new = new if lo <= new <= hi else (lo + hi) / 2
        done, s = abs(new - s) < 1e-11, new
        if done:
            break
    return round(min(max(math.exp(s), interval[0]), interval[1]), ALPHA_DIGITS)


# ------------------------------------------------------------------ E5
def log_likelihoods(cd: CellData, props: DataFrame, alpha: float, cells: DataFrame) -> DataFrame:
    """E5: ``(cell_idx, total, loglik)`` for the barcodes in ``cells``."""
    entries = (cd.x.join(cells.select("cell_idx"), "cell_idx", "left_semi")
               .join(sized(props.select("gene_idx", "prop"), PROPS_BYTES), "gene_idx"))
    x = F.col("value")
    p = F.when(F.col("prop") > 0, F.col("prop")).otherwise(
        F.raise_error(F.concat(F.lit("gene without a positive proportion: "), F.col("gene_idx").cast("string"))).cast("double"))
    if math.isinf(alpha):
        term = x * F.log(p) - lgamma(x + 1)
    else:
        term = lgamma(x + alpha * p) - lgamma(x + 1) - lgamma(alpha * p)
    per_cell = entries.groupBy("cell_idx").agg(F.sum(term).alias("s"), F.sum(x).alias("total"))
    t = F.col("total")
    if math.isinf(alpha):
        const = lgamma(t + 1)
    else:
        const = lgamma(t + 1) + lgamma(F.lit(alpha)) - lgamma(t + alpha)
    return per_cell.select("cell_idx", "total", (const + F.col("s")).alias("loglik"))


# ------------------------------------------------------------------ E6
LIKELIHOOD_DIGITS = 6  # log-likelihoods that agree to here are ties (rounding of sums in another order)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash (numbers below 2 ** 32 held in uint64)."""
    low = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & low
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & low
    return x ^ (x >> np.uint64(16))


TURNS = (0x9E3779B9, 0x85EBCA6B)  # fixed values: what sets the streams of an iteration apart
MAX_GENES = 1 << 24   # proportions that are sent to every task (8 bytes each)
PROPS_BYTES = 16 << 20   # files of proportions up to which they are a broadcast join side: tables of genes take many times that in the driver
LEVELS = 100_000      # observed likelihoods that one task counts against
CHUNK = 1 << 20       # simulated values held at a time


def uniforms(seed: int, iteration: int, n: int, stream: int = 0) -> np.ndarray:
    """``n`` numbers in (0, 1) that depend on (seed, iteration, stream, position)
    alone: counter-based, so any engine with integers can repeat them."""
    low = np.uint64(0xFFFFFFFF)
    start = _mix((_mix(np.array([seed & 0xFFFFFFFF], np.uint64)) + np.uint64(iteration)) & low)
    turn = _mix((start + np.uint64(TURNS[stream])) & low)
    x = _mix(_mix((start + np.arange(1, n + 1, dtype=np.uint64)) & low) ^ turn)
    return (x.astype(np.float64) + 0.5) / 4294967296.0


def urn_draws(upto: np.ndarray, alpha: float, n: int, seed: int, iteration: int) -> np.ndarray:
    """``n`` draws from genes with cumulative proportions ``upto``.

    Finite ``alpha``: a Polya urn.  Draw ``j`` (from 1) repeats one of the ``j - 1``
    earlier draws, each alike, with probability ``(j - 1) / (j - 1 + alpha)``, else it is a
    fresh draw from the proportions.  Counts of such draws are Dirichlet-multinomial,
    and uniforms are all it takes.  Infinite ``alpha``: every draw is fresh."""
    fresh = np.minimum(np.searchsorted(upto, uniforms(seed, iteration, n), side="left"), upto.size - 1)
    if math.isinf(alpha):
        return fresh
    earlier = np.arange(n)
    at = uniforms(seed, iteration, n, stream=1) * (earlier + alpha)
    of = np.where(at < earlier, at.astype(np.int64), earlier)   # the draw repeated, or itself
    while True:   # draws point to earlier ones: as many rounds as the logarithm of the longest chain
        further = of[of]
        if (further == of).all():
            return fresh[of]
        of = further


def _cumulative(props: np.ndarray) -> np.ndarray:
    return np.cumsum(props / props.sum())


def _simulate(props: np.ndarray, alpha: float, totals: np.ndarray, seed: int, iteration: int,
              upto: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood of one simulated draw path read at each total (sorted).

    ``upto`` (cumulative proportions) is as long as there are genes: callers with many
    iterations make it once, so that a path costs its draws and not the genes."""
    t_max = int(totals[-1])
    draws = urn_draws(_cumulative(props) if upto is None else upto, alpha, t_max, seed, iteration)
    order = np.argsort(draws, kind="stable")
    sd = draws[order]
    starts = np.r_[0, np.flatnonzero(sd[1:] != sd[:-1]) + 1]
    run_start = np.repeat(starts, np.diff(np.r_[starts, sd.size]))
    before = np.empty(t_max, dtype=np.float64)
    before[order] = np.arange(t_max) - run_start  # earlier draws of the same gene
    j = np.arange(1, t_max + 1, dtype=np.float64)
    pg = props[draws]
    if math.isinf(alpha):
        inc = np.log(j) - np.log(before + 1) + np.log(pg)
    else:
        inc = np.log(j) - np.log(j - 1 + alpha) + np.log(before + alpha * pg) - np.log(before + 1)
    path = np.cumsum(inc)
    return path[totals.astype(np.int64) - 1]


def _counted(levels: pd.DataFrame, props: np.ndarray, alpha: float, iterations: range, seed: int) -> pd.DataFrame:
    """``(total, level, below)``: simulated values of each total that are at most the level."""
    levels = levels.sort_values(["total", "level"], ignore_index=True)
    totals, first = np.unique(levels["total"].to_numpy(), return_index=True)
    ends, level = np.r_[first[1:], len(levels)], levels["level"].to_numpy()
    hits = np.zeros(len(levels), np.int64)   # values that come just below a level, or equal it
    step = max(1, CHUNK // len(totals))
    cumulative = _cumulative(props)
    for begin in range(0, len(iterations), step):
        sims = np.stack([_simulate(props, alpha, totals, seed, i, cumulative) for i in iterations[begin:begin + step]]).round(LIKELIHOOD_DIGITS)
        for k, (lo, hi) in enumerate(zip(first.tolist(), ends.tolist())):
            place = np.searchsorted(level[lo:hi], sims[:, k], side="left")
            hits[lo:hi] += np.bincount(place, minlength=hi - lo + 1)[:hi - lo]
    upto = np.cumsum(hits)
    levels["below"] = upto - np.repeat(np.r_[0, upto][first], ends - first)
    return levels


def simulated_below(observed: DataFrame, props: np.ndarray, alpha: float, iters: int, seed: int = 0,
                    shares: int | None = None, most: int = LEVELS) -> DataFrame:
    """``(total, level, below)`` for the distinct observed ``(total, level)``: how many of
    ``iters`` simulated likelihoods of that total are at most the level.

    Observed levels are cut, in order of (total, level), into blocks of about ``most`` rows, and
    iterations into ``shares``; a task simulates its iterations up to the largest total
    of its block and counts them against the block's sorted levels.  It returns one
    counter per level, so what leaves the simulation does not grow with ``iters``, and
    a total with any number of levels is split like all others."""
    from cellgrid.session import ship_package

    spark = observed.sparkSession
    ship_package(spark)
    if props.size > MAX_GENES:
        raise ValueError(f"{props.size} genes with a proportion; every task gets all of them, up to {MAX_GENES}")
    b_props = spark.sparkContext.broadcast(props.astype(np.float64, copy=False))   # bounded by MAX_GENES
    blocks = max(1, -(-observed.count() // most))
    # several shares a core: groups are dealt by hash, so cores get unequal numbers of them
    shares = shares or max(1, min(iters, -(-4 * spark.sparkContext.defaultParallelism // blocks)))
    obs = observed.select("total", "level")
    if blocks > 1:
        obs = materialize(obs.repartitionByRange(blocks, "total", "level").withColumn("block", F.spark_partition_id()))
    else:
        obs = obs.withColumn("block", F.lit(0))
    work = obs.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # a task a group: left to itself Spark would merge these few rows into one task
    work = work.repartition(blocks * shares, "block", "share")

    def run(key: tuple, levels: pd.DataFrame) -> pd.DataFrame:
        return _counted(levels[["total", "level"]], b_props.value, alpha, range(int(key[1]), iters, shares), seed)

    part = work.groupBy("block", "share").applyInPandas(run, "total double, level double, below bigint")
    return part.groupBy("total", "level").agg(F.sum("below").alias("below"))


def _ordered_proportions(props: DataFrame) -> np.ndarray:
    """Proportions by ``gene_idx``, 8 bytes a gene: without Arrow every gene would be a row object of the driver's."""
    return props.orderBy("gene_idx").select("prop").toArrow()["prop"].to_numpy()


def monte_carlo_pvalues(cd: CellData, props: DataFrame, alpha: float, tested: DataFrame,
                        iters: int = 10000, seed: int = 0) -> DataFrame:
    """``(cell_idx, total, loglik, pvalue)`` for the barcodes in ``tested``.
    The model draws whole counts: fractional totals are refused."""
    ll = materialize(log_likelihoods(cd, props, alpha, tested).withColumn("level", F.round("loglik", LIKELIHOOD_DIGITS)))
    bad = (F.col("total") != F.floor("total")) | (F.col("total") < 1)
    if not ll.where(bad).isEmpty():
        raise ValueError("emptyDrops needs whole counts: a tested barcode has a fractional total")
    prof = _ordered_proportions(props)
    observed = materialize(ll.select(F.col("total").cast("double").alias("total"), "level").distinct())
    below = simulated_below(observed, prof, float(alpha), iters, seed)
    # written once: BH, the filter and the dispersion test all read it, and the
    # simulation must not run again for each of them
    return materialize(ll.join(below, ["total", "level"]).select(
        "cell_idx", "total", "loglik", ((F.col("below") + 1) / F.lit(iters + 1.0)).alias("pvalue")))


# ------------------------------------------------------------------ E7-E9
def emptydrops_table(cd: CellData, lower: float = 100, iters: int = 10000, retain: float | None = None,
                     alpha: float | None = INF, seed: int = 0, conf: float = 1.96,
                     test_ambient: bool = False) -> tuple[DataFrame, dict]:
    """``(cell_idx, total, loglik, pvalue, limited, fdr)`` for every barcode
    with counts; untested barcodes have null p-value and FDR.  Returns the
    frame and the resolved parameters (lower, alpha, retain)."""
    from cellgrid.operators.ranks import knee_inflection

    tot = materialize(cell_totals(cd))  # cells-sized; the matrix is aggregated once
    props = ambient_proportions(cd, lower, conf, tot)
    if alpha is None:
        alpha = estimate_alpha(cd, props, lower, tot)

    if test_ambient:
        retain = INF
    elif retain is None:
        retain, _ = knee_inflection(cd, lower=lower, totals=tot)
    tested = tot.where((F.col("total") > 0) & (F.col("total") <= lower)) if test_ambient else tot.where(F.col("total") > lower)
    # p is forced to 0 at or above retain: no need to simulate up there
    to_sim = tested if test_ambient else tested.where(F.col("total") < retain)
    mc = monte_carlo_pvalues(cd, props, alpha, to_sim, iters, seed)
    out = (tot.join(mc.select("cell_idx", "loglik", "pvalue"), "cell_idx", "left")
           .withColumn("tested", (F.col("total") > 0) & (F.col("total") <= lower) if test_ambient else F.col("total") > lower)
           .withColumn("pvalue", F.when(~F.col("tested"), F.lit(None).cast("double"))
                       .when((F.col("total") >= retain) & F.lit(not test_ambient), F.lit(0.0))
                       .otherwise(F.col("pvalue"))))
    out = bh_adjust(out, "pvalue", "fdr")
    return out.drop("tested"), {"lower": float(lower), "alpha": float(alpha), "retain": float(retain)}


def filter_emptydrops(cd: CellData, lower: float = 100, iters: int = 10000, retain: float | None = None,
                      fdr: float = 0.001, cellranger: bool = False, expect_cells: int = 3000,
                      keep_all: bool = False, alpha: float | None = None, seed: int = 0) -> CellData:
    """Annotate ``emptydrops_fdr``, save parameters, keep ``fdr <= cutoff``."""
    from cellgrid.operators.select import select_cells
    from cellgrid.operators.totals import cr_thresholds, with_total_umis

    if cellranger:
        cd = with_total_umis(cd)  # stays with the result
        lower, retain = cr_thresholds(cd, expect_cells)
        alpha, fdr = INF, 0.01
    table, got = emptydrops_table(cd, lower=lower, iters=iters, retain=retain, alpha=alpha, seed=seed)
    cells = cd.cells.drop("emptydrops_fdr").join(
        table.select("cell_idx", F.col("fdr").alias("emptydrops_fdr")), "cell_idx", "left")
    out = cd.replace(cells=cells)
    desc = (f"Called cells against the ambient profile of barcodes up to {got['lower']:g} counts "
            f"(concentration {got['alpha']:g}, kept without a test from {got['retain']:g} counts)")
    out = out.add_history({"method": "emptydrops", "lower": lower, "iters": iters, "retain": retain,
                           "fdr": fdr, "cellranger": cellranger, "expect_cells": expect_cells,
                           "keep": keep_all, "alpha": alpha, "seed": seed}, desc)
    for k in ("lower", "alpha", "retain"):
        out = out.set_parameter("emptydrops", k, got[k])
    out = out.set_parameter("emptydrops", "fdr_cutoff", fdr)
    if not keep_all:
        out = select_cells(out, f"emptydrops_fdr <= {fdr}")
    return out


def ambient_pvalues(cd: CellData, lower: float = 100, alpha: float | None = None, iters: int = 10000,
                    seed: int = 0) -> DataFrame:
    """P-values of the ambient barcodes themselves (0 < total <= lower)."""
    table, _ = emptydrops_table(cd, lower=lower, iters=iters, alpha=alpha, seed=seed, test_ambient=True)
    return table.where((F.col("total") > 0) & (F.col("total") <= lower)).select("cell_idx", "total", "pvalue")
