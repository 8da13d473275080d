"""Barcode ranks, knee and inflection, and the tables behind rank plots.

All global-order work runs on the histogram of distinct totals: ranks are
``cum_before + (n + 1) / 2`` (average rank of ties), the "next point" of the
curve is an equi-join on the histogram position ``i + 1``, and argmin/argmax
are ordinary aggregates over structs.  No cell-level sort, no single-partition
window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.positions import materialize, running_sums
from cellgrid.operators.totals import cell_totals


def rank_histogram(totals: DataFrame) -> DataFrame:
    """``(total, n, i, rank)`` over distinct positive totals, ``i`` = 1-based
    position in descending order, ``rank`` = average rank of the tied cells."""
    h = totals.where(F.col("total") > 0).groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    h = running_sums(h, [F.col("total").desc()], {"cum": F.col("n"), "i": F.lit(1)})
    return h.select("total", "n", F.col("i").cast("bigint").alias("i"),
                    (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def barcode_ranks(cd: CellData) -> DataFrame:
    """``(cell_idx, cell_id, total, rank)`` for cells with counts."""
    tot = materialize(cell_totals(cd))  # used twice: histogram and join back
    hist = rank_histogram(tot)
    ranked = tot.join(hist.select("total", "rank"), "total")
    return ranked.join(cd.cells.select("cell_idx", "cell_id"), "cell_idx").select(
        "cell_idx", "cell_id", "total", "rank")


def knee_inflection_frame(hist: DataFrame, lower: float = 100, exclude_from: float = 50) -> DataFrame:
    """W2/W3 as one row ``(knee, inflection, left_total, right_total, n_points)``.

    Points are the distinct totals above ``lower`` at ``(log10 rank, log10 total)``.
    Slopes go to the next point; the first ``min(m-2, #rank <= exclude_from)``
    slopes are skipped.  Right edge = first steepest (minimum) slope, its total
    is the inflection; left edge = first maximum slope at or before it.  The
    knee is the interior point between the edges highest above the chord
    joining them (the left edge if there is no interior point).
    """
    # distinct totals only; written once because every scalar below reads it
    p = materialize(hist.where(F.col("total") > lower).select(
        "i", "total", F.log10("rank").alias("x"), F.log10("total").alias("y")))
    mk = p.agg(F.count(F.lit(1)).alias("m"),
               F.count_if(F.col("x") <= F.log10(F.lit(float(exclude_from)))).alias("k")).first()
    m, k = mk["m"], mk["k"]
    if m < 3:
        return p.agg(F.count(F.lit(1)).alias("n_points")).select(
            F.lit(None).cast("double").alias("knee"), F.lit(None).cast("double").alias("inflection"),
            F.lit(None).cast("double").alias("left_total"), F.lit(None).cast("double").alias("right_total"),
            "n_points")
    skip = min(m - 2, k)
    q = p.select((F.col("i") - 1).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    slopes = materialize(
        p.join(q, "i").select("i", ((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("d"))
        .where(F.col("i") > skip))
    right = slopes.agg(F.min(F.struct("d", "i"))["i"]).first()[0]
    left = -slopes.where(F.col("i") <= right).agg(
        F.max(F.struct(F.col("d"), (-F.col("i")).alias("ni")))["ni"]).first()[0]
    edges = {r["i"]: r for r in p.where(F.col("i").isin(left, right)).collect()}  # two rows
    pl, pr = edges[left], edges[right]
    xl, yl, xr, yr = pl["x"], pl["y"], pr["x"], pr["y"]
    interior = p.where((F.col("i") > left) & (F.col("i") < right)).select(
        "i", "total", (F.col("y") - (F.lit(yl) + F.lit(yr - yl) * (F.col("x") - F.lit(xl)) / F.lit(xr - xl)))
        .alias("dist"))
    knee_interior = interior.agg(
        F.max(F.struct(F.col("dist"), (-F.col("i")).alias("ni"), F.col("total")))["total"]).first()[0]
    knee = knee_interior if knee_interior is not None else pl["total"]
    return p.agg(F.count(F.lit(1)).alias("n_points")).select(
        F.lit(float(knee)).alias("knee"), F.lit(float(pr["total"])).alias("inflection"),
        F.lit(float(pl["total"])).alias("left_total"), F.lit(float(pr["total"])).alias("right_total"), "n_points")


def knee_inflection(cd: CellData, lower: float = 100, exclude_from: float = 50,
                    totals: DataFrame | None = None) -> tuple[float, float]:
    hist = rank_histogram(totals if totals is not None else cell_totals(cd))
    row = knee_inflection_frame(hist, lower, exclude_from).first()
    if row["n_points"] < 3 or row["knee"] is None:
        raise ValueError("insufficient unique points for computing knee/inflection points")
    return float(row["knee"]), float(row["inflection"])


def _algorithm(cd: CellData) -> str:
    """emptyDrops parameters win, then classic, else unfiltered."""
    if "emptydrops" in cd.params:
        return "emptydrops"
    if "classic_filter" in cd.params:
        return "classic"
    return "unfiltered"


def rank_plot_table(cd: CellData, algorithm: str | None = None) -> DataFrame:
    """``(cell_id, total, rank, segment)``; a point on a threshold
    belongs to both neighbouring segments (one row each)."""
    algorithm = algorithm or _algorithm(cd)
    ranks = barcode_ranks(cd)
    t = F.col("total")
    if algorithm == "emptydrops":
        retain = float(cd.get_parameter("emptydrops", "retain"))
        lower = float(cd.get_parameter("emptydrops", "lower"))
        segs = F.array(F.when(t >= retain, F.lit("retained")),
                       F.when((t <= retain) & (t >= lower), F.lit("middle")),
                       F.when(t <= lower, F.lit("ambient")))
    elif algorithm == "classic":
        thr = float(cd.get_parameter("classic_filter", "threshold"))
        segs = F.array(F.when(t >= thr, F.lit("retained")), F.when(t <= thr, F.lit("discarded")))
    else:
        segs = F.array(F.lit("all"))
    return ranks.select("cell_id", "total", "rank",
                        F.explode(F.filter(segs, lambda s: s.isNotNull())).alias("segment"))


def label_point(hist: DataFrame, cutoff) -> DataFrame:
    """The last-ranked point with ``total >= cutoff`` -> ``(rank, total)``."""
    return hist.where(F.col("total") >= cutoff).agg(
        F.max(F.struct("rank", "total")).alias("p")).select(
        F.col("p.rank").alias("rank"), F.col("p.total").alias("total"))


def rank_plot_summary(cd: CellData, algorithm: str | None = None) -> DataFrame:
    """One row: algorithm, passing cells, knee/inflection and their label points."""
    algorithm = algorithm or _algorithm(cd)
    lower = float(cd.get_parameter("emptydrops", "lower")) if algorithm == "emptydrops" else 50.0
    hist = materialize(rank_histogram(cell_totals(cd)))
    ki = knee_inflection_frame(hist, lower)
    kv = ki.first()
    knee, infl = F.lit(kv["knee"]), F.lit(kv["inflection"])
    kp, ip = label_point(hist, knee), label_point(hist, infl)
    if algorithm == "emptydrops":
        cut = float(cd.get_parameter("emptydrops", "fdr_cutoff"))
        passing = cd.cells.agg(F.count_if(F.col("emptydrops_fdr") <= cut)).scalar()
    elif algorithm == "classic":
        thr = float(cd.get_parameter("classic_filter", "threshold"))
        passing = cd.cells.agg(F.count_if(F.col("total_umis") >= thr)).scalar()
    else:
        passing = cd.cells.agg(F.count(F.lit(1))).scalar()
    return ki.select(F.lit(algorithm).alias("algorithm"), passing.alias("passing"), "knee", "inflection",
                     kp.select("rank").scalar().alias("knee_rank"), kp.select("total").scalar().alias("knee_total"),
                     ip.select("rank").scalar().alias("inflection_rank"),
                     ip.select("total").scalar().alias("inflection_total"))
