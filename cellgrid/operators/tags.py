"""Viral-tag lineage from paired reads.

Read 1 = cell barcode (16) + UMI (10) + poly-T; read 2 = 14-base tag +
``TGGT`` + 30-base tag.  Both tags are matched to their libraries: exactly,
else the first library entry (file order) within Hamming distance 2.
Reads (not UMIs) are counted per cell and tag pair; pairs seen more than
once are confident; one confident pair names the cell's tag, more make it a
doublet.

Matching runs on *distinct* observed sequences.  Approximate matching uses
the pigeonhole principle: cut both sequences into three pieces; two strings
within distance 2 share at least one identical piece, so candidates come
from an equi-join on ``(length, piece number, piece)`` and are verified with
an exact Hamming count.  No cross join is formed.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.joins import hot_keys, salted_join
from cellgrid.functions.positions import materialize

log = logging.getLogger("cellgrid")

# Fixed read layout (1-based Spark substrings)
R1_CELL = (1, 16)
R1_UMI = (17, 10)
R1_POLY_T = (27, 4, "TTTT")
R2_BC14 = (1, 14)
R2_LINK = (15, 4, "TGGT")
R2_BC30 = (19, 30)
MAX_DISTANCE = 2  # accept Hamming distance < 3


def hamming(a: Column, b: Column, most: int = 30) -> Column:
    """Number of differing positions of two equal-length strings (null otherwise).

    The first ``most`` positions (the longest tag) are a plain sum of
    comparisons, which stays in generated code; only longer strings walk the
    rest position by position."""
    same = sum((F.when(F.substring(a, i, 1) == F.substring(b, i, 1), 0).otherwise(1) for i in range(1, most + 1)), F.lit(0))
    rest = F.aggregate(F.sequence(F.lit(most + 1), F.length(a)), F.lit(0),
                       lambda acc, i: acc + F.when(F.substring(a, i, 1) == F.substring(b, i, 1), 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), same + F.when(F.length(a) > most, rest).otherwise(0))


def parse_r1(reads: DataFrame) -> DataFrame:
    """``cell``, ``umi``; reads without ``TTTT`` at 27-30 dropped."""
    r1 = F.col("r1")
    return (reads.where(F.substring(r1, R1_POLY_T[0], R1_POLY_T[1]) == R1_POLY_T[2])
            .withColumn("cell", F.substring(r1, *R1_CELL))
            .withColumn("umi", F.substring(r1, *R1_UMI)))


def parse_r2(reads: DataFrame) -> DataFrame:
    """``bc14``, ``bc30``; reads without ``TGGT`` at 15-18 dropped."""
    r2 = F.col("r2")
    return (reads.where(F.substring(r2, R2_LINK[0], R2_LINK[1]) == R2_LINK[2])
            .withColumn("bc14", F.substring(r2, *R2_BC14))
            .withColumn("bc30", F.substring(r2, *R2_BC30)))


def parse_pairs(reads: DataFrame) -> DataFrame:
    """Both reads must parse -> ``(cell, umi, bc14, bc30)`` plus passthrough columns."""
    return parse_r2(parse_r1(reads)).drop("r1", "r2")


def whitelist(cells: DataFrame) -> DataFrame:
    """Barcodes with their last ``-...`` part removed -> ``(cell)``."""
    return cells.select(F.regexp_replace("cell_id", "-[^-]*$", "").alias("cell")).distinct()


def library(lib: DataFrame) -> DataFrame:
    """S8 rule on a ``(pos, tag_id, seq)`` frame: a repeated sequence keeps its
    first position and takes the last id."""
    return lib.groupBy("seq").agg(F.min("pos").alias("pos"), F.max_by("tag_id", "pos").alias("tag_id"))


def _pieces(seq: Column) -> Column:
    """Three pieces ``[(k, piece)]`` covering the sequence (lengths differ by at most 1)."""
    n = F.length(seq)
    a = F.floor((n + 2) / 3).cast("int")
    b = F.floor((n + 1) / 3).cast("int")
    return F.array(F.struct(F.lit(0).alias("k"), F.substring(seq, F.lit(1), a).alias("piece")),
                   F.struct(F.lit(1).alias("k"), F.substring(seq, a + 1, b).alias("piece")),
                   F.struct(F.lit(2).alias("k"), F.substring(seq, a + b + 1, n).alias("piece")))


def match_tags(observed: DataFrame, lib: DataFrame) -> DataFrame:
    """T4 + T5: distinct ``seq`` -> ``(seq, tag_id, exact)``; unmatched absent."""
    lib = library(lib)
    seqs = observed.select("seq").where(F.col("seq").isNotNull()).distinct()
    exact = seqs.join(lib, "seq").select("seq", "tag_id", F.lit(True).alias("exact"))
    rest = seqs.join(lib.select("seq"), "seq", "left_anti")
    obs_p = rest.select("seq", F.length("seq").alias("len"), F.explode(_pieces(F.col("seq"))).alias("p")) \
        .select("seq", "len", "p.k", "p.piece")
    lib_p = lib.select(F.col("seq").alias("lib_seq"), "pos", "tag_id", F.length("seq").alias("len"),
                       F.explode(_pieces(F.col("seq"))).alias("p")).select("lib_seq", "pos", "tag_id", "len",
                                                                           "p.k", "p.piece")
    cand = (obs_p.join(lib_p, ["len", "k", "piece"])
            .select("seq", "lib_seq", "pos", "tag_id").distinct())
    near = cand.where(hamming(F.col("seq"), F.col("lib_seq")) <= MAX_DISTANCE)
    corrected = near.groupBy("seq").agg(F.min_by("tag_id", "pos").alias("tag_id")) \
        .select("seq", "tag_id", F.lit(False).alias("exact"))
    return exact.unionByName(corrected)


KMER_BLOCK = 50_000  # library entries that are compared in one pass (25 MB as a dense matrix)


def _kmer_counts(seqs) -> "np.ndarray":
    """64-bin ACGT 3-mer counts for each sequence (other 3-mers ignored)."""
    import numpy as np

    code = np.full(256, -1, dtype=np.int64)
    for i, b in enumerate(b"ACGT"):
        code[b] = i
    out = np.zeros((len(seqs), 64), dtype=np.float64)
    for r, s in enumerate(seqs):
        c = code[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)]
        if c.size < 3:
            continue
        k = c[:-2] * 16 + c[1:-1] * 4 + c[2:]
        ok = (c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0)
        out[r] = np.bincount(k[ok], minlength=64)
    return out


def kmer_nearest(observed: DataFrame, lib: DataFrame, block: int = KMER_BLOCK) -> DataFrame:
    """Nearest library entry by cosine distance of ACGT 3-mer counts.

    Other 3-mers are ignored; ties go to file order; a sequence sharing no
    3-mer with the library gets no row.  With only 64 possible 3-mers almost
    every pair shares one, so there is nothing to look up: the library is the
    query set, taken in blocks of ``block`` entries.  A block is one dense
    ``entries x 64`` matrix (bounded, broadcast) that every batch of distinct
    observed sequences is multiplied with; the best of all blocks remains.
    """
    import numpy as np
    import pandas as pd

    from cellgrid.functions.positions import dense_positions
    from cellgrid.session import ship_package

    spark = observed.sparkSession
    ship_package(spark)
    numbered = materialize(dense_positions(library(lib).select("tag_id", "seq", "pos"), [F.col("pos")], name="_n"))
    seqs = materialize(observed.select("seq").where(F.col("seq").isNotNull()).distinct())
    found = None
    for start in range(0, numbered.count(), block):
        rows = numbered.where((F.col("_n") >= start) & (F.col("_n") < start + block)).orderBy("_n").collect()
        mat = _kmer_counts([r["seq"] for r in rows])
        sent = spark.sparkContext.broadcast(([r["tag_id"] for r in rows], mat, np.linalg.norm(mat, axis=1)))

        def score(batches, sent=sent, start=start):
            ids, lm, ln = sent.value
            chunk = max(1, 5_000_000 // max(1, lm.shape[0]))
            for pdf in batches:
                names = pdf["seq"].tolist()
                for a in range(0, len(names), chunk):
                    part = names[a:a + chunk]
                    om = _kmer_counts(part)
                    dots = om @ lm.T
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dist = 1.0 - dots / (np.linalg.norm(om, axis=1)[:, None] * ln[None, :])
                    dist[dots <= 0] = np.inf  # no shared 3-mer: not a candidate
                    best = np.argmin(dist, axis=1)  # first index = file order on ties
                    near = dist[np.arange(len(part)), best]
                    keep = np.flatnonzero(np.isfinite(near))
                    yield pd.DataFrame({"seq": [part[i] for i in keep], "distance": near[keep], "n": best[keep] + start,
                                        "tag_id": [ids[best[i]] for i in keep]})

        one = seqs.mapInPandas(score, "seq string, distance double, n bigint, tag_id string")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "seq string, tag_id string, distance double")
    best = found.groupBy("seq").agg(F.min(F.struct("distance", "n", "tag_id")).alias("b"))
    return best.select("seq", F.col("b.tag_id").alias("tag_id"), F.col("b.distance").alias("distance"))


def tag_counts(pairs: DataFrame, bc14: DataFrame, bc30: DataFrame) -> DataFrame:
    """``(cell, tag, n_reads)`` with ``tag = id14:id30``; both halves must match.

    The reads are passed over once: they are first counted per distinct
    ``(cell, bc14, bc30)`` (partial aggregation on the map side, so a cell
    holding a large share of the reads is pre-reduced in every task).  That
    much smaller table is written once and feeds both tag matchings and the
    final count.  Tags that most combinations hold are dealt to several tasks
    with copies of their match.
    """
    combos = materialize(pairs.groupBy("cell", "bc14", "bc30").agg(F.count(F.lit(1)).alias("n")))
    m14 = match_tags(combos.select(F.col("bc14").alias("seq")), bc14).select(
        F.col("seq").alias("bc14"), F.col("tag_id").alias("id14"))
    m30 = match_tags(combos.select(F.col("bc30").alias("seq")), bc30).select(
        F.col("seq").alias("bc30"), F.col("tag_id").alias("id30"))
    matched = salted_join(combos, m14, "bc14", hot_keys(combos, "bc14"))
    matched = salted_join(matched, m30, "bc30", hot_keys(combos, "bc30"))
    return (matched.groupBy("cell", F.concat_ws(":", "id14", "id30").alias("tag"))
            .agg(F.sum("n").alias("n_reads")))


def confident(counts: DataFrame) -> DataFrame:
    """Pairs seen more than once."""
    return counts.where(F.col("n_reads") > 1)


def cell_calls(conf: DataFrame) -> DataFrame:
    """``(cell, n_tags, tag)`` for every counted cell with a confident tag."""
    return conf.groupBy("cell").agg(F.count(F.lit(1)).alias("n_tags"), F.max("tag").alias("tag"))


def assign(cells: DataFrame, calls: DataFrame, id_suffix: str = "") -> DataFrame:
    """``doublet`` (more than one confident tag) and ``tags`` (the one tag, or '')."""
    calls = calls.select(F.concat(F.col("cell"), F.lit(id_suffix)).alias("cell_id"),
                         (F.col("n_tags") > 1).alias("_dbl"),
                         F.when(F.col("n_tags") == 1, F.col("tag")).alias("_tag"))
    out = cells.drop("doublet", "tags").join(calls, "cell_id", "left")
    return (out.withColumn("doublet", F.coalesce(F.col("_dbl"), F.lit(False)))
            .withColumn("tags", F.coalesce(F.col("_tag"), F.lit(""))).drop("_dbl", "_tag"))


def tag_summary(calls: DataFrame) -> DataFrame:
    """Confidently assigned and doublet counts over counted cells."""
    return calls.agg(F.count_if(F.col("n_tags") == 1).alias("assigned"),
                     F.count_if(F.col("n_tags") > 1).alias("doublets"))


def tag_calls(cells: DataFrame, reads: DataFrame, bc14: DataFrame, bc30: DataFrame) -> DataFrame:
    """T1-T8 + J8: per-cell confident calls from raw read pairs."""
    pairs = parse_pairs(reads).join(whitelist(cells), "cell", "left_semi")
    return cell_calls(confident(tag_counts(pairs, bc14, bc30)))


def annotate_tags(cd: CellData, reads: DataFrame, bc14: DataFrame, bc30: DataFrame,
                  id_suffix: str = "", fastqs: tuple = (), log_summary: bool = True) -> CellData:
    """Whole lineage step on a dataset: adds ``doublet`` and ``tags`` to cells."""
    calls = tag_calls(cd.cells, reads, bc14, bc30)
    cells = assign(cd.cells, calls, id_suffix)
    if log_summary:
        s = tag_summary(calls).first()
        log.info("%s cells carry one tag, %s carry several", s["assigned"], s["doublets"])
        if not id_suffix:
            matched = calls.join(cd.cells.select(F.col("cell_id").alias("cell")), "cell", "left_semi").count()
            if matched == 0 and (s["assigned"] or s["doublets"]):
                log.warning("no counted cell matches a barcode; is an id suffix such as '-1' missing?")
    desc = "Lineage tags called" + (f" from read pairs in {', '.join(map(str, fastqs))}" if fastqs else "")
    return cd.replace(cells=cells).add_history({"subcommand": "cellecta", "fastqs": list(fastqs),
                                                "id_suffix": id_suffix}, desc)
