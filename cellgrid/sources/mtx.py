"""Matrix Market, 10x and bustools readers.

A Matrix Market file is read as text in parallel (gz files are one split
each).  Comment lines start with ``%``; the first other line holds the
dimensions.  A real triplet can look exactly like that line, so the line is
removed by its position (read from the file head on the driver), never by
value.  One pass over the file checks every entry and their declared number.  Repeated entries are summed.
Names of rows/columns come from the side files, numbered by line with
distributed positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.names import make_unique
from cellgrid.sources.paths import data_files, exists, first_existing, head_line, is_dir, require_exists
from cellgrid.sources.mtx_lines import drop_line
from cellgrid.sources.tables import numbered_lines


def read_mtx_triplets(spark: SparkSession, path: str) -> tuple[DataFrame, int, int, int]:
    """``(row, col, value)`` 0-based, and the dims line.

    The header (``%`` lines, then the dimensions) is read on the driver, line by
    line, through as many part files as hold only comments; the dimensions
    line is then dropped by its line number inside the first split of its file,
    so a triplet that looks the same is kept and the matrix is read exactly
    once.  ``symmetric`` and ``skew-symmetric`` files store one triangle: the other
    is added.  Entries that are unreadable, outside the declared dimensions,
    or not numbers fail the read.
    """
    require_exists(spark, path)
    files = data_files(spark, path)
    banner, found = "", None
    for k, f in enumerate(files):
        if k == 0:
            first, _, any_line = head_line(spark, f, lambda ln: True)
            banner = first.lower() if any_line and first.startswith("%%") else ""
        line, at, hit = head_line(spark, f, lambda ln: bool(ln.strip()) and not ln.lstrip().startswith("%"))
        if hit:
            found = (k, at, line)
            break
    if found is None:
        raise ValueError(f"{path} holds no Matrix Market dimensions line")
    words = banner.split()
    if "array" in words or "complex" in words or "hermitian" in words:
        raise ValueError(f"{path}: only real, integer or pattern coordinate files can be read, not {banner.strip()!r}")
    pattern = "pattern" in words
    sign = -1.0 if "skew-symmetric" in words else 1.0 if "symmetric" in words else None
    k, line_no, dims_line = found
    dims = dims_line.split()
    if len(dims) != 3 or not all(d.isdigit() for d in dims):
        raise ValueError(f"{path}: dimensions line should be 'rows cols entries', got {dims_line!r}")
    n_rows, n_cols, n_entries = (int(d) for d in dims)
    text = drop_line(spark.read.text(files[k]), line_no)
    others = files[:k] + files[k + 1:]
    if others:
        text = text.unionByName(spark.read.text(others))
    body = text.select(F.trim("value").alias("line")).where(
        (F.length("line") > 0) & ~F.col("line").startswith("%"))
    # one blank between fields is the rule; a pattern costs several times a plain split
    plain = ~F.col("line").contains("  ") & ~F.col("line").rlike(r"[\t\n\x0B\f\r]")
    body = body.select("line", F.when(plain, F.split("line", " ")).otherwise(F.split("line", r"\s+")).alias("_parts"))
    parts = F.col("_parts")
    row = F.get(parts, 0).try_cast("bigint")
    col = F.get(parts, 1).try_cast("bigint")
    # a line without a third field is an entry of a pattern file (value 1)
    value = F.when(F.size(parts) == 2, F.lit(1.0)).otherwise(F.get(parts, 2).try_cast("double"))
    if not pattern and words:
        value = F.get(parts, 2).try_cast("double")
    outside = row.isNull() | col.isNull() | (row < 1) | (col < 1) | (row > n_rows) | (col > n_cols)
    unreadable = value.isNull() | F.isnan(value)
    # checked while the entries are read (no separate pass): a bad entry fails the job
    trip = body.select(
        F.when(outside, F.raise_error(F.concat(F.lit(f"{path}: entry outside the declared "
                                                     f"{n_rows} x {n_cols} matrix: "), F.col("line"))))
        .otherwise(row - 1).alias("row"),
        (col - 1).alias("col"),
        F.when(unreadable, F.raise_error(F.concat(F.lit(f"{path}: no number in entry: "), F.col("line"))))
        .otherwise(value).alias("value"))
    # the declared number of entries is compared on the same rows, in one count
    n = trip.select("row", "col", "value").agg(F.count("value")).first()[0]
    if n != n_entries:
        raise ValueError(f"{path}: the header declares {n_entries} entries, the file holds {n}")
    if sign is not None:
        other = trip.where(F.col("row") != F.col("col")).select(
            F.col("col").alias("row"), F.col("row").alias("col"), (F.col("value") * F.lit(sign)).alias("value"))
        trip = trip.unionByName(other)
    return trip, n_rows, n_cols, n_entries


def read_mtx(spark: SparkSession, path: str, transpose: bool = False, sum_repeats: bool = True) -> CellData:
    """Rows are cells as-is (``transpose=True`` for genes x cells files);
    ids are the 0-based numbers as strings.

    Repeated coordinates are summed (one shuffle by coordinate); pass
    ``sum_repeats=False`` for files known to list each entry once, which
    saves that shuffle on very large matrices.
    """
    trip, n_rows, n_cols, n_entries = read_mtx_triplets(spark, path)
    if sum_repeats:
        trip = trip.groupBy("row", "col").agg(F.sum("value").alias("value"))
    if transpose:
        n_rows, n_cols = n_cols, n_rows
        trip = trip.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    x = trip.select(F.col("row").alias("cell_idx"), F.col("col").alias("gene_idx"), "value") \
        .where(F.col("value") != 0)
    cells = spark.range(n_rows).select(F.col("id").alias("cell_idx"), F.col("id").cast("string").alias("cell_id"))
    genes = spark.range(n_cols).select(F.col("id").alias("gene_idx"), F.col("id").cast("string").alias("gene_id"))
    cd = CellData(cells=cells, genes=genes, x_raw=x)
    return cd.add_history({"input_format": "mtx", "input": path},
                          f"Imported mtx data from {path} ({n_rows} cells x {n_cols} genes)")


def _require_lines(table: DataFrame, want: int, path: str, what: str) -> None:
    """A side file names every row (or column) of the matrix, no more, no less."""
    n = table.count()
    if n != want:
        raise ValueError(f"{path} names {n} {what}, the matrix has {want}")


def _tsv_numbered(spark: SparkSession, path: str, idx: str) -> DataFrame:
    """Tab-separated side file numbered by line: ``(idx, _c0, _c1, ...)``."""
    lines = numbered_lines(spark, path, name=idx)
    parts = F.split("value", "\t")
    width = lines.select(F.max(F.size(parts))).first()[0] or 1
    return lines.select(idx, *[F.get(parts, k).alias(f"_c{k}") for k in range(width)])


def read_10x_mtx(spark: SparkSession, directory: str, gex_only: bool = True) -> CellData:
    """``matrix.mtx[.gz]`` (genes x cells), ``barcodes.tsv[.gz]``,
    ``features.tsv[.gz]`` (id, name, type) or ``genes.tsv`` (id, name).
    Gene key = unique symbol; ``gene_ids`` and ``feature_types`` kept;
    only "Gene Expression" rows unless ``gex_only=False``."""
    if not is_dir(spark, directory):
        raise ValueError(f"10x input {directory} must be a directory")
    mat = first_existing(spark, [f"{directory}/matrix.mtx.gz", f"{directory}/matrix.mtx"])
    bcs = first_existing(spark, [f"{directory}/barcodes.tsv.gz", f"{directory}/barcodes.tsv"])
    feats = first_existing(spark, [f"{directory}/features.tsv.gz", f"{directory}/features.tsv"])
    legacy = None if feats else first_existing(spark, [f"{directory}/genes.tsv", f"{directory}/genes.tsv.gz"])
    if not mat or not bcs or not (feats or legacy):
        raise ValueError(f"{directory} is not a 10x matrix directory (matrix.mtx, barcodes.tsv and "
                         "features.tsv or genes.tsv are needed)")
    cd = read_mtx(spark, mat, transpose=True)
    b = _tsv_numbered(spark, bcs, "cell_idx").select("cell_idx", F.col("_c0").alias("cell_id"))
    f = _tsv_numbered(spark, feats or legacy, "gene_idx")
    _require_lines(b, cd.cells.count(), bcs, "cells")
    _require_lines(f, cd.genes.count(), feats or legacy, "genes")
    cols = [F.col("_c0").alias("gene_ids"), F.col("_c1").alias("gene_id")]
    if feats and "_c2" in f.columns:
        cols.append(F.col("_c2").alias("feature_types"))
    genes = make_unique(f.select("gene_idx", *cols), "gene_id", "gene_idx")
    genes = genes.select("gene_idx", "gene_id", *[c for c in genes.columns if c not in ("gene_idx", "gene_id")])
    out = cd.replace(cells=b, genes=genes)
    if gex_only and feats and "feature_types" in genes.columns:
        out = out.replace(genes=genes.where(F.col("feature_types") == "Gene Expression"), genes_filtered=True)
    n_cells, n_genes = out.shape()
    out = out.replace(history=())
    return out.add_history({"input_format": "10x", "input": directory},
                           f"Imported 10x data from {directory} ({n_cells} cells x {n_genes} genes)")


def read_bustools(spark: SparkSession, base: str) -> CellData:
    """S3: ``<base>.mtx`` (cells x genes), ``<base>.genes.txt``, ``<base>.barcodes.txt``;
    first column = id, further columns become annotations."""
    names = [f"{base}.mtx", f"{base}.genes.txt", f"{base}.barcodes.txt"]
    missing = [n for n in names if not exists(spark, n)]
    if missing:
        raise ValueError(f"bustools count output incomplete, missing: {', '.join(missing)}")
    cd = read_mtx(spark, names[0])
    g = _tsv_numbered(spark, names[1], "gene_idx")
    c = _tsv_numbered(spark, names[2], "cell_idx")
    _require_lines(g, cd.genes.count(), names[1], "genes")
    _require_lines(c, cd.cells.count(), names[2], "cells")
    genes = g.select("gene_idx", F.col("_c0").alias("gene_id"),
                     *[F.col(k) for k in g.columns if k not in ("gene_idx", "_c0")])
    cells = c.select("cell_idx", F.col("_c0").alias("cell_id"),
                     *[F.col(k) for k in c.columns if k not in ("cell_idx", "_c0")])
    out = cd.replace(cells=cells, genes=genes, history=())
    n_cells, n_genes = out.shape()
    return out.add_history({"input_format": "bustools-count", "input": base},
                           f"Imported bustools-count data from {base} ({n_cells} cells x {n_genes} genes)")


def read_dataset(spark: SparkSession, path: str, fmt: str = "native") -> CellData:
    """Dispatch on the declared input format (S9 checks happen in each reader)."""
    from cellgrid.sources import native
    readers = {"native": native.load, "10x": read_10x_mtx, "mtx": read_mtx, "mex": read_mtx,
               "bustools-count": read_bustools}
    if fmt not in readers:
        raise ValueError(f"unknown input format {fmt!r}; choose from {sorted(readers)}")
    if fmt in ("mtx", "mex") and not (path.endswith(".mtx") or path.endswith(".mtx.gz")):
        raise ValueError(f"{fmt} input must be a .mtx or .mtx.gz file")
    return readers[fmt](spark, path)
