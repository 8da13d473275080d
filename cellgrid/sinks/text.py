"""Text exports: MEX directory (K2), cell/gene tables (K3, K4), dense matrix (K5).

Each output "file" is written by Spark as a folder of ordered, gzip-able part
files; concatenating the parts in byte order of their names (``LC_ALL=C``)
gives the single file (gzip members concatenate into a valid gzip stream).  For small
outputs ``single_file=True`` writes one part and moves it to the exact name
through the Hadoop file system (no data passes through the driver).
Existing targets are refused unless ``overwrite`` (K6).
"""

from __future__ import annotations

import csv
import io
import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.data import CellData
from cellgrid.functions.positions import dense_positions
from cellgrid.sources.paths import _fs_path, delete, exists

log = logging.getLogger("cellgrid")

GENE_EXPRESSION = "Gene Expression"
# sorts before Spark's part-00000-... names in byte order ('-' < '0')
HEADER_PART = "part-0000-header.txt.gz"


def _guard(spark, path: str, overwrite: bool) -> None:
    """K6: refuse an existing target unless asked to overwrite."""
    if exists(spark, path):
        if not overwrite:
            raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
        delete(spark, path)


def _write_lines(header: DataFrame, body: DataFrame, order: list[str], path: str, compress: bool,
                 single_file: bool) -> None:
    """Write ``header`` lines, then ``body`` lines in ``order`` (both frames have
    a ``value`` string column; ``body`` also carries the order columns)."""
    codec = "gzip" if compress else "none"
    spark = body.sparkSession
    if not single_file:
        # a union keeps partition order: the header is part-00000, then the
        # range-partitioned, sorted body
        sorted_body = body.orderBy(*order) if order else body
        header.select("value").union(sorted_body.select("value")) \
            .write.mode("errorifexists").option("compression", codec).text(path)
        return
    keyed = (header.select("value", F.lit(0).alias("_k"), *[F.lit(None).alias(c) for c in order])
             .unionByName(body.select("value", F.lit(1).alias("_k"), *order)))
    tmp = path + ".parts"
    delete(spark, tmp)
    (keyed.repartition(1).sortWithinPartitions("_k", *order).select("value")
     .write.option("compression", codec).text(tmp))
    fs, p = _fs_path(spark, tmp)
    part = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")][0]
    _, target = _fs_path(spark, path)
    fs.rename(part, target)
    fs.delete(p, True)


def _lines(spark, lines: list[str]) -> DataFrame:
    """A few header lines in one partition (so they land in one part file)."""
    return spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def _quoted(c: Column) -> Column:
    """A field as CSV writers quote it: only where it holds a tab, a quote or a
    line break, with quotes doubled."""
    return F.when(c.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def _fmt(c: Column, dtype: T.DataType) -> Column:
    """Text form: booleans as True/False (as pandas writes them), null as '',
    strings quoted where they must be."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(_quoted(c), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def _numbered(df: DataFrame, idx: str) -> DataFrame:
    """Dense 0-based positions of the index column (H3)."""
    return dense_positions(df, [F.col(idx)], name="_pos")


def export_mex(cd: CellData, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """K2: ``barcodes.tsv.gz``, ``features.tsv.gz`` (id, name, type) and
    ``matrix.mtx.gz`` (genes x cells, 1-based) in ``path``."""
    spark = cd.spark
    _guard(spark, path, overwrite)
    cells = _numbered(cd.cells.select("cell_idx", "cell_id"), "cell_idx")
    gcols = cd.genes.columns
    if "gene_ids" not in gcols:
        log.warning("genes have no gene_ids column: their names are written as ids")
    gid = F.col("gene_ids") if "gene_ids" in gcols else F.col("gene_id")
    gtype = F.col("feature_types") if "feature_types" in gcols else F.lit(GENE_EXPRESSION)
    # every field is there: a gene without an id goes by its name, without a type it is expression
    genes = _numbered(cd.genes.select("gene_idx", "gene_id", F.coalesce(gid.cast("string"), F.col("gene_id")).alias("_id"),
                                      F.coalesce(gtype.cast("string"), F.lit(GENE_EXPRESSION)).alias("_type")), "gene_idx")
    n_cells = cells.count()   # cells- and genes-sized tables
    n_genes = genes.count()
    entries = (cd.x.join(cells.select("cell_idx", F.col("_pos").alias("_c")), "cell_idx")
               .join(genes.select("gene_idx", F.col("_pos").alias("_g")), "gene_idx"))
    text = entries.select("_g", "_c", F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("_v"))
    number = F.when(F.col("_v").endswith(".0"), F.expr("left(_v, length(_v) - 2)")).otherwise(F.col("_v"))
    body = text.select(F.concat_ws(" ", (F.col("_g") + 1).cast("string"), (F.col("_c") + 1).cast("string"), number).alias("value"))
    target = f"{path}/matrix.mtx.gz"
    if single_file:
        nnz = entries.count()
        header = _lines(spark, ["%%MatrixMarket matrix coordinate real general", f"{n_genes} {n_cells} {nnz}"])
        _write_lines(header, body, [], target, True, single_file)  # any entry order is valid
    else:
        # entries are counted while they are written (no second pass); the
        # header part is added afterwards under a name that sorts first
        obs = Observation("mex")
        body.observe(obs, F.count(F.lit(1)).alias("nnz")).write.option("compression", "gzip").text(target)
        nnz = obs.get["nnz"]
        header = _lines(spark, ["%%MatrixMarket matrix coordinate real general", f"{n_genes} {n_cells} {nnz}"])
        tmp = target + ".header"
        header.write.option("compression", "gzip").text(tmp)
        fs, p = _fs_path(spark, tmp)
        part = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith("part-")][0]
        _, dest = _fs_path(spark, f"{target}/{HEADER_PART}")
        fs.rename(part, dest)
        fs.delete(p, True)
    _write_lines(_lines(spark, []), cells.select(F.col("cell_id").alias("value"), "_pos"), ["_pos"],
                 f"{path}/barcodes.tsv.gz", True, single_file)
    _write_lines(_lines(spark, []), genes.select(F.concat_ws("\t", "_id", "gene_id", "_type").alias("value"), "_pos"),
                 ["_pos"], f"{path}/features.tsv.gz", True, single_file)


def metadata_frame(cd: CellData, axis: str) -> DataFrame:
    """K3/K4 frame: key column ``barcode``/``gene`` then every annotation."""
    df, idx, key, label = ((cd.cells, "cell_idx", "cell_id", "barcode") if axis == "cell"
                           else (cd.genes, "gene_idx", "gene_id", "gene"))
    cols = [c for c in df.columns if c not in (idx, key)]
    return df.select(idx, F.col(key).alias(label), *[F.col(f"`{c}`") for c in cols])


def export_table(cd: CellData, axis: str, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """K3/K4: tab-separated with header, gzip if the name ends with ``.gz``."""
    spark = cd.spark
    _guard(spark, path, overwrite)
    frame = metadata_frame(cd, axis)
    idx = frame.columns[0]
    fields = [f for f in frame.schema.fields if f.name != idx]
    head = io.StringIO()
    csv.writer(head, delimiter="\t", lineterminator="").writerow([f.name for f in fields])
    header = _lines(spark, [head.getvalue()])
    body = frame.select(F.concat_ws("\t", *[_fmt(F.col(f"`{f.name}`"), f.dataType) for f in fields]).alias("value"),
                        idx)
    _write_lines(header, body, [idx], path, path.endswith(".gz"), single_file)


def _dense_rows(cd: CellData) -> DataFrame:
    """``(cell_idx, barcode, v)``: every cell with its values of all genes in gene
    order, zeros filled.  Entries are numbered by gene position, summed (repeated
    coordinates), sorted within the cell and put in place: work in proportion to
    the genes of a row, with no lookup."""
    genes = dense_positions(cd.genes.select("gene_idx"), [F.col("gene_idx")], name="_pos")
    n = genes.count()
    entries = (cd.x.join(genes, "gene_idx").groupBy("cell_idx", "_pos").agg(F.sum("value").alias("value"))
               .groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct("_pos", "value"))).alias("e")))
    rows = cd.cells.select("cell_idx", F.col("cell_id").alias("barcode")).join(entries, "cell_idx", "left")
    e = F.coalesce(F.col("e"), F.array().cast("array<struct<_pos:bigint,value:double>>"))
    # zeros before each entry, the entry, and the zeros after the last one
    filled = F.transform(e, lambda s, i: F.concat(
        F.array_repeat(F.lit(0.0), (s["_pos"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(e, i - 1)["_pos"]) - 1).cast("int")),
        F.array(s["value"])))
    last = F.when(F.size(e) == 0, F.lit(-1)).otherwise(F.get(e, F.size(e) - 1)["_pos"])
    tail = F.array_repeat(F.lit(0.0), (F.lit(n) - 1 - last).cast("int"))
    return rows.select("cell_idx", "barcode", F.concat(F.flatten(filled), tail).alias("v"))


def to_wide(cd: CellData) -> DataFrame:
    """K5 frame: one row per cell (cells without counts included), one column
    per gene named by ``gene_id``, zeros filled.  The gene list is the column
    list of the result, so it is read on the driver."""
    names = [g["gene_id"] for g in cd.genes.select("gene_idx", "gene_id").orderBy("gene_idx").collect()]
    return _dense_rows(cd).select("cell_idx", "barcode", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])


def export_textmatrix(cd: CellData, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """K5: dense cells x genes TSV, header = gene names, key column ``barcode``."""
    spark = cd.spark
    _guard(spark, path, overwrite)
    names = cd.genes.agg(F.array_sort(F.collect_list(F.struct("gene_idx", "gene_id"))).alias("g"))  # the header line
    header = names.select(F.concat_ws("\t", F.lit("barcode"), F.transform("g", lambda s: _quoted(s["gene_id"])))
                          .alias("value")).coalesce(1)
    rows = _dense_rows(cd).select("cell_idx", F.concat_ws("\t", _quoted(F.col("barcode")), F.transform(
        "v", lambda x: F.regexp_replace(x.cast("string"), r"\.0$", ""))).alias("value"))
    _write_lines(header, rows, ["cell_idx"], path, path.endswith(".gz"), single_file)
