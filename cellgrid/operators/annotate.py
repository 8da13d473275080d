"""Annotation edits: add by id, replace by position, drop, promote."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.data import CellData, nan_to_null
from cellgrid.functions.positions import dense_positions

log = logging.getLogger("cellgrid")


def _as_list(v) -> list:
    if v is None:
        return []
    if isinstance(v, str):
        return [s for s in v.split(",")]
    return list(v)


def _keys(axis: str) -> tuple[str, str]:
    if axis not in ("cell", "gene"):
        raise ValueError("axis must be 'cell' or 'gene'")
    return f"{axis}_idx", f"{axis}_id"


def annotation_frame(annots: DataFrame, names, columns, id_column=0, id_suffix: str = "",
                     key: str = "cell_id") -> DataFrame:
    """``(key, *names)`` from file columns by 0-based position (any id position)."""
    names, columns = _as_list(names), [int(c) for c in _as_list(columns)]
    file_cols = annots.columns
    id_name = file_cols[id_column] if isinstance(id_column, int) else id_column
    if not columns:
        columns = [i for i, c in enumerate(file_cols) if c != id_name]
    if len(names) != len(columns):
        raise ValueError("names and annotation columns differ in number")
    for c in columns:
        if c < 0 or c >= len(file_cols):
            raise ValueError(f"annotation column {c} is outside the file ({len(file_cols)} columns)")
    ident = F.concat(F.col(f"`{id_name}`").cast("string"), F.lit(id_suffix)).alias(key)
    return annots.select(ident, *[F.col(f"`{file_cols[c]}`").alias(n) for c, n in zip(columns, names)])


def annotate(cd: CellData, axis: str, annots: DataFrame, names, columns=None, id_column=0,
             id_suffix: str = "", check_unique: bool = True, source: str = "") -> CellData:
    """Left-join annotation columns by id; absent ids -> null; extra ids
    ignored; an existing column of the same name is replaced."""
    idx, key = _keys(axis)
    frame = nan_to_null(annotation_frame(annots, names, columns, id_column, id_suffix, key))
    names = [c for c in frame.columns if c != key]
    if check_unique:
        dup = frame.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
        if dup:
            raise ValueError(f"{axis} id {dup[0][key]!r} appears more than once in the annotations")
    table = cd.cells if axis == "cell" else cd.genes
    kept = [c for c in table.columns if c not in names]
    out = table.select(*kept).join(frame, key, "left")
    out = out.select(*kept, *names)
    desc = f"New {axis} columns: {', '.join(map(str, names))}" + (f" (read from {source})" if source else "")
    cd = cd.replace(cells=out) if axis == "cell" else cd.replace(genes=out)
    return cd.add_history({"subcommand": f"{axis}s", "annotation": names, "file": source}, desc)


def replace(cd: CellData, axis: str, annots: DataFrame, id_column=0, id_suffix: str = "",
            annots_order: str | None = None, check_counts: bool = True) -> CellData:
    """Drop every annotation and the ids; the file's rows are assigned by
    position (row i of the file -> i-th cell in index order), no reordering.

    Both sides are numbered with distributed dense positions and inner-joined
    on the position; ``cell_idx`` is kept so the matrix stays valid.
    ``annots_order`` names a column giving file order (e.g. a line number);
    without it the column order of a ``numbered`` read is required.
    """
    idx, key = _keys(axis)
    table = cd.cells if axis == "cell" else cd.genes
    cols = annots.columns
    id_name = cols[id_column] if isinstance(id_column, int) else id_column
    order = annots_order or "line_no"
    if order not in cols:
        raise ValueError(f"replacement table needs an order column '{order}' (file line number)")
    new = annots.select(F.concat(F.col(f"`{id_name}`").cast("string"), F.lit(id_suffix)).alias(key),
                        *[F.col(f"`{c}`") for c in cols if c not in (id_name, order)],
                        F.col(order).alias("_ord"))
    left = dense_positions(table.select(idx), [F.col(idx)], name="_pos")
    right = dense_positions(new, [F.col("_ord")], name="_pos").drop("_ord")
    if check_counts:
        n_left, n_right = table.count(), annots.count()
        if n_left != n_right:
            raise ValueError(f"replacement has {n_right} rows but the data has {n_left} {axis}s")
    out = left.join(right, "_pos").drop("_pos")
    cd = cd.replace(cells=out) if axis == "cell" else cd.replace(genes=out)
    return cd.add_history({"subcommand": f"{axis}s", "replace": True},
                          f"{axis.capitalize()} ids and annotations now come from another table, row by row")


def drop(cd: CellData, axis: str, name: str) -> CellData:
    """Remove one annotation; absent -> warning, unchanged, no history."""
    table = cd.cells if axis == "cell" else cd.genes
    idx, key = _keys(axis)
    if name not in table.columns or name in (idx, key):
        log.warning("nothing to drop: no %s annotation is called %s", axis, name)
        return cd
    table = table.drop(name)
    cd = cd.replace(cells=table) if axis == "cell" else cd.replace(genes=table)
    return cd.add_history({"subcommand": f"{axis}s", "drop": name}, f"Dropped '{name}' from the {axis} table")


def promote(cd: CellData, name: str) -> CellData:
    """A numeric (or boolean) cell annotation becomes a new gene column of
    the matrix (null -> 0, zeros not stored) and leaves ``cells``; the new gene
    gets null for every gene annotation.  Missing annotation -> unchanged."""
    if name not in cd.cells.columns or name in ("cell_idx", "cell_id"):
        log.error("nothing to promote: cells have no annotation called %s", name)
        return cd
    dtype = cd.cells.schema[name].dataType
    v = F.col(f"`{name}`")
    if isinstance(dtype, T.BooleanType):
        v = v.cast("double")
    elif isinstance(dtype, (T.StringType, T.DateType, T.TimestampType)):
        raise ValueError(f"annotation '{name}' is not numeric and cannot become a gene")
    new_idx = cd.genes.agg(F.coalesce(F.max("gene_idx") + 1, F.lit(0))).scalar()
    column = (cd.cells.select("cell_idx", F.coalesce(v.cast("double"), F.lit(0.0)).alias("value"))
              .where(F.col("value") != 0)
              .select("cell_idx", new_idx.alias("gene_idx"), "value"))
    new_gene = cd.genes.sparkSession.range(1).select(new_idx.alias("gene_idx"), F.lit(name).alias("gene_id"))
    genes = cd.genes.unionByName(new_gene, allowMissingColumns=True)
    x_raw = cd.x.unionByName(column)
    layers = {k: cd.layer(k) for k in cd.layers}
    out = cd.replace(cells=cd.cells.drop(name), genes=genes, x_raw=x_raw, layers=layers,
                     cells_filtered=False, genes_filtered=False)
    return out.add_history({"annotation": name}, f"'{name}' moved from the cell table into the matrix")
