"""select cells / select genes."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.predicate import apply_predicate

log = logging.getLogger("cellgrid")


def _select(cd: CellData, axis: str, expr: str, lists: dict | None, anchor: str,
            record: bool) -> CellData:
    table = cd.cells if axis == "cell" else cd.genes
    kept = apply_predicate(table, expr, axis, lists, anchor)
    if axis == "cell":
        out = cd.replace(cells=kept, cells_filtered=True)
    else:
        out = cd.replace(genes=kept, genes_filtered=True)
    if record:
        counts = removed_count(table, expr, axis, lists, anchor).first()
        description = (f"Selection '{expr}' on {axis}s: {counts['n_kept']} of {counts['n_before']} stay, "
                       f"{counts['n_removed']} go")
        log.info(description)
        out = out.add_history({"subcommand": f"{axis}s", "expression": expr}, description)
    return out


def select_cells(cd: CellData, expr: str, lists: dict | None = None, anchor: str = "full",
                 record: bool = True) -> CellData:
    """keep cells where ``expr`` holds; the matrix follows lazily."""
    return _select(cd, "cell", expr, lists, anchor, record)


def select_genes(cd: CellData, expr: str, lists: dict | None = None, anchor: str = "full",
                 record: bool = True) -> CellData:
    """keep genes where ``expr`` holds (``gene`` names the gene id)."""
    return _select(cd, "gene", expr, lists, anchor, record)


def removed_count(table, expr: str, axis: str = "cell", lists: dict | None = None, anchor: str = "full"):
    """one row ``(n_before, n_kept, n_removed)`` from one aggregation."""
    from cellgrid.functions.predicate import predicate_flag

    flagged = predicate_flag(table, expr, axis, lists, anchor, name="_keep")
    return flagged.agg(F.count(F.lit(1)).alias("n_before"),
                       F.count_if(F.col("_keep")).alias("n_kept"),
                       F.count_if(~F.col("_keep")).alias("n_removed"))
