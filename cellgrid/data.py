"""CellData: a count matrix and the tables around it, all as DataFrames.

Slots
-----
cells   one row per cell (barcode): ``cell_idx bigint``, ``cell_id string``, annotations
genes   one row per gene: ``gene_idx bigint``, ``gene_id string``, annotations
x_raw   non-zero entries ``(cell_idx bigint, gene_idx bigint, value double)``
layers  extra matrices in the same long form, keyed by name
params  per-algorithm parameters ``{algorithm: {key: value}}`` (small, driver side)
history newest-first list of history records (small, driver side)

Operators return a new ``CellData``; nothing is mutated.  Cell and gene
selections touch only ``cells``/``genes``; the matrix is restricted lazily,
once, when ``x`` is read (two semi-joins; stored tables are broadcast where
their measured size allows it).
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import os
import platform
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "0.1.0"

# fixed values: the field names of the history format
HISTORY_FIELDS = ("hostname", "user", "python", "operating_system", "timestamp", "version",
                  "parameters", "description")
HISTORY_SCHEMA = T.StructType([T.StructField("seq", T.LongType(), False)]
                              + [T.StructField(f, T.StringType(), True) for f in HISTORY_FIELDS])


def _who() -> str:
    """Login name; containers without a user database have none."""
    for name in ("USER", "LOGNAME", "USERNAME"):
        if os.environ.get(name):
            return os.environ[name]
    return f"uid {os.getuid()}" if hasattr(os, "getuid") else "unknown"


def history_record(parameters: Any, description: str) -> dict:
    """One history record: environment, parameters, description (all text)."""
    machine = platform.uname()
    values = (machine.node, _who(), ".".join(map(str, sys.version_info[:3])),
              f"{machine.system} {machine.release} {machine.machine}",
              datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), VERSION,
              json.dumps(parameters, default=str, sort_keys=True), description)
    return dict(zip(HISTORY_FIELDS, values))


class Deferred:
    """A table that is made when it is first read (unique names need jobs of their own);
    all datasets derived from one share it."""

    def __init__(self, make: Callable[[], DataFrame]):
        self._make, self._made = make, None

    def get(self) -> DataFrame:
        if self._made is None:
            self._made = self._make()
        return self._made


@dataclasses.dataclass(frozen=True)
class CellData:
    cells: DataFrame
    genes: DataFrame | Deferred
    x_raw: DataFrame
    layers: dict = dataclasses.field(default_factory=dict)
    params: dict = dataclasses.field(default_factory=dict)
    history: tuple = ()
    changed: bool = False
    cells_filtered: bool = False
    genes_filtered: bool = False
    source_path: str | None = None  # native folder this dataset was loaded from

    # ------------------------------------------------------------------ basics
    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def __getattribute__(self, name: str) -> Any:
        value = object.__getattribute__(self, name)
        return value.get() if isinstance(value, Deferred) else value

    def replace(self, **kw) -> "CellData":
        """A copy with other slots; a deferred table stays so."""
        slots = {f.name: object.__getattribute__(self, f.name) for f in dataclasses.fields(self)}
        return CellData(**{**slots, **kw})

    def _restrict(self, m: DataFrame) -> DataFrame:
        if self.cells_filtered:
            m = m.join(self.cells.select("cell_idx"), "cell_idx", "left_semi")
        if self.genes_filtered:
            m = m.join(self.genes.select("gene_idx"), "gene_idx", "left_semi")
        return m.select("cell_idx", "gene_idx", "value")

    @property
    def x(self) -> DataFrame:
        """Non-zero entries of the (possibly restricted) matrix."""
        return self._restrict(self.x_raw)

    def layer(self, name: str) -> DataFrame:
        return self._restrict(self.layers[name])

    def annotation_names(self, axis: str) -> list[str]:
        df, key = (self.cells, "cell") if axis == "cell" else (self.genes, "gene")
        return [c for c in df.columns if c not in (f"{key}_idx", f"{key}_id")]

    def shape(self) -> tuple[int, int]:
        """(cells, genes): two counts on the small tables."""
        return self.cells.count(), self.genes.count()

    # ---------------------------------------------------------------- history
    def add_history(self, parameters: Any, description: str) -> "CellData":
        """Newest first; marks the dataset changed."""
        return self.replace(history=(history_record(parameters, description),) + tuple(self.history),
                            changed=True)

    def set_parameter(self, algorithm: str, key: str, value: Any) -> "CellData":
        """Nested algorithm -> key -> value."""
        params = {k: dict(v) for k, v in self.params.items()}
        params.setdefault(algorithm, {})[key] = value
        return self.replace(params=params)

    def get_parameter(self, algorithm: str, key: str, default: Any = None) -> Any:
        return self.params.get(algorithm, {}).get(key, default)

    def history_frame(self) -> DataFrame:
        """History as a DataFrame; ``seq`` 0 is the newest entry."""
        rows = [(i, *[h[f] for f in HISTORY_FIELDS]) for i, h in enumerate(self.history)]
        return self.spark.createDataFrame(rows, HISTORY_SCHEMA)

    def show_history(self, verbose: bool = False) -> list[str]:
        """Lines of the history, newest first."""
        if not self.history:
            return ["No history recorded"]
        out = []
        for h in self.history:
            out.append(f"[{h['timestamp']}] {h['description']}")
            if verbose:
                out.append(f"    user={h['user']} host={h['hostname']} system={h['operating_system']} "
                           f"python={h['python']} version={h['version']}")
                out.append(f"    parameters={h['parameters']}")
        return out

    # -------------------------------------------------------- operator facade
    def with_total_umis(self, refresh: bool = False) -> "CellData":
        from cellgrid.operators import totals
        return totals.with_total_umis(self, refresh=refresh)

    def select_cells(self, expr: str, **kw) -> "CellData":
        from cellgrid.operators import select
        return select.select_cells(self, expr, **kw)

    def select_genes(self, expr: str, **kw) -> "CellData":
        from cellgrid.operators import select
        return select.select_genes(self, expr, **kw)

    def filter_classic(self, **kw) -> "CellData":
        from cellgrid.operators import totals
        return totals.filter_classic(self, **kw)

    def filter_emptydrops(self, **kw) -> "CellData":
        from cellgrid.operators import emptydrops
        return emptydrops.filter_emptydrops(self, **kw)

    def filter_empty(self, method: str = "emptydrops", **kw) -> "CellData":
        """Plain ``filterempty`` means emptyDrops."""
        if method == "emptydrops":
            return self.filter_emptydrops(**kw)
        if method == "classic":
            return self.filter_classic(**kw)
        raise ValueError(f"unknown filter method {method!r} (emptydrops or classic)")

    def annotate_cells(self, annots: DataFrame, names, columns=None, **kw) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.annotate(self, "cell", annots, names, columns, **kw)

    def annotate_genes(self, annots: DataFrame, names, columns=None, **kw) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.annotate(self, "gene", annots, names, columns, **kw)

    def replace_cells(self, annots: DataFrame, **kw) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.replace(self, "cell", annots, **kw)

    def replace_genes(self, annots: DataFrame, **kw) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.replace(self, "gene", annots, **kw)

    def drop_cell_annotation(self, name: str) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.drop(self, "cell", name)

    def drop_gene_annotation(self, name: str) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.drop(self, "gene", name)

    def promote(self, name: str) -> "CellData":
        from cellgrid.operators import annotate
        return annotate.promote(self, name)

    def annotate_tags(self, reads: DataFrame, bc14: DataFrame, bc30: DataFrame, **kw) -> "CellData":
        from cellgrid.operators import tags
        return tags.annotate_tags(self, reads, bc14, bc30, **kw)

    def describe(self):
        from cellgrid.operators import describe
        return describe.describe(self)

    def save(self, path: str | None = None, compress: bool = True, write: bool = True,
             force: bool = False) -> CellData | None:
        """K1: write the dataset; the default target is the folder it was loaded
        from.  Returns the dataset at its new place (None: nothing to write)."""
        from cellgrid.sources import native
        return native.save(self, path, compress=compress, write=write, force=force, source=self.source_path)

    def export_mex(self, path: str, overwrite: bool = False, single_file: bool = False) -> None:
        from cellgrid.sinks import text
        text.export_mex(self, path, overwrite=overwrite, single_file=single_file)

    def export_cells(self, path: str, overwrite: bool = False, single_file: bool = False) -> None:
        from cellgrid.sinks import text
        text.export_table(self, "cell", path, overwrite=overwrite, single_file=single_file)

    def export_genes(self, path: str, overwrite: bool = False, single_file: bool = False) -> None:
        from cellgrid.sinks import text
        text.export_table(self, "gene", path, overwrite=overwrite, single_file=single_file)

    def export_textmatrix(self, path: str, overwrite: bool = False, single_file: bool = False) -> None:
        from cellgrid.sinks import text
        text.export_textmatrix(self, path, overwrite=overwrite, single_file=single_file)

    def to_wide(self, **kw) -> DataFrame:
        from cellgrid.sinks import text
        return text.to_wide(self, **kw)


def empty_like_cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cell_idx bigint, cell_id string")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Rule N1: double NaN becomes NULL so comparisons are two-valued."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
