"""cellgrid: sparse count matrices and their annotation tables as Spark DataFrames.

The central object is :class:`cellgrid.data.CellData`.  Every operator is a
lazy DataFrame transformation; nothing is collected to the driver except
small, bounded summaries (histograms over distinct totals, parameters).
"""

from cellgrid.data import CellData

__all__ = ["CellData"]
