"""Dropping a header line by position inside a file's first split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW33 = (1 << 33) - 1


def drop_line(df: DataFrame, line_no: int) -> DataFrame:
    """Drop line ``line_no`` of the file's first split.

    Used on a frame reading one file: its first split (byte offset 0) is read
    by one task on its own, so the line is the row at that position inside
    the task -- found without scanning anything.
    """
    first_split = F.col("_metadata.file_block_start") == 0
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))
    return (df.withColumn("_drop", first_split & (row_in_task == line_no))
            .where(~F.col("_drop")).drop("_drop"))
