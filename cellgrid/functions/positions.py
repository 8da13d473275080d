"""Global order without a single-partition window.

``dense_positions`` numbers rows 0..n-1 in a total order; ``running_sums``
adds inclusive running sums.  Rows are range-partitioned, tagged with
(partition, row inside partition) and written once to the shared folder.
Counts/sums per partition (one row per partition) become offsets through a
tiny window; the offsets are broadcast back (their size is the partition
count, not the data size) and each partition finishes on its own.  There is
one method for every size, so what is tested is what runs on a large table.

Why the frame is stored: the counting branch and the numbering branch prune
different columns, so their range exchanges are not reused and Spark would
sample range bounds twice; the two branches could then disagree on which
row sits in which partition.  Reading one stored frame removes that, and a
lost executor re-reads the files instead of re-sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.session import scratch_path

_LOW33 = (1 << 33) - 1


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived table that several later jobs read (cell totals, gene
    profiles, likelihoods) once, as Parquet in the shared folder, and read it
    back: the matrix behind it is scanned once, later reads are pruned and
    filtered in the scan, Spark knows the table's true size when it picks join
    sides, and lost executors re-read the files."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tagged(df: DataFrame, order: list, n: int) -> DataFrame:
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    return materialize(s)


def dense_positions(df: DataFrame, order: list, name: str = "pos", start: int = 0,
                    n_parts: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) position of each row in
    ``order``.  ``order`` should be a total order (append a unique key)."""
    s = _tagged(df, order, _n_parts(df, n_parts)).withColumn("_part", F.shiftright("_mid", 33))
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = s.join(F.broadcast(offsets), "_part")  # one row per partition
    out = out.withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)) + F.lit(start))
                         .cast("bigint"))
    return out.drop("_mid", "_part", "_off")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column],
                 n_parts: int | None = None, agg: str = "sum") -> DataFrame:
    """Add inclusive running aggregates ``{name: column}`` in ``order``;
    ``agg`` is ``sum`` or ``min``."""
    fn = {"sum": F.sum, "min": F.min}[agg]
    for k, c in sums.items():
        df = df.withColumn(f"_v_{k}", c)
    s = _tagged(df, order, _n_parts(df, n_parts)).withColumn("_part", F.shiftright("_mid", 33))
    parts = s.groupBy("_part").agg(*[fn(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[fn(f"_t_{k}").over(before).alias(f"_o_{k}") for k in sums])
    # inside a partition the stored _mid is the row order
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(offsets), "_part")  # one row per partition
    for k in sums:
        here = fn(f"_v_{k}").over(inside)
        off = F.col(f"_o_{k}")
        if agg == "sum":
            val = F.coalesce(off, F.lit(0)) + here
        else:
            val = F.when(off.isNull(), here).otherwise(F.least(off, here))
        out = out.withColumn(k, val)
    return out.drop("_mid", "_part", *[f"_v_{k}" for k in sums], *[f"_o_{k}" for k in sums])
