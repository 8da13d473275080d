"""Join sides of a checked size, and joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table (or columns of one) as a join side: broadcast if its files hold at
    most ``most`` bytes, else left to an ordinary join, whose hot keys adaptive execution splits.

    Only for stored tables: a table's files have a true size, a plan only a guess."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


PIECES = 16  # pieces of an even share a task that rows are dealt in


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``(key, copies)`` of the keys that hold more than a piece of the stored ``df``'s rows.

    A piece is a ``PIECES``-th of a task's even share, so there are fewer than
    ``PIECES * parts`` hot keys, and their copies add up to at most twice that, in any data."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = max(1, df.count() // (PIECES * parts))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
    return counts.select(F.col(key).alias("_hot"), F.ceil(F.col("n") / piece).alias("_copies"))


def dealt(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``df`` with ``_salt``: rows of a hot key are spread over its copies by a hash of the
    whole row (the same again when a task is repeated), all other rows get 0."""
    out = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")  # bounded, see hot_keys
    return out.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.coalesce("_copies", F.lit(1)))).drop("_hot", "_copies")


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join by ``key``: rows of ``left`` with a hot key go to several tasks, to each of
    which the rows of ``right`` with that key are copied.  Other keys are joined as usual."""
    copies = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1)))
    return dealt(left, key, hot).join(copies.drop("_hot", "_copies"), [key, "_salt"]).drop("_salt")
