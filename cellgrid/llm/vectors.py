"""Vectors that take part in searches and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, stored


def marked(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """Stored ``(id, label, vec, ok)``, ``vec`` as doubles.  ``ok``: the vector is
    not null or zero, holds finite components only, and has the commonest length."""
    label = ref(df, label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(ref(df, id_col).alias("id"), label.alias("label"), ref(df, vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = stored(rows.withColumn("ok", F.coalesce(ok, F.lit(False))), "vectors")
    size = rows.where("ok").groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.withColumn("ok", F.col("ok") & (F.size("vec") == (size["n"] if size else 0)))


def sound(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the rows whose vector takes part."""
    return marked(df, id_col, vec_col).where("ok").select("id", "vec")
