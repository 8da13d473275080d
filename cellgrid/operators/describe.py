"""Dataset summaries.

Numeric columns: count, min, max, mean, sample sd in one aggregation, and
exact quartiles read off a per-column histogram of distinct values with a
distributed running count (no single task ever holds all values).
Non-numeric columns (strings, booleans, dates): non-null count, distinct
count and the five most frequent values (ties by value ascending); the
per-column top five uses a window with ``row_number() <= 5``, which Spark
limits per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.data import CellData
from cellgrid.functions.positions import materialize, running_sums

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_numeric(dt) -> bool:
    return isinstance(dt, _NUMERIC)


def exact_quantiles(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """``(annotation, q0, q1, ...)``: linear-interpolation quantiles (pandas style)
    of every column, from one histogram of (column, value) and one running count."""
    each = F.array(*[F.struct(F.lit(c).alias("annotation"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    h = (df.select(F.inline(each)).where(F.col("v").isNotNull())
         .groupBy("annotation", "v").agg(F.count(F.lit(1)).alias("n")))
    h = materialize(running_sums(h, [F.col("annotation"), F.col("v")], {"cum": F.col("n")}))
    per = h.groupBy("annotation").agg(F.min(F.col("cum") - F.col("n")).alias("base"), F.sum("n").alias("total"))
    marked = h.join(per, "annotation").withColumn("cum", F.col("cum") - F.col("base"))
    aggs, out = [], []
    for j, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("cum") > F.floor(pos), F.col("v"))).alias(f"lo{j}"),
                 F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v"))).alias(f"hi{j}"),
                 F.max(pos - F.floor(pos)).alias(f"f{j}")]
        out.append((F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * F.col(f"f{j}")).alias(f"q{j}"))
    return marked.groupBy("annotation").agg(*aggs).select("annotation", *out)


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(annotation, count, min, max, mean, sd, median, q1, q3)`` per numeric column."""
    cols = columns if columns is not None else [f.name for f in df.schema.fields if _is_numeric(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "annotation string, count bigint, min double, max double, mean double, sd double, "
                "median double, q1 double, q3 double")
    stats = []
    for c in cols:
        v = F.col(f"`{c}`").cast("double")
        stats.append(F.struct(F.lit(c).alias("annotation"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
                              F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")))
    one = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    q = exact_quantiles(df, cols)
    return one.join(q, "annotation", "left").select("annotation", "count", "min", "max", "mean", "sd", F.col("q1").alias("median"),
                                                    F.col("q0").alias("q1"), F.col("q2").alias("q3"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """``(annotation, non_null, distinct, rank, value, count)``; ``rank`` 1..5."""
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields
        if not _is_numeric(f.dataType) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "annotation string, non_null bigint, distinct bigint, rank bigint, value string, count bigint")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("annotation"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.annotation", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("annotation", "value").agg(F.count(F.lit(1)).alias("count"))
    per_col = counts.groupBy("annotation").agg(F.sum("count").alias("non_null"),
                                          F.count(F.lit(1)).alias("distinct"))
    w = Window.partitionBy("annotation").orderBy(F.col("count").desc(), F.col("value"))
    topk = counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
    return topk.join(per_col, "annotation").select("annotation", "non_null", "distinct", "rank", "value", "count")


def name_sample(df: DataFrame, idx: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` names in index order (top-k, no full sort)."""
    return df.orderBy(idx).limit(n).select(idx, key)


def array_summary(df: DataFrame) -> DataFrame:
    """P5: ``(name, element_type, n_rows, width)`` for each array column."""
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not arrays:
        return df.sparkSession.createDataFrame([], "name string, element_type string, n_rows bigint, width bigint")
    parts = [df.agg(F.lit(f.name).alias("name"), F.lit(f.dataType.elementType.simpleString()).alias("element_type"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.max(F.size(f"`{f.name}`")).cast("bigint").alias("width"))
             for f in arrays]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief(cd: CellData) -> DataFrame:
    """``(section, name, value)`` rows: counts, annotation names, arrays, layers."""
    spark = cd.spark
    rows = []
    for axis, df in (("cell", cd.cells), ("gene", cd.genes)):
        for f in df.schema.fields:
            if f.name in (f"{axis}_idx", f"{axis}_id"):
                continue
            kind = "multi-dimensional" if isinstance(f.dataType, T.ArrayType) else "annotation"
            rows.append((f"{axis} {kind}", f.name, f.dataType.simpleString()))
    for name in cd.layers:
        rows.append(("layer", name, "double"))
    meta = spark.createDataFrame(rows, "section string, name string, value string")
    counts = cd.cells.agg(F.lit("count").alias("section"), F.lit("cells").alias("name"),
                          F.count(F.lit(1)).cast("string").alias("value")).unionByName(
        cd.genes.agg(F.lit("count").alias("section"), F.lit("genes").alias("name"),
                     F.count(F.lit(1)).cast("string").alias("value")))
    return counts.unionByName(meta)


def matrix_line(cd: CellData) -> DataFrame:
    """Shape, value type, sparse flag and non-zeros of the main matrix."""
    n_cells = cd.cells.agg(F.count(F.lit(1))).scalar()
    n_genes = cd.genes.agg(F.count(F.lit(1))).scalar()
    return cd.x.agg(n_cells.alias("n_cells"), n_genes.alias("n_genes"),
                    F.lit(cd.x_raw.schema["value"].dataType.simpleString()).alias("dtype"),
                    F.lit(True).alias("sparse"), F.count(F.lit(1)).alias("nnz"))


def describe(cd: CellData) -> dict[str, DataFrame]:
    """All summaries of a dataset as DataFrames (history is shown separately)."""
    out = {"brief": brief(cd), "matrix": matrix_line(cd)}
    for axis, df in (("cell", cd.cells), ("gene", cd.genes)):
        ann = df.drop(f"{axis}_idx", f"{axis}_id")
        out[f"{axis}_names"] = name_sample(df, f"{axis}_idx", f"{axis}_id")
        out[f"{axis}_numeric"] = numeric_summary(ann)
        out[f"{axis}_categorical"] = categorical_summary(ann)
        out[f"{axis}_arrays"] = array_summary(ann)
    params = [(alg, k, repr(v)) for alg, kv in cd.params.items() for k, v in kv.items()]
    out["unstructured"] = cd.spark.createDataFrame(params, "algorithm string, key string, value string")
    return out
