"""Annotation tables (S5), value lists (S6) and numbered text lines."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.data import nan_to_null
from cellgrid.functions.positions import dense_positions, materialize
from cellgrid.sources.mtx_lines import drop_line as _drop_line
from cellgrid.sources.paths import data_files, head_line, require_exists


_PAD = r"[\x00-\x20\x7f-\x9f]*"
#: What every text that casts to a type looks like (and some that do not).  The cast gives up on
#: any other text by an exception, which costs ten times the match.
_LOOKS = {"bigint": rf"^{_PAD}[+-]?[0-9]+{_PAD}$",
          "double": rf"^{_PAD}[+-]?(?:[0-9.][0-9a-fA-FxXpP.+-]*|(?i:inf|infinity|nan)){_PAD}$",
          "boolean": rf"^{_PAD}(?i:t|true|y|yes|1|f|false|n|no|0){_PAD}$"}


def _fits(v: Column, kind: str) -> Column:
    """Whether a text casts to ``kind``."""
    return F.when(v.rlike(_LOOKS[kind]), v.try_cast(kind)).isNotNull()


def read_annotations(spark: SparkSession, path: str, header: bool = True,
                     schema=None, line_numbers: bool = False, multi_line: bool = False) -> DataFrame:
    """Tab-separated table, columns kept in file order (``_c0``, ``_c1``...
    without a header); NaN -> null.

    A folder of ordered part files (what the exporters write) reads like the
    single concatenated file: the header is the first line of the first part
    only; it is read on the driver and dropped by position, with no extra
    pass over the data.  Column types are
    inferred in one aggregation (bigint, then double, then boolean, else
    string); ``schema`` (a list of Spark SQL type names) skips that pass.
    ``line_numbers=True`` adds ``line_no`` (0-based data line in file order,
    distributed positions), which positional replacement needs.
    ``multi_line=True`` reads quoted fields that hold line breaks (a file is then
    one split).
    """
    require_exists(spark, path)
    files = data_files(spark, path)

    def reader():
        # quoted fields as the exporter writes them: quotes doubled, any character inside
        return (spark.read.option("sep", "\t").option("header", False).option("inferSchema", False)
                .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
                .option("mode", "PERMISSIVE"))

    if header:
        first, _, any_line = head_line(spark, files[0], lambda ln: True)
        if not any_line:
            raise ValueError(f"{path} is empty")
        first_part = _drop_line(reader().csv(files[0]), 0)
        raw = first_part if len(files) == 1 else first_part.unionByName(
            reader().csv(files[1:]), allowMissingColumns=True)
        cols = raw.columns
        hdr = next(csv.reader([first], delimiter="\t"))  # the same quoting rules as the rows
        names = [hdr[i] if i < len(hdr) and hdr[i] != "" else f"_c{i}" for i in range(len(cols))]
    else:
        raw = reader().csv(files)
        cols = raw.columns
        names = list(cols)
    extra = []
    if line_numbers:
        raw = raw.select(*cols, F.col("_metadata.file_path").alias("_f"),
                         F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_r"))
        raw = dense_positions(raw, [F.col("_f"), F.col("_b"), F.col("_r")], name="line_no")
        extra = ["line_no"]
    data = raw.select(*[F.col(c).alias(n) for c, n in zip(cols, names)], *extra)
    if schema is not None:
        types = list(schema)
    else:
        checks = []
        for n in names:
            v = F.col(f"`{n}`")
            for t in ("bigint", "double", "boolean"):
                checks.append(F.count_if(v.isNotNull() & ~_fits(v, t)).alias(f"{n}\x00{t}"))
        bad = data.agg(*checks).first().asDict()
        types = []
        for n in names:
            types.append(next((t for t in ("bigint", "double", "boolean") if bad[f"{n}\x00{t}"] == 0), "string"))
    return nan_to_null(data.select(*[F.col(f"`{n}`").try_cast(t).alias(n) if t != "string" else F.col(f"`{n}`")
                                     for n, t in zip(names, types)], *extra))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, blank lines skipped, distinct -> ``(value string)``."""
    require_exists(spark, path)
    return (spark.read.text(path).select(F.trim("value").alias("value"))
            .where(F.length("value") > 0).distinct())


def numbered_lines(spark: SparkSession, path: str, name: str = "line_no") -> DataFrame:
    """Lines of a text file (or folder of part files) with a 0-based number in
    file order: ``(line_no bigint, value string)``.

    Order = (file, block offset, row inside the block).  A block is read by one
    task in file order, so its lines only need the number of lines in the
    blocks before it: one row a block, nothing is sorted but these.
    """
    require_exists(spark, path)
    raw = materialize(spark.read.text(path)
                      .select("value", F.col("_metadata.file_path").alias("_f"),
                              F.col("_metadata.file_block_start").alias("_b"),
                              F.monotonically_increasing_id().alias("_r")))
    blocks = raw.groupBy("_f", "_b").agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_r0")).alias("_off"))
    out = raw.join(F.broadcast(blocks), ["_f", "_b"])   # one row per block
    return out.select((F.col("_off") + F.col("_r")).alias(name), "value")
