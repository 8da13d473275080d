"""Unique names.

Repeated names get ``-1``, ``-2``, ... in ``order``; the first keeps its name.
A generated ``name-k`` that is already an original name is skipped, so the
i-th repeat of ``b`` gets the i-th integer ``k >= 1`` with ``b-k`` unused.

Generated names of different bases never collide (``b-k`` with an integer k
determines ``b``), so only collisions with *original* names matter.  With
``t_1 < t_2 < ...`` the taken numbers of base ``b``, the i-th free integer is
``i + #{j : t_j - j < i}``: one running count in a global order.  There is no
per-name window: a single name may hold a third of all rows.  Only names that
repeat are numbered; a table without repeats is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.positions import dense_positions, materialize, running_sums


def make_unique(df: DataFrame, name: str, order: str, join: str = "-") -> DataFrame:
    """Replace column ``name`` by a unique version, numbering repeats by ``order``."""
    base = df.select(F.col(order).alias("_o"), F.col(name).alias("_b"))
    repeated = materialize(base.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
                           .where((F.col("_n") > 1) & F.col("_b").isNotNull()).select("_b"))
    if repeated.isEmpty():
        return df
    # occurrence number i (0 = first) of each repeated row inside its name, skew-proof
    pos = dense_positions(base.join(repeated, "_b", "left_semi"), [F.col("_b"), F.col("_o")], name="_p")
    first = pos.groupBy("_b").agg(F.min("_p").alias("_p0"))
    occ = pos.join(first, "_b").select("_o", "_b", (F.col("_p") - F.col("_p0")).alias("_i"))

    # original names of the form  <repeated base>-<int>  block that number
    parsed = (df.select(F.col(name).alias("_n")).distinct()
              .select(F.regexp_extract("_n", r"^(.*)" + join + r"(\d+)$", 1).alias("_b"),
                      F.regexp_extract("_n", join + r"(\d+)$", 1).alias("_k"))
              .where(F.col("_k") != "")
              .select("_b", F.expr("try_cast(_k as bigint)").alias("_t"))
              .where(F.col("_t") >= 1))
    tpos = dense_positions(parsed.join(repeated, "_b", "left_semi"), [F.col("_b"), F.col("_t")], name="_q")
    tfirst = tpos.groupBy("_b").agg(F.min("_q").alias("_q0"))
    # j = rank of t inside its base; key u = t - j
    u = tpos.join(tfirst, "_b").select("_b", (F.col("_t") - (F.col("_q") - F.col("_q0") + 1)).alias("_key"),
                                       F.lit(1).alias("_taken"), F.lit(None).cast("bigint").alias("_o"))
    dups = occ.where(F.col("_i") > 0).select("_b", F.col("_i").alias("_key"), F.lit(0).alias("_taken"), "_o")
    # duplicates sort before taken rows at equal key, so only t_j - j < i is counted
    order_cols = [F.col("_b"), F.col("_key"), F.col("_taken"), F.col("_o")]
    run = running_sums(dups.unionByName(u), order_cols, {"_c": F.col("_taken")})
    start = run.groupBy("_b").agg(F.min(F.col("_c") - F.col("_taken")).alias("_c0"))
    k = (run.where(F.col("_taken") == 0).join(start, "_b")
         .select("_o", F.concat(F.col("_b"), F.lit(join), (F.col("_key") + F.col("_c") - F.col("_c0")).cast("string")).alias("_u")))
    out = df.join(k, df[order] == k["_o"], "left")
    return out.withColumn(name, F.coalesce("_u", F.col(name))).drop("_o", "_u")
