"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

A source with ``n`` documents and target share ``w`` of ``total`` documents has
mean repetition rate ``w * total / n``.  Every document draws its number of
copies from the Poisson distribution of that rate by inverting it at a uniform
number hashed from seed, id and text; copies are exploded in place and all rows
are dealt out by a hash of (document, copy): a global shuffle in one exchange.

No state is kept per source beyond its rate: a source that holds a third of all
rows is counted with partial sums and its rows are spread like all others.  The
table of rates is stored, so Spark broadcasts it only if its measured size
allows that, and joins (splitting a hot source) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import fresh, ref, stored

STEP = 16.0   # a larger mean is drawn as a sum of draws with means up to this
TERMS = 96    # beyond this many the tail of a mean of STEP is under 1e-40


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                     alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """``(source, n, rate, draws, cdf)``, one row per source of ``docs``.

    Target weights come from ``weights`` (source, weight; missing, null or
    negative: 0), else every source weighs ``n ** alpha``.  ``total`` is the
    expected number of rows after mixing (by default as many as now).  ``cdf``
    is the distribution of one draw of mean ``rate / draws``.  A null source is
    a source of its own.
    """
    n = docs.groupBy(ref(docs, source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        w = weights.select(F.col("source").alias("s"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
        w = w.groupBy("s").agg(F.max("w").alias("w"))
        n = n.join(w, n["source"].eqNullSafe(w["s"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("weight"))
    n = stored(n, "sources")
    rows, weight = n.agg(F.sum("n"), F.sum("weight")).first()
    want = float(rows or 0) if total is None else float(total)
    rate = F.col("weight") / F.lit(weight or 1.0) * F.lit(want) / F.col("n")
    out = n.select("source", "n", rate.alias("rate"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("rate") / F.lit(STEP)), F.lit(1)).cast("int"))
    out = out.withColumn("mean", F.col("rate") / F.col("draws"))
    cdf = F.expr(f"""aggregate(sequence(1, {TERMS}),
        named_struct('p', exp(-mean), 'c', array(exp(-mean))),
        (a, k) -> named_struct('p', a.p * mean / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * mean / k))),
        a -> a.c)""")
    return out.select("source", "n", "rate", "draws", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id",
        text_col: str = "text", alpha: float = 0.5, total: int | None = None, seed: int = 7,
        copy_name: str = "copy", place_name: str = "place") -> DataFrame:
    """Rows of ``docs`` repeated to the target weights, in global random order.

    Adds ``copy`` (from 0) and ``place`` (the hash that rows are dealt out and
    ordered by); a document with no copies does not appear.  Null ids and texts
    are hashed as such.  Rows that agree in id and text draw the same number.
    A source of weight 0 disappears.  An empty table gives an empty result.
    Columns of ``docs`` that have one of the added names, in any case, are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in (copy_name.lower(), place_name.lower())]
    src, draws, cdf, key, times = (fresh(docs, stem) for stem in ("rate_of", "draws", "cdf", "key", "times"))
    rates = stored(repetition_rates(docs, weights, source_col, alpha, total), "rates").select(
        F.col("source").alias(src), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    text = F.md5(F.coalesce(ref(docs, text_col).cast("string"), F.lit("")))
    mine = docs.select(*[ref(docs, c) for c in names], ref(docs, source_col).alias(fresh(docs, "source")),
                       F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(ref(docs, id_col).cast("string"), F.lit("null")), text)).alias(key))
    mine = mine.join(rates, mine[fresh(docs, "source")].eqNullSafe(rates[src]))
    one = lambda i: F.size(F.filter(cdf, lambda p: p <= uniform(F.concat_ws(":", F.col(key), i))))
    drawn = F.aggregate(F.sequence(F.lit(0), F.col(draws) - 1), F.lit(0), lambda a, i: a + one(i))
    mine = mine.withColumn(times, drawn).where(F.col(times) > 0)
    mine = mine.select(*[ref(mine, c) for c in names], key,
                       F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias(copy_name))
    mine = mine.withColumn(place_name, F.md5(F.concat_ws(":", F.col(key), F.lit("place"), F.col(copy_name))))
    mine = mine.repartition(F.col(place_name)).sortWithinPartitions(place_name)
    return mine.select(*[ref(mine, c) for c in names], copy_name, place_name)
