"""Helpers shared by the operators: stored tables, worker code, components.

``stored`` writes a derived table as Parquet under the shared checkpoint
folder and reads it back: lineage is cut, columns can be pruned, and Spark
knows the true size when it chooses join sides.  A lost executor only costs
the tasks that were running.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.session import scratch_path, ship_package


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A stored table as a join side: broadcast if its files hold at most
    ``most`` bytes, else left to an ordinary (skew-splitting) join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def with_workers(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers."""
    ship_package(spark)
    return spark


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns came in."""
    have = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in have:
        n += 1
        name = f"_{stem}{n}"
    return name


def ref(df: DataFrame, name: str) -> Column:
    """Column by exact name (names with dots or blanks included)."""
    return df["`" + name.replace("`", "``") + "`"]


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list.

    Returns ``(node, root)`` for every node that has an edge to another node;
    ``root`` is the smallest node of its component.  Alternates the large-star
    and small-star steps: every step is a grouped minimum (combined before
    the shuffle, so a hub costs one row per task) and one join, and the edge
    list never grows beyond its first size.  Each round is a stored table.
    No edges: an empty result.
    """
    u, v = F.col(a), F.col(b)
    e = (edges.where(u.isNotNull() & v.isNotNull() & (u != v))
         .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
