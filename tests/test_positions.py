"""Distributed positions and running sums equal their single-partition versions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrid.functions.names import make_unique
from cellgrid.functions.positions import dense_positions, running_sums


def test_dense_positions(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id"), ((F.col("id") * 7919) % 1000).alias("k"))
    got = dense_positions(df, [F.col("k"), F.col("id")], name="pos", n_parts=5)
    want = df.withColumn("pos", F.row_number().over(Window.orderBy("k", "id")) - 1)
    assert sorted(got.select("id", "pos").collect()) == sorted(want.select("id", "pos").collect())


def test_running_sums(spark):
    df = spark.range(0, 3000, 1, 6).select((F.col("id") % 97).alias("k"), F.lit(2).alias("v"))
    h = df.groupBy("k").agg(F.sum("v").alias("n"))
    got = running_sums(h, [F.col("k").desc()], {"cum": F.col("n")}, n_parts=4)
    want = h.withColumn("cum", F.sum("n").over(Window.orderBy(F.col("k").desc())))
    assert sorted(got.select("k", "cum").collect()) == sorted(want.select("k", "cum").collect())


def test_make_unique_with_collisions(spark):
    rows = [(0, "a"), (1, "a"), (2, "a-1"), (3, "b"), (4, "a"), (5, "b"), (6, "a-2"), (7, "a"), (8, "a-1")]
    df = spark.createDataFrame(rows, "idx bigint, name string")
    got = {r["idx"]: r["name"] for r in make_unique(df, "name", "idx").collect()}
    # python reference of the rule: i-th repeat gets the i-th free integer
    names = [n for _, n in rows]
    taken = set(names)
    seen, counter, expect = set(), {}, {}
    for i, n in rows:
        if n not in seen:
            seen.add(n)
            expect[i] = n
            continue
        while True:
            counter[n] = counter.get(n, 0) + 1
            cand = f"{n}-{counter[n]}"
            if cand not in taken:
                taken.add(cand)
                expect[i] = cand
                break
    assert got == expect


def test_positions_equal_one_window(spark):
    df = spark.range(0, 800, 1, 3).select(F.col("id"), ((F.col("id") * 31) % 50).alias("k"))
    a = df.withColumn("pos", (F.row_number().over(Window.orderBy("k", "id")) - 1).cast("bigint"))
    b = dense_positions(df, [F.col("k"), F.col("id")], name="pos")
    assert sorted(a.collect()) == sorted(b.collect())
    h = df.groupBy("k").agg(F.count("*").alias("n"))
    c = h.withColumn("cum", F.sum("n").over(Window.orderBy("k")))
    d = running_sums(h, [F.col("k")], {"cum": F.col("n")})
    assert sorted(c.collect()) == sorted(d.collect())


def test_running_min_distributed(spark):
    df = spark.range(0, 500, 1, 4).select(F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    a = df.withColumn("m", F.min("v").over(Window.orderBy(F.col("id").desc())))
    b = running_sums(df, [F.col("id").desc()], {"m": F.col("v")}, agg="min", n_parts=5)
    assert sorted(a.select("id", "m").collect()) == sorted(b.select("id", "m").collect())
