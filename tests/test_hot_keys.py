"""Joins on hot keys: dealt evenly, with the rows of a plain join."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellgrid.functions.joins import PIECES, dealt, hot_keys, salted_join
from cellgrid.functions.positions import materialize
from cellgrid.operators.tags import tag_counts

PARTS = 8


@pytest.fixture(scope="module")
def skewed(spark):
    """40 000 rows; one key holds 90 % of them, 4000 keys one row each, some rows have none."""
    key = F.when(F.col("id") % 10 > 0, F.lit(-1)).when(F.col("id") % 1000 > 0, F.col("id"))
    return materialize(spark.range(40_000).select("id", key.alias("k")))


def test_rows_of_a_plain_join(spark, skewed):
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (10, "c"), (20, "d"), (None, "e"), (7, "f")], "k bigint, v string")
    got = salted_join(skewed, right, "k", hot_keys(skewed, "k", PARTS))
    want = skewed.join(right, "k")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, want.select("id", "k", "v").collect()))
    assert got.count() == 2 * 36_000 + 2


def test_no_task_has_twice_the_median(skewed):
    hot = hot_keys(skewed, "k", PARTS)
    assert [r["_hot"] for r in hot.collect()] == [-1]
    assert hot.agg(F.sum("_copies")).first()[0] <= 2 * PIECES * PARTS
    rows = dealt(skewed.where("k is not null"), "k", hot).repartition(PARTS, "k", "_salt")
    sizes = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == PARTS and sizes[-1] <= 2 * sizes[PARTS // 2]


def test_tag_counts_with_one_tag_in_most_combinations(spark):
    lib14 = [(0, "A", "ACGTACGTACGTAC"), (1, "B", "TTTTTTTTTTTTTT")]
    lib30 = [(i, f"t{i}", f"{i:030b}".replace("0", "A").replace("1", "C")) for i in (0, 63, 4032)]
    pairs = [(f"c{i % 50}", f"u{i}", lib14[0 if i % 10 else 1][2], lib30[i % 3][2]) for i in range(3000)]
    want = Counter((c, "A:" if a == lib14[0][2] else "B:", b) for c, _, a, b in pairs)
    name = {s: t for _, t, s in lib30}
    made = tag_counts(spark.createDataFrame(pairs, "cell string, umi string, bc14 string, bc30 string"),
                      spark.createDataFrame(lib14, "pos bigint, tag_id string, seq string"),
                      spark.createDataFrame(lib30, "pos bigint, tag_id string, seq string"))
    assert {(r.cell, r.tag): r.n_reads for r in made.collect()} == {(c, a + name[b]): n for (c, a, b), n in want.items()}


def test_empty_tables(spark, skewed):
    none = materialize(skewed.limit(0))
    right = spark.createDataFrame([(-1, "a")], "k bigint, v string")
    assert salted_join(none, right, "k", hot_keys(none, "k", PARTS)).count() == 0
    assert salted_join(skewed, right.limit(0), "k", hot_keys(skewed, "k", PARTS)).count() == 0
