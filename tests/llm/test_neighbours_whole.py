"""Every query gets k neighbours if the table has them, however small its leaves are."""

import numpy as np
import pandas as pd

from cellgrid.llm import ann


def test_outliers_beside_a_hot_group_get_all_neighbours(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8)
    rows = [(i, hot.tolist()) for i in range(300)] + [(1000 + i, (3 * rng.normal(size=8)).tolist()) for i in range(200)]
    rows += [(1007, rows[307][1])] * 3                                     # an id of several rows
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    asked = set(range(0, 300, 3)) | {1007, 1050, 1120}
    got = ann.search(df, lambda i: i.isin(sorted(asked)), k=20, leaf=4).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(asked, 20)
    assert (got["vec_id"] != got["query_id"]).all()


def test_a_batch_of_queries_is_walked_a_few_at_a_time():
    """What a worker holds of the visits does not grow with the queries of a batch."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 4))
    tree = ann.Tree(x, len(x), leaf=50)
    held = {n: 50 for n in range(tree.leaves - 1)}
    batch = pd.DataFrame({"id": np.arange(6000), "vec": list(x), "own": np.ones(6000, int)})
    frames = list(ann.walked(iter([batch, batch[:0]]), tree, tree.leaves, held, 20, lambda v: v))
    assert max(map(len, frames)) <= ann.WALKED and sum(map(len, frames)) == 6000
    assert all(sorted(leaves) == sorted(held) for leaves in frames[0]["leaves"])


def test_queries_of_a_leaf_meet_it_in_blocks(spark):
    """Blocks of two queries find what one block of all of them finds."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400, 460)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    found = [sorted(map(tuple, ann.search(df, lambda i: i % 9 == 0, k=7, leaf=60, part=40, asked_at_once=n).collect())) for n in (2, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) == 7 * len(range(0, 460, 9))
