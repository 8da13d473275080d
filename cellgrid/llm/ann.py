"""Nearest neighbours by inner product with a hierarchical k-means tree.

Inner product becomes Euclidean distance by one more component: a vector ``x``
gets ``sqrt(M^2 - |x|^2)`` (``M`` the largest norm) and a query 0, after which the
nearest vector is the one of largest inner product.

* The tree is fitted on the driver on a bounded sample (``SAMPLE``): k-means
  with up to ``BRANCH`` children a node until a leaf is expected to hold
  ``LEAF`` rows.  Only its centroids are kept.
* Every row is indexed: it descends to a leaf.  Leaves beyond ``PART`` rows (a
  hot group of copies) are dealt over several parts.
* A query walks the tree best bin first: a priority queue of nodes by distance
  to the centroid, opened until enough leaves are visited.  How many is
  calibrated: for a sample of queries the exact neighbours are found by brute
  force, and the number of visits widens until ``target`` of them are in
  visited leaves.  A query goes on beyond that until its leaves hold enough rows for
  ``k`` neighbours, so small outlier leaves do not shorten its result.
* Visits meet their leaf part in a grouped task, which returns one row a query
  with its best ``k``; these are merged a query at a time.  The queries of a leaf are
  dealt in blocks of ``ASKED``, and its rows are copied to each block, so that a
  task holds one part and one block, however many queries visit a leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import stored, with_workers
from cellgrid.llm.vectors import sound

SAMPLE = 20_000       # rows that the tree is fitted on
CALIBRATION = 64      # queries that visits are calibrated with
BRANCH = 8
LEAF = 1024           # rows that a leaf is expected to hold
PART = 4096           # rows of a leaf part (expected)
MOST_LEAVES = 1000    # so that a leaf has sample rows enough
BLOCK = 256           # queries compared at a time
ASKED = 16_384        # queries that meet a leaf part in one task (expected)
WALKED = 1024         # queries whose leaves are held at a time


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of at most ``k`` clusters that hold something."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        c = np.stack([x[own == i].mean(axis=0) for i in np.unique(own)])
    return c


class Tree:
    """Centroids of a hierarchical k-means tree; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, branch: int = BRANCH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.centre: list[np.ndarray] = [sample.mean(axis=0)]
        leaf = max(leaf, -(-rows // MOST_LEAVES))
        scale, todo = rows / max(1, len(sample)), [(0, sample)]
        while todo:
            node, x = todo.pop()
            k = min(branch, int(np.ceil(len(x) * scale / leaf)))
            if k < 2 or len(x) < 2 * k:
                continue
            c = kmeans(x, k, rng)
            if len(c) < 2:
                continue
            own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            for i in range(len(c)):
                self.children[node].append(len(self.children))
                todo.append((len(self.children), x[own == i]))
                self.children.append([])
                self.centre.append(c[i])
        self.leaf_of = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}
        self.centres = np.stack(self.centre)

    @property
    def leaves(self) -> int:
        return len(self.leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: the nearest child, level by level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[kids]
            own = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kids[i], rows[own == i]) for i in np.unique(own)]
        return out

    def walk(self, q: np.ndarray, visits: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves of one query, best bin first, and more
        until they hold ``least`` rows (``held`` has the rows of each leaf)."""
        far = ((self.centres - q) ** 2).sum(axis=1)
        queue, out, rows = [(far[0], 0)], [], 0
        while queue and (len(out) < visits or rows < least):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_of[node])
                rows += (held or {}).get(out[-1], 0)
            for kid in self.children[node]:
                heapq.heappush(queue, (far[kid], kid))
        return out


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(ids, scores)`` of each query's ``k`` largest inner products but its own
    row's, ties to the smaller id.  A matrix product selects; scores are summed
    pair by pair in one order, so equal vectors score equally."""
    order = np.argsort(x_id, kind="stable")
    x, x_id, out = x[order], x_id[order], []
    for at in range(0, len(q), BLOCK):
        rough = q[at:at + BLOCK] @ x.T
        slack = 1e-9 * (1 + np.abs(rough).max(initial=0.0))
        for i, row in enumerate(rough):
            mine = q_id[at + i]
            row[x_id == mine] = -np.inf
            floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            c = np.flatnonzero((row >= floor - slack) & (row > -np.inf))
            exact = (x[c] * q[at + i]).sum(axis=1)
            top = np.argsort(-exact, kind="stable")[:k]
            out.append((x_id[c[top]], exact[top]))
    return out


def walked(batches: Iterator[pd.DataFrame], tree: Tree, visits: int, held: dict[int, int], k: int, flat) -> Iterator[pd.DataFrame]:
    """``(id, vec, leaves)``: the leaves that each query visits, ``WALKED`` queries at a time.

    A query's own rows are no candidates of it; leaves without rows are left out."""
    for b in batches:
        for at in range(0, len(b), WALKED):
            c = b.iloc[at:at + WALKED]
            leaves = [[n for n in tree.walk(q, visits, held, k + int(own)) if n in held] for q, own in zip(flat(_matrix(c["vec"])), c["own"])]
            yield pd.DataFrame({"id": c["id"].to_numpy(), "vec": c["vec"].to_numpy(), "leaves": leaves})


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.95,
           sample: int = SAMPLE, leaf: int = LEAF, part: int = PART, calibration: int = CALIBRATION, asked_at_once: int = ASKED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every row
    where ``is_query(id)`` holds, among all other rows.

    Vectors that are null, zero, hold null or non-finite components, or have
    another length than most, take no part.  Rows with a null id take no part
    either.  A row's own id is no candidate; an id that several rows have is
    asked once, with the smallest of their vectors, and each of the rows is a
    candidate of the others' ids; with fewer than ``k``
    candidates all are returned.  An empty table gives an empty result.
    """
    spark = with_workers(df.sparkSession)
    out_type = "query_id bigint, rank int, vec_id bigint, score double"
    rows = sound(df, id_col, vec_col).where("id is not null").withColumn("id", F.col("id").cast("bigint"))
    sq = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    total, longest = rows.agg(F.count(F.lit(1)), F.max(sq)).first()
    if not total:
        return spark.createDataFrame([], out_type)
    key = F.xxhash64("id", F.lit(31))
    seen = _matrix(rows.orderBy(key, "id").limit(sample).select("vec").toPandas()["vec"])

    def lift(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))])

    def flat(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))])

    tree = Tree(lift(seen), total, leaf)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.assign(lift(_matrix(b["vec"]))))

    index = stored(rows.select("id", "vec").mapInPandas(place, "id bigint, vec array<double>, leaf bigint"), "index")
    held = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a leaf
    held = {int(i): int(n) for i, n in held.items()}
    parts = {i: max(1, -(-n // part)) for i, n in held.items()}
    queries = index.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("own"))

    # calibration: exact neighbours of a few queries, and where the walk meets their leaves
    probe = queries.orderBy(F.xxhash64("id", F.lit(37)), "id").limit(calibration).toPandas()
    if not len(probe):
        return spark.createDataFrame([], out_type)
    probe_x, probe_id = _matrix(probe["vec"]), probe["id"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))] * len(probe_id)
        for b in batches:
            if not len(b):
                continue
            ids, leaves = b["id"].to_numpy(), b["leaf"].to_numpy()
            at = dict(zip(ids.tolist(), leaves.tolist()))
            for i, (found, score) in enumerate(best(probe_x, probe_id, _matrix(b["vec"]), ids, k)):
                where = np.array([at[j] for j in found.tolist()], dtype=np.int64)
                all_id, all_s, all_l = (np.concatenate(p) for p in zip(keep[i], (found, score, where)))
                o = np.lexsort((all_id, -all_s))[:k]
                keep[i] = (all_id[o], all_s[o], all_l[o])
        yield pd.DataFrame([(i, p[0].tolist(), p[1].tolist(), p[2].tolist()) for i, p in enumerate(keep)], columns=["q", "ids", "scores", "leaves"])

    near = index.mapInPandas(exact, "q int, ids array<bigint>, scores array<double>, leaves array<bigint>").toPandas()
    hits = np.zeros(tree.leaves)
    for i, group in near.groupby("q"):
        ids, scores, leaves = (np.concatenate([np.asarray(v, t) for v in group[c]]) for c, t in (("ids", np.int64), ("scores", float), ("leaves", np.int64)))
        o = np.lexsort((ids, -scores))[:k]
        order = {n: v for v, n in enumerate(tree.walk(flat(probe_x[i:i + 1])[0], tree.leaves))}
        for n in leaves[o]:
            hits[order[int(n)]] += 1
    share = np.cumsum(hits) / max(1, hits.sum())
    visits = int(np.argmax(share >= min(target, share[-1]))) + 1

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return walked(batches, tree, visits, held, k, flat)

    # a row a query: pairs of queries and leaf parts are only made by Spark, which does not hold them
    walks = stored(queries.mapInPandas(walk, "id bigint, vec array<double>, leaves array<bigint>"), "walks")
    visitors = walks.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a leaf
    blocks = {int(r["leaf"]): -(-int(r["n"]) // asked_at_once) for r in visitors}

    def of_leaf(values: dict[int, int]) -> Column:
        return F.get(F.expr("array(" + ", ".join(f"{values.get(i, 0)}L" for i in range(tree.leaves)) + ")"), F.col("leaf").cast("int"))

    def numbered(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    asked = (walks.select("id", "vec", F.explode("leaves").alias("leaf")).withColumn("part", numbered(of_leaf(parts)))
             .withColumn("block", F.pmod(F.xxhash64("id", F.lit(43)), of_leaf(blocks))))
    kept = (index.where(of_leaf(blocks) > 0).withColumn("part", F.pmod(F.xxhash64("id", F.lit(41)), of_leaf(parts)))
            .withColumn("block", numbered(of_leaf(blocks))))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        found = best(_matrix(q["vec"]), q["id"].to_numpy(), _matrix(x["vec"]), x["id"].to_numpy(), k)
        return pd.DataFrame({"q": q["id"].to_numpy(), "ids": [f[0] for f in found], "scores": [f[1] for f in found]})

    group = ["leaf", "part", "block"]
    got = asked.groupBy(*group).cogroup(kept.groupBy(*group)).applyInPandas(meet, "q bigint, ids array<bigint>, scores array<double>")

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        ids, scores = (np.concatenate([np.asarray(v, t) for v in g[c]]) for c, t in (("ids", np.int64), ("scores", float)))
        o = np.lexsort((ids, -scores))[:k]
        return pd.DataFrame({"query_id": g["q"].iloc[0], "rank": np.arange(1, len(o) + 1, dtype=np.int32), "vec_id": ids[o], "score": scores[o]})

    return got.groupBy("q").applyInPandas(finish, out_type)
