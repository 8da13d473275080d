"""Embedding near-duplicates: exact pairs above a cosine by dual traversal of cover trees.

On unit vectors ``cos >= c`` means a distance of at most ``t = sqrt(2 - 2 c)``.

* Equal vectors of a label are one point with a count.
* A label of more than ``SHARD`` points is cut by centres drawn from a bounded
  sample (``CENTRES`` at most): a point lives with its nearest centre and visits
  a later centre ``j`` only if a neighbour may live there, that is if its distance
  to ``j`` is at most the radius of ``j``'s points plus ``t`` and it is within ``t`` of
  the plane between both centres.  Cells and their visitors that are still too
  large are cut into blocks of about ``SHARD`` points, and blocks meet in pairs.
* In a task each side is a cover tree: the points of a node lie within its
  radius, its children cover them at half that radius, the node's own point is
  a child again.  Node pairs whose centres are further apart than both radii
  plus ``t`` are pruned with all that is below them; what remains ends in small
  blocks that are compared exactly.
* A task returns a count of links and one link into its component per point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import components, sized, stored, with_workers
from cellgrid.llm.vectors import marked

SHARD = 4096      # points of a block (expected)
CENTRES = 512     # centres of a label at most
SAMPLE = 20_000   # points of large labels that centres are drawn from
LEAF = 24         # points of a leaf
ROWS = 512        # rows compared at a time
_SLACK = 1e-9     # of cosines that are compared again pair by pair
_WIDE = 1e-7      # of distances: rounding of a product of unit vectors is 1.5e-8 near zero


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, row by row."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Node:
    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, radius: float, members: np.ndarray):
        self.centre, self.radius, self.members, self.children = centre, radius, members, []


def cover_tree(u: np.ndarray, members: np.ndarray) -> Node:
    """Cover tree over ``u[members]``; members of a node include its centre."""
    first = int(members[0])
    far = _gap(u[members], u[first:first + 1])[:, 0]
    root = Node(first, float(far.max()), members)
    todo = [(root, far, root.radius)]
    while todo:
        node, far, scale = todo.pop()
        if len(node.members) <= LEAF or node.radius == 0:
            continue
        while scale / 2 >= node.radius:  # levels at which the node is its only child
            scale /= 2
        reach, rest = scale / 2, node.members
        centre = node.centre
        while len(rest):
            near = far <= reach
            if not near.any():  # the centre itself has been covered already
                centre = int(rest[0])
                far = _gap(u[rest], u[centre:centre + 1])[:, 0]
                near = far <= reach
            near[rest == centre] = True
            child = Node(centre, float(far[near].max()), rest[near])
            node.children.append(child)
            todo.append((child, far[near], reach))
            rest, far = rest[~near], far[~near]
            if len(rest):
                centre = int(rest[0])
                far = _gap(u[rest], u[centre:centre + 1])[:, 0]
    return root


class Links:
    """Links found in a task: counts and components."""

    def __init__(self, x: np.ndarray, many: np.ndarray, cosine: float):
        self.x, self.u, self.many, self.cosine = x, _unit(x), many, cosine
        self.t = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _WIDE
        self.count, self.label = np.zeros(len(x), np.int64), np.arange(len(x))

    def exact(self, i: int, j: np.ndarray) -> np.ndarray:
        a, b = self.x[i] / np.abs(self.x[i]).max(), self.x[j] / np.abs(self.x[j]).max(axis=1, keepdims=True)
        return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All of ``a`` against all of ``b``; ``same``: one set against itself."""
        for at in range(0, len(a), ROWS):
            rows = a[at:at + ROWS]
            rough = self.u[rows] @ self.u[b].T
            hit = rough >= self.cosine
            for r, c in zip(*np.nonzero(np.abs(rough - self.cosine) < _SLACK)):
                hit[r, c] = self.exact(int(rows[r]), b[c:c + 1])[0] >= self.cosine
            hit &= rows[:, None] != b[None, :]
            self.count[rows] += hit @ self.many[b]
            if not same:
                np.add.at(self.count, b, hit.T @ self.many[rows])
            hit &= self.label[rows][:, None] != self.label[b][None, :]
            for r in np.flatnonzero(hit.any(axis=1)):
                labels = np.unique(np.append(self.label[b[hit[r]]], self.label[rows[r]]))
                if len(labels) > 1:
                    self.label[np.isin(self.label, labels[1:])] = labels[0]

    def traverse(self, left: Node, right: Node) -> None:
        """Every close pair of two nodes (of one node, if they are the same)."""
        todo = [(left, right)]
        while todo:
            a, b = todo.pop()
            if not a.children and not b.children or len(a.members) * len(b.members) <= LEAF * LEAF:
                self.compare(a.members, b.members, a is b)
                continue
            if a is not b and (not a.children or (b.children and b.radius > a.radius)):
                ka, kb = [a], b.children
            elif a is not b:
                ka, kb = a.children, [b]
            else:
                ka = kb = a.children
            ca, cb = np.array([n.centre for n in ka]), np.array([n.centre for n in kb])
            ra, rb = np.array([n.radius for n in ka]), np.array([n.radius for n in kb])
            kept = []
            for at in range(0, len(ka), ROWS):
                near = _gap(self.u[ca[at:at + ROWS]], self.u[cb]) <= ra[at:at + ROWS, None] + rb[None, :] + self.t
                kept += [(i + at, j) for i, j in zip(*np.nonzero(near)) if a is not b or i + at <= j]
            weight = sum(len(ka[i].members) * len(kb[j].members) for i, j in kept)
            whole = len(a.members) * len(b.members) // (2 if a is b else 1)
            if weight > 0.7 * whole and whole <= (4 * ROWS) ** 2:  # nothing to prune here: one block
                self.compare(a.members, b.members, a is b)
            else:
                todo += [(ka[i], kb[j]) for i, j in kept]


def block_links(x: np.ndarray, many: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and component labels.  Side 0: all against all; sides 1 and 2:
    one against the other."""
    found = Links(x, many, cosine)
    if (side == 0).any():
        root = cover_tree(found.u, np.arange(len(x)))
        found.traverse(root, root)
    elif (side == 1).any() and (side == 2).any():
        found.traverse(cover_tree(found.u, np.flatnonzero(side == 1)), cover_tree(found.u, np.flatnonzero(side == 2)))
    return found.count, found.label


def _cells(points: DataFrame, large: dict, sample: int, shard: int) -> dict:
    """Centres (unit rows) of the large labels."""
    keys = [k for k in large]
    if not keys:
        return {}
    picked = (points.where(F.col("label").isin(keys)).orderBy(F.xxhash64("node", F.lit(5)), "node").limit(sample)
              .select("label", "vec").toPandas())
    out = {}
    for label, g in picked.groupby("label"):
        out[label] = _unit(_matrix(g["vec"]))[:max(1, min(CENTRES, -(-large[label] // shard)))]
    return {k: out.get(k) for k in keys if out.get(k) is not None and len(out[k]) > 1}


def near_pairs(points: DataFrame, cosine: float, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(node, links, root)`` for points ``(node, label, vec, many)``: counts of
    linked rows and links that span the components, both to be added up."""
    spark = with_workers(points.sparkSession)
    t = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _WIDE
    # labels beyond one block: at most points / shard of them
    large = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).collect()}
    centres = _cells(points, large, sample, shard)
    cells: dict = {}
    if large:
        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for label, g in b.groupby("label"):
                    if label not in centres:
                        yield pd.DataFrame({"label": g["label"], "cell": 0, "far": 0.0})
                        continue
                    gap = _gap(_unit(_matrix(g["vec"])), centres[label])
                    yield pd.DataFrame({"label": g["label"], "cell": gap.argmin(axis=1), "far": gap.min(axis=1)})

        kind = points.schema["label"].dataType.simpleString()
        homes = points.where(F.col("label").isin(list(large))).select("label", "vec").mapInPandas(home, f"label {kind}, cell int, far double")
        for r in homes.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():
            cells[(r["label"], r["cell"])] = (max(1, -(-r["n"] // shard)), r["radius"])

    def tasks(label, vec: np.ndarray, node: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        """``(task, side, rows)`` of the points of one label."""
        if label not in large:
            yield "all", 0, np.arange(len(node))
            return
        c = centres.get(label)
        gap = _gap(_unit(vec), c) if c is not None else np.zeros((len(node), 1))
        own, salt = gap.argmin(axis=1), node % 1_000_003
        for j in range(gap.shape[1]):
            if (label, j) not in cells:
                continue
            blocks, radius = cells[(label, j)]
            live = np.flatnonzero(own == j)
            for p in range(blocks):
                rows = live[salt[live] % blocks == p]
                for q in range(blocks):
                    lo, hi = min(p, q), max(p, q)
                    yield f"{j}:{lo}:{hi}", 0 if p == q else 1 if p < q else 2, rows
            early = np.flatnonzero(own < j)
            if c is None or not len(early):
                continue
            i = own[early]
            between = _gap(c[i], c[j:j + 1])[:, 0]
            to_plane = (gap[early, j] ** 2 - gap[early, i] ** 2) / (2 * np.maximum(between, 1e-12))
            early = early[(gap[early, j] <= radius + t) & (to_plane <= t + 1e-6)]
            # visitors meet every block of the cell, a slice of them at a time
            slices = int(visitors.get((label, j), 1))
            for s in range(slices):
                rows = early[salt[early] % slices == s]
                for p in range(blocks):
                    yield f"{j}:v{s}:{p}", 1, rows
            for s in range(slices):
                for p in range(blocks):
                    yield f"{j}:v{s}:{p}", 2, live[salt[live] % blocks == p]

    visitors: dict = {}
    if cells:
        # how many slices the visitors of a cell need: at most as many as there are earlier points
        before: dict = {}
        for (label, j), (blocks, _) in sorted(cells.items(), key=lambda kv: (str(kv[0][0]), kv[0][1])):
            visitors[(label, j)] = max(1, before.get(label, 0))
            before[label] = before.get(label, 0) + blocks

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, g in b.groupby("label"):
                node = g["node"].to_numpy()
                vec = _matrix(g["vec"]) if label in large else np.empty((0, 0))
                for task, side, rows in tasks(label, vec, node):
                    if len(rows):
                        yield g.iloc[rows].assign(task=task, side=side)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", ignore_index=True)
        node = g["node"].to_numpy()
        count, label = block_links(_matrix(g["vec"]), g["many"].to_numpy(), g["side"].to_numpy(), cosine)
        keep = (count > 0) | (label != np.arange(len(node)))
        return pd.DataFrame({"node": node[keep], "links": count[keep], "root": node[label[keep]]})

    kind = points.schema["label"].dataType.simpleString()
    dealt = points.select("node", "label", "vec", "many").mapInPandas(
        spread, f"node bigint, label {kind}, vec array<double>, many bigint, task string, side int")
    return dealt.groupBy("label", "task").applyInPandas(solve, "node bigint, links bigint, root bigint")


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Rows link if their labels are equal and not null and the cosine of their
    vectors is at least ``cosine``.  A vector that is null, zero, holds null or
    non-finite components or has another length than most links with nothing:
    0 links, its own component.  Repeated rows are vectors of their own and link
    with each other; rows with a null id take part, their component is named by
    its smallest non-null id.  An empty table gives an empty result.
    """
    rows = marked(df, id_col, vec_col, label_col).withColumn("ok", F.col("ok") & F.col("label").isNotNull())
    valid = rows.where("ok").select("id", "label", "vec")
    points = stored(valid.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("first")), "distinct-vectors")
    points = stored(points.withColumn("node", F.monotonically_increasing_id()), "points")
    found = stored(near_pairs(points, cosine, shard, sample), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found, "node", "root")
    named = points.join(links, "node", "left").join(comp.withColumnRenamed("root", "top"), "node", "left").select(
        "node", "label", "vec", "first", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("top", "node").alias("top"))
    lowest = named.groupBy("top").agg(F.min("first").alias("component_id"))
    result = stored(named.join(lowest, "top").select("label", "vec", "n_links", "component_id"), "vector-components")
    linked = valid.join(sized(result), ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
