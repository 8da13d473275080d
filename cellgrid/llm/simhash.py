"""SimHash near-duplicates through vantage-point partitioning.

Every text becomes a 64-bit fingerprint; fingerprints link at ``max_bits`` or
fewer differing bits.  Copies share a fingerprint, so all further work is on
distinct fingerprints:

1. a vantage-point tree is grown on the driver from a bounded sample of them
   (``SAMPLE``; only pivots and radii are kept).  A node whose expected size is
   above ``SHARD`` is cut at the median distance ``r`` to its pivot;
2. every fingerprint walks that tree inside the tasks.  By the triangle
   inequality a pair within ``max_bits`` is either on one side of ``r``, or both
   are within ``max_bits`` of ``r``: the two boundary strips go to a cross shard
   of their own, cut further in the same way.  So every close pair meets in
   some shard.  A tight cluster that no pivot cuts well is dealt by hash into
   parts, and every two parts are a shard, so a shard is bounded in any data;
3. inside a shard the same cuts continue down to small blocks that are
   compared bit by bit.  Only a spanning set of links leaves the shard, and
   parts that are one component already are not compared again, so a large
   group of near copies costs rows in proportion to its size.  Dealt clusters come
   after all other shards and start with the components found there;
4. components of the links (``common.components``) go back to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import components, fresh, ref, stored, with_workers

SEED = 42
SAMPLE = 65_536      # fingerprints the driver may see to place pivots
SHARD = 65_536       # expected fingerprints of a shard (512 kB)
BLOCK = 256          # side of a block that is compared directly

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int32) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of a text: ASCII lower case, words between ASCII white
    space, ``shingle``-word shingles with repeats, XXH64 seed 42; a bit is set
    if it is set in over half of the hashes.  No words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 1 << 18):
        part = np.bincount((raw[at:at + (1 << 18)] + _PLACE).ravel(), minlength=2048).reshape(8, 256)
        ones += (part @ _BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(doc_id, h, fp)``: one row per input row; ``fp`` is the signed 64-bit
    view and ``h`` a hash of the whole text."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:   # Arrow: ids pass through as they are, beside nulls too
            fp = _signed([fingerprint(t, shingle) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp)], ["doc_id", "h", "fp"])

    src = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint")


# ---------------------------------------------------------------- the tree

def _distance(x: np.ndarray, pivot: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ pivot).astype(np.int16)


def grow(sample: np.ndarray, total: int, bits: int, shard: int = SHARD) -> dict:
    """Routing tree from a sample of distinct fingerprints.  A node holds pivot, radius
    and children; ``own`` nodes hold one set, ``cross`` nodes two sides A and B.  Leaves hold
    their first shard number; ``deal`` is the number of parts of each side, so that two
    parts together are expected to fill one shard."""
    rng = np.random.default_rng(7)
    scale = total / max(1, len(sample))
    used = 0

    def leaf(*sides: np.ndarray) -> dict:
        nonlocal used
        whole = sum(map(len, sides)) * scale <= shard
        deal = [1 if whole else max(1, math.ceil(2 * len(a) * scale / shard)) for a in sides]
        first, used = used, used + deal[0] * deal[-1]
        return {"shard": first, "deal": deal}

    def cut(a: np.ndarray) -> tuple[np.uint64, int] | None:
        for pivot in a[rng.integers(len(a), size=8)]:
            r = int(np.median(_distance(a, pivot)))
            if 0 < (_distance(a, pivot) <= r).sum() < len(a):
                return pivot, r
        return None

    def own(a: np.ndarray, depth: int) -> dict:
        c = cut(a) if len(a) * scale > shard and len(a) > 8 and depth < 40 else None
        if not c:
            return leaf(a)
        d = _distance(a, c[0])
        i = d <= c[1]
        low, high = a[i & (d > c[1] - bits)], a[~i & (d <= c[1] + bits)]
        return {"pivot": c[0], "r": c[1], "in": own(a[i], depth + 1), "out": own(a[~i], depth + 1),
                "edge": cross(low, high, depth + 1)}

    def cross(a: np.ndarray, b: np.ndarray, depth: int) -> dict:
        c = cut(np.concatenate([a, b])) if (len(a) + len(b)) * scale > shard and len(a) + len(b) > 8 and depth < 40 else None
        if not c:
            return leaf(a, b)
        da, db = _distance(a, c[0]), _distance(b, c[0])
        ia, ib = da <= c[1], db <= c[1]
        la, ha = a[ia & (da > c[1] - bits)], a[~ia & (da <= c[1] + bits)]
        lb, hb = b[ib & (db > c[1] - bits)], b[~ib & (db <= c[1] + bits)]
        if len(la) + len(hb) + len(ha) + len(lb) > 0.9 * (len(a) + len(b)):
            return leaf(a, b)  # a tight cluster: cutting it would only copy it
        return {"pivot": c[0], "r": c[1], "in": cross(a[ia], b[ib], depth + 1), "out": cross(a[~ia], b[~ib], depth + 1),
                "edge": cross(la, hb, depth + 1), "edge2": cross(ha, lb, depth + 1)}

    return own(sample, 0)


def _dealt(node: dict, x: np.ndarray, side: int, two: bool) -> list[tuple[int, int, np.ndarray]]:
    """``walk`` at a leaf of several shards: one for every two parts."""
    first, mine, others = node["shard"], node["deal"][side], node["deal"][-1 - side]
    part = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(mine)
    out = []
    for i in range(mine):
        rows = x[part == i]
        for j in range(others) if len(rows) else ():
            if two:
                out.append((first + (i * others + j if side == 0 else j * mine + i), side + 1, rows))
            else:  # a part with itself, or with another one, the smaller number as side A
                out.append((first + min(i, j) * mine + max(i, j), 0 if i == j else 1 if i < j else 2, rows))
    return out


def dealt(node: dict) -> bool:
    """Does the tree hold leaves of several shards?"""
    if "shard" in node:
        return max(node["deal"]) > 1
    return any(dealt(node[k]) for k in ("in", "out", "edge", "edge2") if k in node)


def walk(node: dict, x: np.ndarray, bits: int, side: int = 0, two: bool = False,
         late: bool | None = None) -> list[tuple[int, int, np.ndarray]]:
    """``(shard, side, fingerprints)`` of every shard that ``x`` belongs to; with ``late``
    only of dealt leaves (true) or of all others (false)."""
    if not len(x):
        return []
    if "shard" in node:
        if late is not None and late != (max(node["deal"]) > 1):
            return []
        return _dealt(node, x, side, two) if max(node["deal"]) > 1 else [(node["shard"], side + 1 if two else 0, x)]
    d, r = _distance(x, node["pivot"]), node["r"]
    i = d <= r
    low, high = x[i & (d > r - bits)], x[~i & (d <= r + bits)]
    out = walk(node["in"], x[i], bits, side, two, late) + walk(node["out"], x[~i], bits, side, two, late)
    if not two:
        return out + walk(node["edge"], low, bits, 0, True, late) + walk(node["edge"], high, bits, 1, True, late)
    first, second = (low, high) if side == 0 else (high, low)
    return out + walk(node["edge"], first, bits, side, True, late) + walk(node["edge2"], second, bits, side, True, late)


class _Shard:
    """Exact links of one shard as component labels of its fingerprints."""

    def __init__(self, x: np.ndarray, bits: int, known: np.ndarray | None = None):
        self.x, self.bits = x, bits
        self.label = np.arange(len(x))
        if known is not None:  # rows of one known component start as one
            _, first, place = np.unique(known, return_index=True, return_inverse=True)
            self.label = first[place]
        self.start = self.label.copy()
        self.rng = np.random.default_rng(11)

    def merge(self, labels: np.ndarray) -> None:
        labels = np.unique(labels)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), BLOCK):
            rows = a[at:at + BLOCK]
            for bt in range(0, len(b), 4 * BLOCK):
                cols = b[bt:bt + 4 * BLOCK]
                near = np.bitwise_count(self.x[rows][:, None] ^ self.x[cols][None, :]) <= self.bits
                near &= self.label[rows][:, None] != self.label[cols][None, :]
                for k in np.flatnonzero(near.any(axis=1)):
                    self.merge(np.append(self.label[cols[near[k]]], self.label[rows[k]]))

    def _pivot(self, idx: np.ndarray) -> tuple[np.ndarray, int]:
        p = idx[self.rng.integers(len(idx))]
        d = _distance(self.x[idx], self.x[p])
        self.merge(np.append(self.label[idx[d <= self.bits]], self.label[p]))
        return d, int(np.median(d))

    def own(self, idx: np.ndarray) -> None:
        if len(idx) < 2 or (self.label[idx] == self.label[idx[0]]).all():
            return
        if len(idx) <= BLOCK:
            return self.compare(idx, idx)
        d, r = self._pivot(idx)
        i = d <= r
        if i.all():
            i = d < r
            r -= 1
        if i.all() or not i.any():
            return self.compare(idx, idx)
        self.own(idx[i])
        self.own(idx[~i])
        self.cross(idx[i & (d > r - self.bits)], idx[~i & (d <= r + self.bits)])

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        both = np.concatenate([a, b])
        if (self.label[both] == self.label[both[0]]).all():
            return
        if len(a) * len(b) <= BLOCK * BLOCK:
            return self.compare(a, b)
        d, r = self._pivot(both)
        da, db = d[:len(a)], d[len(a):]
        ia, ib = da <= r, db <= r
        la, ha = a[ia & (da > r - self.bits)], a[~ia & (da <= r + self.bits)]
        lb, hb = b[ib & (db > r - self.bits)], b[~ib & (db <= r + self.bits)]
        if len(la) + len(ha) + len(lb) + len(hb) > 0.9 * len(both):
            return self.compare(a, b)
        self.cross(a[ia], b[ib])
        self.cross(a[~ia], b[~ib])
        self.cross(la, hb)
        self.cross(ha, lb)


def shard_links(fps: np.ndarray, side: np.ndarray, bits: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(fp, fp)`` of one shard.  Side 0: all against all;
    sides 1 and 2: one side against the other.  ``known``: components found before,
    whose links are not given again."""
    s = _Shard(fps, bits, known)
    if (side == 0).any():
        s.own(np.arange(len(fps)))
    else:
        s.cross(np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    moved = np.unique(s.start[s.label != s.start])
    return fps[moved], fps[s.label[moved]]


def links(distinct: DataFrame, bits: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(a, b)``: links that span every component of the distinct
    fingerprints in column ``fp`` (signed), found exactly."""
    spark = with_workers(distinct.sparkSession)
    total = distinct.count()
    seen = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy()
    tree = grow(seen.astype(np.int64).view(np.uint64), total, bits, shard)

    def spanning(rows: DataFrame, late: bool) -> DataFrame:
        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b["fp"].to_numpy().astype(np.int64).view(np.uint64)
                for number, side, part in walk(tree, x, bits, late=late):
                    yield pd.DataFrame({"shard": np.full(len(part), number, dtype=np.int64),
                                        "side": np.full(len(part), side, dtype=np.int32), "fp": part.view(np.int64)})

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            known = pdf["root"].to_numpy() if late else None
            a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), bits, known)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        routed = rows.select("fp").mapInPandas(route, "shard bigint, side int, fp bigint")
        if late:
            routed = routed.join(rows, "fp").select("shard", "side", "fp", "root")
        return routed.groupBy("shard").applyInPandas(solve, "a bigint, b bigint")

    early = spanning(distinct, False)
    if not dealt(tree):
        return early
    early = stored(early, "early-links")
    comp = components(early, "a", "b")
    known = stored(distinct.join(comp, distinct["fp"] == comp["node"], "left")
                   .select(distinct["fp"], F.coalesce("root", distinct["fp"]).alias("root")), "known")
    return early.unionByName(spanning(known, True))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int,
             shard: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, h, fp)`` and the fingerprints' membership ``(fp, root)``."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.select("fp").distinct(), "distinct")
    comp = components(links(distinct, max_bits, shard, sample), "a", "b")
    member = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        distinct["fp"], F.coalesce("root", distinct["fp"]).alias("root"))
    return rows, stored(member, "membership")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits.  Null text counts as empty; empty texts have
    fingerprint 0 and link like any other.  Repeated rows are kept and share
    their component; rows with a null id take part and get the smallest
    non-null id of their component (null if there is none).  An empty table
    gives an empty result.  Extra columns are ignored.
    """
    rows, member = _grouped(docs, id_col, text_col, shingle, max_bits, shard, sample)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))  # copies meet before the join
    named = stored(member.join(first, "fp"), "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stored(named.join(lowest, "root").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """The first document of every group, with all its columns as they came.

    First is the smallest id (null ids last), then the smallest hash of the
    text; of fully tied rows one stays.  Groups and edge cases are those of
    ``near_duplicates``.
    """
    rows, member = _grouped(docs, id_col, text_col, shingle, max_bits, shard, sample)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    best = rows.groupBy("fp").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    first = member.join(best, "fp").groupBy("root").agg(F.min("best").alias("best"))
    first = stored(first.select(F.col("best.doc_id").alias("_id"), F.col("best.h").alias("_h")), "first")
    names = docs.columns
    h = fresh(docs, "h")
    mine = docs.withColumn(h, F.xxhash64(ref(docs, text_col).cast("string")))
    kept = mine.join(first, ref(mine, id_col).eqNullSafe(first["_id"]) & (mine[h] == first["_h"]), "left_semi")
    tied = rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    if tied:
        kept = kept.dropDuplicates([id_col, h])
    return kept.select(*[ref(kept, c) for c in names])


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
