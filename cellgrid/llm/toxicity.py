"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry information as labels; all other
training text counts as unlabelled, a mixture that holds toxic text at the
class prior.  With the logistic loss, a linear model ``f`` over the hashed
words and character 4-grams that toxic documents hold clearly more often minimises

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

in numpy; once the second term would fall below zero it stops pulling, which
keeps the model from fitting the unlabelled toxic documents as clean.  The fit sees bounded samples (``POSITIVES``,
``UNLABELLED``); scoring reads every whole text, batch by batch, and needs the
weights only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, with_workers

DIM = 1 << 18
POSITIVES = 2000     # confirmed toxic documents that the fit may see
UNLABELLED = 6000    # unlabelled documents that the fit may see
CACHE = 300_000      # words whose score a worker remembers
EDGES = ".,;:!?\"'()[]{}<>|%&$*#-_/\\"


def grams(word: str) -> list[int]:
    """Hashed features of a word: itself and its character 4-grams with ends marked."""
    marked = f"^{word}$"
    parts = {word, *(marked[i:i + 4] for i in range(len(marked) - 3))}
    return [zlib.crc32(p.encode("utf-8", "replace")) % DIM for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return {w for w in (t.strip(EDGES) for t in set((text or "").lower().split())) if w}


def remembered(of_word):
    """``of_word`` with a bounded memory of words."""
    known: dict = {}

    def call(w: str):
        got = known.get(w)
        if got is None:
            got = of_word(w)
            if len(w) <= 40:
                if len(known) >= CACHE:
                    known.clear()
                known[w] = got
        return got

    return call


def features(text: str | None, of_word=grams) -> np.ndarray:
    """Distinct feature numbers of a text."""
    return np.unique(np.array([g for w in distinct_words(text) for g in of_word(w)], dtype=np.int32))


@dataclass
class Model:
    """Weights of the selected features; all others weigh nothing."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        """``text -> score`` of a whole text."""
        weights = self.weights
        of_word = remembered(lambda w: tuple(g for g in grams(w) if g in weights))

        def score(text: str | None) -> float:
            seen: set[int] = set()
            for w in distinct_words(text):
                seen.update(of_word(w))
            z = self.bias + sum(weights[g] for g in sorted(seen))
            return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

        return score


def _held(rows: list[np.ndarray]) -> np.ndarray:
    """How often each feature is held; rows are counted one by one, with no copy of them all."""
    n = np.zeros(DIM, np.int64)
    for r in rows:
        np.add.at(n, r, 1)
    return n


def select(pos: list[np.ndarray], unl: list[np.ndarray], most: int = 1500, least_z: float = 4.0) -> np.ndarray:
    """Features that confirmed toxic documents hold clearly more often than
    unlabelled ones (two-proportion z score), the clearest first.  A feature
    must be in three toxic documents at least."""
    if not pos or not unl:
        return np.empty(0, np.int64)
    p, u = _held(pos), _held(unl)
    share = (p + u) / (len(pos) + len(unl))
    z = (p / len(pos) - u / len(unl)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / len(pos) + 1 / len(unl)))
    z[p < 3] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return best[z[best] >= least_z]


def _dense(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    place = np.full(DIM, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    return x


def lower_prior(toxic: int, labelled: int) -> float:
    """Lower two-sigma bound of the toxic share.  A prior above the truth lifts
    every score, one below it only dims the toxic ones, so err below."""
    if not labelled:
        return 0.0
    share = toxic / labelled
    return max(share / 2, share - 2 * np.sqrt(share * (1 - share) / labelled))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05,
        l2: float = 2e-4) -> Model:
    """Minimise the non-negative risk by Adam over the whole sample.

    Whole-sample steps: the corrected term is a difference of two means, which
    small batches would push below zero by chance."""
    prior = min(max(prior, 1e-4), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    chosen = select(pos, unl)
    if not len(chosen):
        return Model({}, bias)
    xp, xu = _dense(pos, chosen), _dense(unl, chosen)
    w = np.append(np.zeros(len(chosen)), bias)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        w32 = w[:-1].astype(np.float32)
        fp, fu = np.clip(xp @ w32 + w[-1], -40, 40), np.clip(xu @ w32 + w[-1], -40, 40)
        right_p, right_u = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        dp, du = prior * (right_p - 1) / len(xp), np.zeros(len(xu))
        if np.logaddexp(0, fu).mean() > prior * np.logaddexp(0, fp).mean():
            dp, du = dp - prior * right_p / len(xp), right_u / len(xu)
        g = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32), dp.sum() + du.sum())
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model({int(k): float(v) for k, v in zip(chosen, w)}, float(w[-1]))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """Features of the documents whose id is in ``ids`` (at most ``most`` rows)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_word = remembered(grams)
        for b in batches:
            yield pd.DataFrame({"f": [features(t, of_word).tobytes() for t in b["text"]]})

    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").limit(most)
    # Arrow buffers go back whole; an object a row leaves the driver's heap in pieces that it keeps
    got = rows.mapInPandas(run, "f binary").toArrow()["f"].chunks
    return [np.frombuffer(f.as_buffer(), np.int32) for chunk in got for f in chunk]


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, mod: int = 4, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> Model:
    """Fit on documents outside the held-out fold.  The prior is the lower bound
    of the share of toxic labels there.  No labels or no documents: a constant model."""
    with_workers(docs.sparkSession)
    d = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    d = d.where(fold(F.col("doc_id"), mod) != held_out)
    lab = labels.select(ref(labels, id_col).alias("doc_id"), ref(labels, label_col).alias("y"))
    lab = lab.where((fold(F.col("doc_id"), mod) != held_out) & F.col("y").isNotNull())
    toxic, labelled = lab.agg(F.count_if(F.col("y") == 1), F.count("y")).first()
    key = F.xxhash64("doc_id", F.lit(17))
    pick = lambda t, n: t.select("doc_id").distinct().orderBy(key, "doc_id").limit(n)
    pos = _sample(d, pick(lab.where("y = 1"), positives), positives)
    unl = _sample(d, pick(d, unlabelled), unlabelled)
    return fit(pos, unl, lower_prior(toxic, labelled))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          name: str = "score") -> DataFrame:
    """``(doc_id, score)`` for every row: whole texts, null counts as empty
    (an empty text gets the score of the bias alone).  Repeated rows score
    alike; an empty table gives an empty result; extra columns are ignored."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for b in batches:   # Arrow: ids pass through as they are, beside nulls too
            scores = pa.array([one(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], ["doc_id", name])

    src = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {name} double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``cutoff``, columns as they came."""
    with_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for b in batches:
            yield pd.Series([one(t) for t in b], dtype="float64")

    return docs.where(toxic(ref(docs, text_col).cast("string")) < cutoff)
