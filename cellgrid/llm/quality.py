"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network whose probabilities are calibrated by a temperature.

Random indexing: every word form and word ending has a fixed sparse ternary
index vector (drawn from a hash, nothing to learn).  A word's context vector is
the sum of the index vectors of the words around it in the training sample, so
words used alike point alike; words the sample lacks still have the index
vectors of their ending and shape.  A document is the mean of its tokens'
vectors, once over all tokens and once over the distinct ones (the two differ
where text repeats), with its size and how often a token repeats the one before.

The fit sees a bounded sample of labelled documents (``SAMPLE``) on the driver
as small integers; scoring reads every whole text and needs tables of fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, with_workers
from cellgrid.llm.toxicity import fold, remembered

SAMPLE = 4000        # labelled documents that the fit may see
WORDS = 1 << 14      # hashed word forms with a context vector
FORMS = 1 << 11      # hashed endings and shapes
DIM = 48             # length of an index vector
ONES = 6             # its entries that are not zero
CHUNK = 1 << 15      # vectors summed at a time


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), dtype=np.float32)
    at = np.argsort(rng.random((rows, DIM)), axis=1)[:, :ONES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, ONES)), axis=1)
    return out / np.float32(np.sqrt(ONES))


def _shape(token: str) -> str:
    """Kinds of characters in order, runs as one (the last 40 characters)."""
    if token.isalpha() and token.islower():
        return "x"
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in token[-40:])
    return "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])


def numbers(token: str) -> tuple[int, int, int]:
    """Hashed word form, ending and shape of a token."""
    crc = lambda s: zlib.crc32(s.encode("utf-8", "replace"))
    return crc(token.lower()) % WORDS, crc("e" + token[-3:]) % FORMS, crc("s" + _shape(token)) % FORMS


@dataclass
class Tokens:
    """What the model needs of a text: word forms in order, distinct tokens
    (three numbers each) with their counts, and how many tokens repeat the one before."""

    order: np.ndarray
    kinds: np.ndarray
    many: np.ndarray
    again: int


def tokens_of(text: str | None, of_token=numbers, in_order: bool = True) -> Tokens:
    tokens = (text or "").split()
    many = Counter(tokens)
    nums = [of_token(t) for t in many]
    order = np.empty(0, np.uint16)
    if in_order:
        form = dict(zip(many, (n[0] for n in nums)))
        order = np.array([form[t] for t in tokens], dtype=np.uint16)
    return Tokens(order, np.array(nums, dtype=np.uint16).reshape(-1, 3), np.array(list(many.values()), dtype=np.int32),
                  sum(map(eq, tokens, islice(tokens, 1, None))))


def contexts(samples: list[np.ndarray], window: int = 2) -> np.ndarray:
    """Context vectors of the word forms (given in order), unit length; zero if never seen."""
    index, out = index_vectors(WORDS, 1), np.zeros((WORDS, DIM), dtype=np.float32)
    for s in samples:
        for at in range(0, len(s), CHUNK):
            w = s[at:at + CHUNK]
            v = index[w]
            near = np.zeros_like(v)
            for k in range(1, window + 1):
                near[k:] += v[:-k]
                near[:-k] += v[k:]
            np.add.at(out, w, near)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-9)


def token_vectors(nums: np.ndarray, context: np.ndarray, forms: np.ndarray) -> np.ndarray:
    return np.concatenate([context[nums[:, 0]], forms[nums[:, 1]], forms[nums[:, 2]]], axis=1)


def _document(total: np.ndarray, distinct: np.ndarray, n: int, kinds: int, again: int) -> np.ndarray:
    """Input of the network from sums over tokens and over distinct tokens;
    ``again`` counts tokens that repeat the one before."""
    size = [np.log1p(n), kinds / max(1, n), again / max(1, n), float(n == 0)]
    return np.concatenate([total / max(1, n), distinct / max(1, kinds), size]).astype(np.float32)


INPUTS = 6 * DIM + 4


def pooled(t: Tokens, context: np.ndarray, forms: np.ndarray) -> np.ndarray:
    total, distinct = np.zeros(3 * DIM, np.float32), np.zeros(3 * DIM, np.float32)
    for at in range(0, len(t.kinds), CHUNK):
        v = token_vectors(t.kinds[at:at + CHUNK], context, forms)
        total += t.many[at:at + CHUNK].astype(np.float32) @ v
        distinct += v.sum(axis=0)
    return _document(total, distinct, int(t.many.sum()), len(t.kinds), t.again)


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 2e-3,
        l2: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the log loss; every fifth document is kept aside to choose the
    epoch and the temperature.  One class only: a constant network."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    p = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  np.zeros(hidden), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2 or len(y) < 10:
        return net
    net.w2 = rng.normal(0, np.sqrt(1 / hidden), hidden)
    order = rng.permutation(len(y))
    aside, used = order[::5], np.delete(order, np.s_[::5])
    loss = lambda n, t=1.0: float(np.mean(np.logaddexp(0, np.where(y[aside] > 0, -1, 1) * n.logits(x[aside]) / t)))
    names, step, best = ("w1", "b1", "w2", "b2"), 0, (loss(net), None)
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            z = (x[rows] - mean) / scale
            h = np.maximum(0, z @ net.w1 + net.b1)
            slope = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - y[rows]) / len(rows)
            back = np.outer(slope, net.w2) * (h > 0)
            grads = {"w1": z.T @ back + l2 * net.w1, "b1": back.sum(axis=0), "w2": h.T @ slope + l2 * net.w2, "b2": slope.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, getattr(net, k) - move)
        if (now := loss(net)) < best[0]:
            best = (now, {k: np.copy(getattr(net, k)) for k in names})
    for k, v in (best[1] or {}).items():
        setattr(net, k, v if k != "b2" else float(v))
    net.temperature = min(np.exp(np.linspace(-1.5, 1.5, 61)), key=lambda t: loss(net, t))
    return net


@dataclass
class Model:
    context: np.ndarray
    forms: np.ndarray
    net: Network

    def scorer(self):
        """``text -> score`` of a whole text."""
        of_token = remembered(numbers)

        def score(text: str | None) -> float:
            x = pooled(tokens_of(text, of_token, in_order=False), self.context, self.forms)
            return float(self.net.probability(x[None, :])[0])

        return score


def train_on(samples: list[Tokens], y: np.ndarray) -> Model:
    context, forms = contexts([s.order for s in samples]), index_vectors(FORMS, 2)
    x = np.stack([pooled(s, context, forms) for s in samples]) if samples else np.zeros((0, INPUTS), np.float32)
    if not len(x):
        x, y = np.zeros((1, INPUTS), np.float32), np.zeros(1)
    return Model(context, forms, fit(x.astype(np.float64), y.astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, mod: int = 5, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold
    (chosen by a hash of the id).  No labels: a constant model."""
    with_workers(docs.sparkSession)
    d = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    lab = labels.select(ref(labels, id_col).alias("doc_id"), ref(labels, label_col).cast("int").alias("y"))
    lab = lab.where((fold(F.col("doc_id"), mod) != held_out) & F.col("y").isNotNull())
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_token = remembered(numbers)
        for b in batches:
            t = [tokens_of(x, of_token) for x in b["text"]]
            yield pd.DataFrame({"o": [x.order.tobytes() for x in t], "k": [x.kinds.tobytes() for x in t],
                                "m": [x.many.tobytes() for x in t], "a": [x.again for x in t], "y": b["y"]})

    rows = d.join(F.broadcast(lab), "doc_id").select("text", "y").limit(sample)
    got = rows.mapInPandas(run, "o binary, k binary, m binary, a bigint, y int").toPandas()
    samples = [Tokens(np.frombuffer(o, np.uint16), np.frombuffer(k, np.uint16).reshape(-1, 3), np.frombuffer(m, np.int32), int(a))
               for o, k, m, a in zip(got["o"], got["k"], got["m"], got["a"])]
    return train_on(samples, got["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; null text counts as empty, an empty
    text has the score of a document without tokens.  Repeated rows score
    alike; an empty table gives an empty result; extra columns are ignored.
    The model's tables have a fixed size (about 3.5 MB) and are broadcast."""
    spark = with_workers(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sent.value.scorer()
        for b in batches:   # Arrow: ids pass through as they are, beside nulls too
            scores = pa.array([one(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], ["doc_id", "score"])

    src = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
