"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (windows of ``PASSAGE`` bytes of its whole text). Each passage becomes a vector of hashed byte-pair
frequencies, shares of character classes and of words said again at once, is encoded by one layer, and gets a gated attention weight

    a_k = softmax_k( w . ( tanh(h_k V) * sigmoid(h_k U) ) ),    score = sigmoid( c . sum_k a_k h_k + b )

All weights are learned from document labels alone, in numpy, on a bounded sample of labelled documents. Only the text enters a score.
"""
from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import BATCH_ROWS, map_rows, whole_text

PASSAGE = 512
HASHED = 256
HIDDEN, ATTENTION = 32, 16
#: Bounds of the fit: labelled documents (those with the lowest hash of their id) and passages of one document (evenly spread over it).
TRAIN_DOCS, TRAIN_PASSAGES = 6_000, 32
STEPS, BATCH, RATE, SEED = 1_200, 64, 3e-3, 7
THRESHOLD = 0.3
HELD_OUT = 5

# byte classes: lower, upper, digit, space, line end, other ASCII, non-ASCII
_CLASS = np.full(256, 5, np.intp)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 6
_CLASSES = 7
#: Distances at which a word is compared with an earlier one.
_ECHOES = (1, 2)
FEATURES = HASHED + _CLASSES + 1 + len(_ECHOES)


def encode_passages(text: str) -> np.ndarray:
    """One row of features per passage of the whole text; an empty text is one passage of zeros but for its length."""
    b = np.frombuffer(text.encode("utf-8"), np.uint8)
    n = max(1, -(-len(b) // PASSAGE))
    x = np.zeros((n, FEATURES), np.float32)
    if len(b):
        at = np.arange(len(b)) // PASSAGE
        pairs = (b[:-1].astype(np.intp) * 31 + b[1:] * 17) % HASHED
        x[:, :HASHED] = np.bincount(at[:-1] * HASHED + pairs, minlength=n * HASHED).reshape(n, HASHED)
        x[:, HASHED:HASHED + _CLASSES] = np.bincount(at * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES)
        size = np.bincount(at, minlength=n)[:, None]
        x[:, :HASHED] = np.sqrt(x[:, :HASHED] / size)
        x[:, HASHED:HASHED + _CLASSES] = np.sqrt(x[:, HASHED:HASHED + _CLASSES] / size)
        x[:, HASHED + _CLASSES] = size[:, 0] / PASSAGE
        words = text.split()
        at = np.arange(len(words)) * n // max(1, len(words))  # words are spread over the passages by their number
        in_passage = np.maximum(np.bincount(at, minlength=n), 1)
        for k, gap in enumerate(_ECHOES):
            same = np.fromiter(map(eq, words, words[gap:]), bool, max(0, len(words) - gap))
            x[:, HASHED + _CLASSES + 1 + k] = np.bincount(at[gap:][same], minlength=n) / in_passage
    return x


class Model(NamedTuple):
    """Weights: encoder (W, b), attention (V, U, w) and classifier (c, d)."""

    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags given as stacked passages and the first row of each bag, with what training needs."""
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        h = np.tanh(x @ self.W + self.b)
        t, g = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        e = (t * g) @ self.w
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ self.c + self.d)}

    def score(self, text: str) -> float:
        return float(self.forward(encode_passages(text), np.array([0]))["p"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(m: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
    f = m.forward(x, starts)
    bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
    error = (f["p"] - y) / len(y)
    dz = error[:, None] * m.c
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dtg = de[:, None] * m.w
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m.V.T + dg @ m.U.T) * (1 - h * h)
    return Model(x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, f["z"].T @ error, error.sum(keepdims=True))


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model | None:
    """Adam on the cross entropy of the bags' labels, about ``steps`` batches; None without any."""
    if not bags:
        return None
    epochs = -(-steps * BATCH // len(bags))
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    m = Model(draw(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION),
              np.zeros(HIDDEN, np.float32), np.array([np.log(share / (1 - share))], np.float32))
    first, second, step = [np.zeros_like(v) for v in m], [np.zeros_like(v) for v in m], 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            sizes = [len(bags[i]) for i in chosen]
            starts = np.cumsum([0, *sizes[:-1]])
            grads, step = gradients(m, np.concatenate([bags[i] for i in chosen]), starts, labels[chosen]), step + 1
            new = []
            for v, grad, p, q in zip(m, grads, first, second):
                p += 0.1 * (grad - p)
                q += 0.01 * (grad * grad - q)
                new.append((v - rate * (p / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32))
            m = Model(*new)
    return m


def held_out(key: Column) -> Column:
    """Documents that never teach: crc32 of the id as text divisible by 5. A null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          train_docs: int = TRAIN_DOCS) -> Model | None:
    """Model learned from at most ``train_docs`` labelled documents that are not held out.

    The chosen ids (a bounded number) are broadcast to the one scan of the texts; passages of the chosen come back encoded, at most
    ``TRAIN_PASSAGES`` each. Of several labels of a document the lowest counts; of repeated rows with one id one is used.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
           .agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")).join(F.broadcast(ids), "doc_id")

    def make():
        def row(k, t, y):
            x = encode_passages(t)
            if len(x) > TRAIN_PASSAGES:
                x = x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]
            return k, int(y), x.astype(np.float16).tobytes()
        return row
    rows = {r["doc_id"]: r for r in map_rows(chosen.select("doc_id", "text", "label"), make, "doc_id long, label long, x binary").toLocalIterator()}
    rows = [rows[k] for k in sorted(rows)]
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], np.float32))


def scores(model: Model | None):
    """Column function of a text column: its score. Without a model (no labels) every text scores 0.5."""
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0.5 if model is None else model.score(t or "") for t in texts], dtype="float64")
    return F.pandas_udf(score, "double")


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row; predicted is 1 where score >= ``threshold``.

    Null texts count as empty and get the score of an empty text; null keys are held out; repeated rows repeat their score.
    """
    model = learn(docs, labels, text, key)

    def make():
        def row(k, t, held):
            s = 0.5 if model is None else model.score(t)
            return k, held, s, int(s >= threshold)
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text).alias("text"), held_out(F.col(key)).alias("held_out")), make,
                    f"{key} long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, whole and with all columns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    score = scores(learn(docs, labels, text, key))
    return docs.withColumn("__score", score(F.col(text))).where(F.col("__score") >= threshold).drop("__score")
