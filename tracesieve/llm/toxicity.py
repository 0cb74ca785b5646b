"""Toxicity of documents by their nearest labelled examples.

A document's vector holds the damped frequency times the inverse document frequency of its terms. A term is a word, or the stem that words
begin with, that a text says at least once, twice, three or five times: an insult said again weighs more than a chance likeness. The labels
choose the vocabulary: terms whose share among toxic examples differs from that among clean ones by more than chance (chi-square with
Bonferroni's correction). Document frequencies count every document of the table.

The examples are kept in a block-max inverted index: example numbers run in blocks of ``BLOCK``, and every term knows its largest weight in
each block. A query adds these up to a bound per block, opens blocks from the highest bound on, and stops where the bound falls below the k-th
similarity found, so the neighbours are those of a full comparison. Examples with equal vectors are one neighbour, whose vote is split as
they are. Votes weigh more the shorter the distance; a prior stands for weak or missing evidence, and a logistic curve fitted on the examples, each judged by the others, turns votes into probabilities.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import arrow_schema, map_rows, whole_text
from tracesieve.llm.pretokens import Memo
from tracesieve.llm.quality_classifier import held_out
from tracesieve.session import cut_lineage

#: Bounds of the fit: toxic and clean labelled documents (those with the lowest hash of their id) and terms.
TOXIC_EXAMPLES, CLEAN_EXAMPLES, TERMS = 4_096, 8_192, 1_024
STEMS, LEVELS = (4, 5, 6), (1, 2, 3, 5)
LEAST_DOCS, ERROR_RATE = 5, 1e-6
NEIGHBOURS, BLOCK = 16, 64
#: Weight of the prior against the votes: as much as a neighbour at this similarity.
PRIOR = 0.25
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def roots(word: str) -> list[str]:
    """What a lower-case word counts for: itself and its stems."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def count_words(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def term_names(text: str) -> list[str]:
    """Names of all terms of a text, each once: ``root`` and, for higher levels, ``root#level``."""
    said: Counter[str] = Counter()
    for word, n in count_words(text).items():
        for r in roots(word):
            said[r] += n
    return [r if k == 1 else f"{r}#{k}" for r, n in said.items() for k in LEVELS if n >= k]


def critical_chi_square(error_rate: float) -> float:
    """Value that chi-square with one degree of freedom exceeds with this probability."""
    low, high = 0.0, 1500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > error_rate else (low, mid)
    return high


class Encoder:
    """Vocabulary as a function of texts. A term's frequency is how often its root is said, counted from its level on."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for name, t in vocabulary.items():
            root, _, level = name.partition("#")
            self.levels.setdefault(root, []).append((int(level or 1), t))
        self.memo = Memo(lambda word: tuple(r for r in roots(word) if r in self.levels))

    def counts(self, text: str) -> dict[int, int]:
        said: dict[str, int] = {}
        memo = self.memo
        for word, n in count_words(text).items():
            for r in memo[word]:
                said[r] = said.get(r, 0) + n
        return {t: n - level + 1 for r, n in said.items() for level, t in self.levels[r] if n >= level}

    def vector(self, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and TF-IDF weights of length one; both empty if no term occurs."""
        found = sorted(self.counts(text).items())
        terms = np.array([t for t, _ in found], np.int64)
        w = (1 + np.log(np.array([n for _, n in found], float))) * idf[terms]
        return terms, w / max(float(np.sqrt(w @ w)), 1e-300)


class BlockMaxIndex:
    """Inverted index of unit vectors with the largest weight of every term in every block of entries.

    Examples with equal vectors are one entry: its key is the least id, its counts are how many of them are clean and toxic. Entries are
    numbered so that like ones (by their heaviest term) share blocks, which keeps block bounds low.
    """

    def __init__(self, keys: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        groups: dict[bytes, list[int]] = {}
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            if len(vectors[i][0]):
                groups.setdefault(vectors[i][0].tobytes() + vectors[i][1].tobytes(), []).append(i)

        def place(members: list[int]) -> tuple:
            t, w = vectors[members[0]]
            return int(t[w.argmax()]), -float(w.max()), keys[members[0]]
        entries = sorted(groups.values(), key=place)
        self.keys = np.array([keys[e[0]] for e in entries], np.int64)
        self.second = {keys[e[0]]: keys[e[1]] for e in entries if len(e) > 1}
        self.counts = np.array([[sum(labels[i] == y for i in e) for y in (0, 1)] for e in entries], float).reshape(-1, 2)
        self.entry = {keys[i]: (n, labels[i]) for n, e in enumerate(entries) for i in e}
        self.blocks = -(-len(entries) // BLOCK)
        kept = [vectors[e[0]] for e in entries]
        term = np.concatenate([t for t, _ in kept]) if kept else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in kept]) if kept else np.zeros(0)
        number = np.repeat(np.arange(len(kept)), [len(t) for t, _ in kept])
        by_term = np.argsort(term, kind="stable")  # within a term entries ascend
        self.number, self.weight = number[by_term], weight[by_term]
        cell = term[by_term] * self.blocks + self.number // BLOCK
        self.start = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        self.largest = np.zeros((terms, self.blocks))
        np.maximum.at(self.largest.reshape(-1), cell, self.weight)

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, similarities) of all entries of some blocks that share a term with the query."""
        cells = (terms[:, None] * self.blocks + blocks).ravel()
        first, sizes = self.start[cells], self.start[cells + 1] - self.start[cells]
        at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        places = np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(terms)), sizes) + self.number[at] % BLOCK
        score = np.bincount(places, np.repeat(np.repeat(weights, len(blocks)), sizes) * self.weight[at], len(blocks) * BLOCK)
        hit = np.flatnonzero(score)
        return blocks[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, leave_out: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers, similarities) of the k entries of highest cosine above zero, the smaller key first on ties, and how many blocks were opened.

        An entry of which only ``leave_out`` is an example is passed over. Blocks are opened in rounds of growing size.
        """
        numbers, found, opened, step = np.zeros(0, np.int64), np.zeros(0), 0, 2
        if not len(terms) or not self.blocks:
            return numbers, found, 0
        own = self.entry.get(leave_out)
        skip = own[0] if own and self.counts[own[0]].sum() == 1 else -1
        bounds = weights @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        while opened < len(order):
            todo = order[opened:opened + step]
            if len(found) == k:
                todo = todo[bounds[todo] >= found[-1] - 1e-12]
            if not len(todo):
                break
            more, scores = self.scores(terms, weights, todo)
            opened, step = opened + len(todo), 2 * step
            numbers, found = np.append(numbers, more[more != skip]), np.append(found, scores[more != skip])
            best = np.lexsort((self.keys[numbers], -np.round(found, 12)))[:k]
            numbers, found = numbers[best], found[best]
        return numbers, found, opened


class Model(NamedTuple):
    """Everything that scores a text; bounded by the number of examples and terms."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    prior: float
    #: How many labelled documents an example of either class stands for, in proportion.
    stands_for: tuple[float, float]
    curve: tuple[float, float] = (1.0, 0.0)

    def toxic_shares(self, numbers: np.ndarray, leave_out: int | None = None) -> np.ndarray:
        """Share of toxic among the labelled documents that each entry stands for; the left-out example doesn't count."""
        counts = self.index.counts[numbers]
        own = self.index.entry.get(leave_out)
        if own:
            counts[numbers == own[0], own[1]] -= 1
        counts = counts * np.array(self.stands_for)
        return counts[:, 1] / counts.sum(1)

    def votes(self, shares: np.ndarray, similarities: np.ndarray) -> float:
        """Log odds of the votes and the prior. A vote weighs one less the cosine distance and is split as the entry's examples are."""
        toxic, clean = float(similarities @ shares), float(similarities @ (1 - shares))
        return math.log((toxic + PRIOR * self.prior) / (clean + PRIOR * (1 - self.prior)))

    def judge(self, encoder: Encoder, text: str, key: int | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(log odds, entries, similarities, toxic shares) of a text; the example ``key`` is left out."""
        numbers, similarities, _ = self.index.nearest(*encoder.vector(text, self.idf), leave_out=key)
        shares = self.toxic_shares(numbers, key)
        return self.votes(shares, similarities), numbers, similarities, shares

    def probability(self, log_odds: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * log_odds + b))))


def fit_curve(log_odds: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (never below zero) and offset of the logistic curve through weighted labels, by Newton steps with a slight pull to (1, 0)."""
    x = np.c_[log_odds, np.ones(len(log_odds))]
    pull, centre = np.eye(2) * 1e-2, np.array([1.0, 0.0])
    beta = centre.copy()

    def loss(v: np.ndarray) -> float:
        s = x @ v
        return float(weights @ (np.logaddexp(0, s) - labels * s) + (v - centre) @ pull @ (v - centre) / 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weights * (p - labels)) + pull @ (beta - centre)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + pull, grad)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-12:
            step /= 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def examples_of(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> tuple[DataFrame, tuple[float, float], float] | None:
    """(id, text, label) of the examples, how many labelled documents one of either class stands for, and the toxic share; None without labels.

    Of the labelled documents that are not held out those with the lowest hash of their id, ``TOXIC_EXAMPLES`` and ``CLEAN_EXAMPLES`` at most.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not totals:
        return None
    bounds = {1: TOXIC_EXAMPLES, 0: CLEAN_EXAMPLES}
    lowest = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in bounds.items()]
    ids = F.broadcast(lowest[0].union(lowest[1]))
    # of repeated rows with one id the least text counts
    chosen = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).join(ids, "id") \
        .groupBy("id", "label").agg(F.min("text").alias("text"))
    stands_for = tuple(totals.get(y, 0) / max(1, min(totals.get(y, 0), bounds[y])) for y in (0, 1))
    return cut_lineage(chosen), stands_for, totals.get(1, 0) / sum(totals.values())


def telling_terms(examples: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Terms of the vocabulary, the most telling first."""
    def make() -> Callable[..., tuple]:
        return lambda y, t: (y, term_names(t))
    counts = map_rows(examples.select("label", "text"), make, "label int, terms array<string>") \
        .select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    tested = counts.where(F.col("n") >= LEAST_DOCS)
    all_, toxic = sum(sizes.values()), sizes.get(1, 0)
    if not toxic or toxic == all_:
        return []
    mean = F.col("n") * F.lit(toxic / all_)
    rest = F.lit(float(all_)) - F.col("n")
    chi = (F.col("a") - mean) ** 2 * F.lit(float(all_)) / (mean * F.lit((all_ - toxic) / all_) * F.when(rest > 0, rest))
    critical = critical_chi_square(ERROR_RATE / max(1, tested.count()))
    best = tested.withColumn("chi", chi).where(F.col("chi") >= critical).orderBy(F.desc("chi"), "term").limit(TERMS)
    return [r["term"] for r in best.select("term", "chi").collect()]


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int], text: str) -> tuple[int, np.ndarray]:
    """Number of documents and, for every term, of those that have it: all documents are counted, by task, then added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found, n = Encoder(vocabulary), Counter(), 0
        for b in batches:
            n += b.num_rows
            for t in b.column(0).to_pylist():
                found.update(encode.counts(t).keys())
        found[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], schema=arrow_schema("term long, n long"))
    totals = docs.select(whole_text(text).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out, n = np.zeros(len(vocabulary)), 0
    for r in totals.collect():  # one row per term of the vocabulary
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n, out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    """Model of the labelled documents that are not held out; None if there is none."""
    chosen = examples_of(docs, labels, text, key, label)
    if chosen is None:
        return None
    examples, stands_for, share = chosen
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    vocabulary = {t: i for i, t in enumerate(telling_terms(examples, sizes))}
    n, frequency = document_frequencies(docs, vocabulary, text)
    idf = np.log((1 + n) / (1 + frequency)) + 1

    def encode() -> Callable[..., tuple]:
        encoder = Encoder(vocabulary)

        def row(k, y, t):
            terms, weights = encoder.vector(t, idf)
            return k, y, terms.tobytes(), weights.tobytes()
        return row
    rows = sorted(map_rows(examples.select("id", "label", "text"), encode, "id long, label int, terms binary, weights binary").collect(), key=lambda r: r["id"])
    vectors = [(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["weights"])) for r in rows]
    index = BlockMaxIndex([r["id"] for r in rows], [r["label"] for r in rows], vectors, len(vocabulary))
    prior = min(max(share, 1e-4), 1 - 1e-4)
    model = Model(vocabulary, idf, index, prior, tuple(s / max(stands_for) for s in stands_for))

    def judge() -> Callable[..., tuple]:
        encoder = Encoder(vocabulary)
        return lambda k, y, t: (k, y, model.judge(encoder, t, k)[0])
    judged = sorted(map_rows(examples.select("id", "label", "text"), judge, "id long, label int, odds double").collect(), key=lambda r: r["id"])
    y = np.array([r["label"] for r in judged], float)
    curve = fit_curve(np.array([r["odds"] for r in judged]), y, np.where(y == 1, model.stands_for[1], model.stands_for[0])) if judged else model.curve
    return model._replace(curve=curve)


def evidence(index: BlockMaxIndex, key: int | None, numbers: Iterable[int], similarities: Iterable[float], shares: Iterable[float]) -> str:
    """Neighbours as ``id:toxic share:similarity``, the nearest first; the id is the least of the other examples with that vector."""
    return ",".join(f"{index.second[k] if k == key else k}:{share:.3g}:{s:.6f}" for k, share, s in zip(index.keys[numbers].tolist(), shares, similarities))


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted, evidence) of every row; predicted is 1 where score >= ``threshold``.

    Null texts count as empty; a text without any telling term has no neighbours and gets the prior's calibrated score. An example is not
    its own neighbour. Null keys are held out, repeated rows repeat their result, and a document with several labels is toxic if one says so.
    Without labels every score is 0. Other columns are not read.
    """
    model = learn(docs, labels, text, key, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[..., tuple]:
        m = shared.value
        encoder = m and Encoder(m.vocabulary)

        def row(k, t, held):
            if m is None:
                return k, held, 0.0, int(threshold <= 0), ""
            odds, *found = m.judge(encoder, t, k)
            score = m.probability(odds)
            return k, held, score, int(score >= threshold), evidence(m.index, k, *found)
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text).alias("text"), held_out(F.col(key)).alias("held_out")), make,
                    f"{key} long, held_out boolean, score double, predicted int, evidence string")
