"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens on either side of it:

    h = tanh( sum_o E_o[t(i + o)] + b ),    P(t) = P(cluster of t | h) P(t | its cluster, h)

and a document's score is the sum of the logarithms. Tokens are lower-cased words: the most frequent of the corpus by themselves, all others by
a hash of their ending. Such a word's probability is that of its bucket times its share of the bucket's words in the whole corpus, so it is that
of the word and not of the bucket. Words are counted over all documents in ``CELLS`` cells by a hash: what tasks send is bounded, whatever the
number of distinct words, and words that share a cell share its count. The network is trained in numpy, where the documents are: each task starts from
the same weights, takes steps on positions of all of its documents, and the tasks' weights are averaged by their numbers of positions
(block by block over a shuffle); ``ROUNDS`` such rounds follow each other, each on other positions, all of them over the rounds. What is
counted and trained on grows with the corpus; what comes to the driver (a vocabulary, one set of weights) doesn't. Texts are split into tokens once; the ids, two
bytes a word, are stored in the shared checkpoint folder for the rounds and the scores.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import compress, repeat
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import BATCH_ROWS, arrow_schema, map_rows, whole_text
from tracesieve.llm.pretokens import Memo
from tracesieve.session import cut_lineage

CLUSTERS, CLUSTER = 32, 32
TOKENS = CLUSTERS * CLUSTER
WORDS = 768
PAD = TOKENS
SIDE = 2
OFFSETS = tuple(o for o in range(-SIDE, SIDE + 1) if o)
WIDTH = 24
#: Rounds of averaging. Each position is trained on in one of them: round r takes those whose place in the document modulo the rounds is r.
ROUNDS, BATCH, RATE, SEED = 2, 512, 0.08, 5
#: Rows of one cluster that a product takes together.
LANES = 16
#: Weights travel in so many blocks, so averaging is spread over tasks.
BLOCKS = 256
#: Words are counted in so many cells.
CELLS = 1 << 22
#: A task proposes the words of at least one in so many of its words for the vocabulary.
PROPOSE = 20_000
#: Tokens that are scored at once.
CHUNK = 1 << 13


class Weights(NamedTuple):
    E: np.ndarray  # (offset, token or PAD, WIDTH)
    b: np.ndarray
    A: np.ndarray  # (WIDTH, cluster)
    a: np.ndarray
    B: np.ndarray  # (cluster, WIDTH, token in cluster)
    c: np.ndarray  # (cluster, token in cluster)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self])


_SHAPES = ((len(OFFSETS), TOKENS + 1, WIDTH), (WIDTH,), (WIDTH, CLUSTERS), (CLUSTERS,), (CLUSTERS, WIDTH, CLUSTER), (CLUSTERS, CLUSTER))
_SIZES = [int(np.prod(s)) for s in _SHAPES]


def unflat(v: np.ndarray) -> Weights:
    parts = np.split(v.astype(np.float32), np.cumsum(_SIZES)[:-1])
    return Weights(*(p.reshape(s).copy() for p, s in zip(parts, _SHAPES)))


def first_weights(seed: int = SEED) -> Weights:
    return unflat(np.random.default_rng(seed).normal(0, 0.1, sum(_SIZES)))


class Vocabulary:
    """Token ids: a frequent word's rank, else a bucket by the word's last letters. Clusters hold neighbours in rank."""

    def __init__(self, words: list[str]) -> None:
        self.known = {w: i for i, w in enumerate(words[:WORDS])}
        self.endings = Memo(lambda e: WORDS + zlib.crc32(e.encode("utf-8")) % (TOKENS - WORDS))

    def ids(self, text: str) -> list[int]:
        return self.of(text.lower().split())

    def of(self, words: list[str]) -> list[int]:
        find, endings = self.known.get, self.endings
        return [endings[w[-2:]] if (i := find(w)) is None else i for w in words]

    def encode(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Packed ids of the words, and those of them that aren't tokens, in order: as `of`, without a Python step per word."""
        ids = np.fromiter(map(self.known.get, words, repeat(TOKENS)), "<u2", len(words))
        other = ids == TOKENS
        rare = list(compress(words, other.tolist()))
        ids[other] = np.fromiter(map(self.endings.__getitem__, map(_ENDING, rare)), "<u2", len(rare))
        return ids, rare


_ENDING = itemgetter(slice(-2, None))


def cell_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CELLS


def cells_of(words: Collection[str]) -> np.ndarray:
    """`cell_of` of many words; these come from texts, so they have no lone surrogates."""
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), np.int64, len(words)) % CELLS


class Counts(NamedTuple):
    """How often the words of each cell occur in the corpus, and words that may be among its most frequent."""

    cells: np.ndarray
    proposed: list[str]

    def most_frequent(self, words: int = WORDS) -> list[str]:
        """The words of the fullest cells, ties by the word. A word of at least one in ``PROPOSE`` was proposed by some task."""
        return sorted(self.proposed, key=lambda w: (-int(self.cells[cell_of(w)]), w))[:words]

    def log(self, word: str) -> float:
        """Logarithm of the count of the word's cell; a word that no document has counts as seen once."""
        return float(np.log(max(1, self.cells[cell_of(word)])))


def word_counts(docs: DataFrame, text: str = "text") -> Counts:
    """Counts of the lower-cased words of all documents.

    A task adds up its words in the cells and sends the cells that it filled, in blocks; blocks are summed by several tasks. Its proposals are
    those of its words that are frequent in it, at most ``PROPOSE``.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shape = "block long, cells binary, counts binary, words array<string>"
    size = CELLS // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, frequent, total = np.zeros(CELLS, np.int64), Counter(), 0
        for b in batches:
            some: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                some.update(t.lower().split())
            n = np.fromiter(some.values(), np.int64, len(some))
            np.add.at(cells, cells_of(some), n)
            total += int(n.sum())
            # words are remembered while they may still reach their share
            for w, k in some.items():
                if w in frequent or k * PROPOSE >= total // 16:
                    frequent[w] += k
            if len(frequent) > 16 * PROPOSE:
                frequent = Counter(dict(frequent.most_common(4 * PROPOSE)))
        if not total:
            return
        words = [w for w, k in frequent.most_common(PROPOSE) if k * PROPOSE >= total]
        for block in range(BLOCKS):
            part = cells[block * size:(block + 1) * size]
            filled = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([filled.astype(np.int32).tobytes()], pa.binary()),
                                              pa.array([part[filled].tobytes()], pa.binary()), pa.array([words[block::BLOCKS]], pa.list_(pa.string()))],
                                             schema=arrow_schema(shape))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        words: dict[int, set[str]] = {}
        for b in batches:
            for block, filled, counts, proposed in zip(*(c.to_pylist() for c in b.columns)):
                cells = sums.setdefault(block, np.zeros(size, np.int64))
                cells[np.frombuffer(filled, np.int32)] += np.frombuffer(counts, np.int64)
                words.setdefault(block, set()).update(proposed)
        for block, cells in sums.items():
            filled = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([filled.astype(np.int32).tobytes()], pa.binary()),
                                              pa.array([cells[filled].tobytes()], pa.binary()), pa.array([sorted(words[block])], pa.list_(pa.string()))],
                                             schema=arrow_schema(shape))

    summed = docs.select(whole_text(text)).mapInArrow(task, shape).repartition("block").mapInArrow(total, shape)
    cells, proposed = np.zeros(CELLS, np.int64), set()
    for r in summed.toLocalIterator():  # a row per block
        cells[r["block"] * size + np.frombuffer(r["cells"], np.int32)] = np.frombuffer(r["counts"], np.int64)
        proposed.update(r["words"])
    return Counts(cells, sorted(proposed))


def frequent_words(docs: DataFrame, text: str = "text", words: int = WORDS) -> list[str]:
    """The ``words`` most frequent lower-cased words of all documents, ties by the word."""
    return word_counts(docs, text).most_frequent(words)


def stream_of(documents: list[np.ndarray | list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids one after the other with SIDE pads between, and the positions of the tokens."""
    pad = np.full(SIDE, PAD, np.int32)
    ids = np.concatenate([pad, *(x for d in documents for x in (np.asarray(d, np.int32), pad))])
    return ids, np.flatnonzero(ids != PAD)


def encode(docs: DataFrame, words: list[str], text: str = "text", key: str = "doc_id", counts: Counts | None = None) -> DataFrame:
    """(key, ids, logs): every whole text as packed unsigned 16-bit token ids, two bytes a word.

    ``logs`` is the sum of the logarithms of the counts of the words that aren't tokens, 0 without ``counts``.
    """
    # four bytes a cell; a float32 logarithm is exact to seven digits
    logs = None if counts is None else np.log(np.maximum(counts.cells, 1)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((words, logs))

    def make():
        known, given = shared.value
        vocabulary = Vocabulary(known)

        def row(k, t):
            words = t.lower().split()
            ids, rare = vocabulary.encode(words)
            # few distinct endings, but as many words as the corpus has: cells are cheaper to make than to remember
            logs = 0.0 if given is None else float(given[cells_of(rare)].sum(dtype=np.float64))
            return k, ids.tobytes(), logs
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make, f"{key} long, ids binary, logs double")


def bucket_totals(encoded: DataFrame) -> np.ndarray:
    """Logarithm of the number of words in each token's bucket over the whole corpus; 0 for tokens that are words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TOKENS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, "<u2"), minlength=TOKENS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WORDS, TOKENS)), pa.array(n[WORDS:])], schema=arrow_schema("token long, n long"))
    out = np.zeros(TOKENS)
    for r in encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = np.log(max(1, r["n"]))
    return out


_AWAY, _FIRST = np.array(OFFSETS)[:, None], np.arange(len(OFFSETS), dtype=np.int32)[:, None] * (TOKENS + 1)


def _rows_near(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(offset, position): row of the table of all offsets that each position's neighbour has."""
    return ids.take(at + _AWAY) + _FIRST


def _hidden(w: Weights, near: np.ndarray) -> np.ndarray:
    x = w.E.reshape(-1, WIDTH).take(near, axis=0).sum(0)
    x += w.b
    return np.tanh(x, out=x)


#: Logits that lie within so much can share one shift: no exponential of theirs leaves the range of float32.
SPREAD = 80


def _shifted(x: np.ndarray) -> np.ndarray:
    """Logits less what keeps their exponentials in range: one number if they all lie close enough, else each row's largest. In place."""
    if len(x):
        top = x.max()
        x -= top if top - x.min() <= SPREAD else x.max(1, keepdims=True)
    return x


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows; a product is several times as fast as sum(1)."""
    return x @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of every row, in place."""
    np.exp(_shifted(x), out=x)
    x /= _row_sums(x)[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of one column per row; x is overwritten."""
    picked = _shifted(x)[np.arange(len(x)), at]
    return picked - np.log(_row_sums(np.exp(x, out=x)))


def log_probabilities(w: Weights, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P of the tokens at the positions, each given what is around it."""
    out = np.empty(len(at))
    for s in range(0, len(at), CHUNK):
        part = at[s:s + CHUNK]
        order = np.argsort((ids[part] // CLUSTER).astype(np.uint8), kind="stable")
        part = part[order]
        h, (cluster, inside) = _hidden(w, _rows_near(ids, part)), np.divmod(ids[part], CLUSTER)
        x = h @ w.A
        x += w.a
        logs = _log_softmax_at(x, cluster)
        edges = np.searchsorted(cluster, np.arange(CLUSTERS + 1))
        for k in range(CLUSTERS):  # x now takes the logits inside the clusters
            rows = slice(edges[k], edges[k + 1])
            np.dot(h[rows], w.B[k], out=x[rows])
            x[rows] += w.c[k]
        logs += _log_softmax_at(x, inside)
        out[s + order] = logs
    return out


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the float32 rows from each index to the next. Pairs of numbers are added as complex ones, which halves numpy's inner loops."""
    return np.add.reduceat(x.view(np.complex64), first).view(np.float32)


def train(w: Weights, ids: np.ndarray, at: np.ndarray, memory: Weights) -> None:
    """One pass of Adagrad over the positions, in place; ``memory`` holds the sums of squared gradients.

    A batch is sorted by cluster and laid out in lanes of ``LANES`` rows of one cluster, so one product serves all clusters. Biases are
    the last rows of their matrices meanwhile, for a last hidden value of 1.
    """
    def joined(x: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return x.E.reshape(-1, WIDTH), x.b, np.concatenate([x.A, x.a[None]]), np.concatenate([x.B, x.c[:, None]], 1)

    def change(g: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What to take from the weights, made in g; m gains the squares."""
        root = g * g
        m += root
        np.sqrt(m, out=root)
        root += 1e-6
        g *= RATE
        g /= root
        return g

    (table, b, A, B), (table_m, b_m, A_m, B_m) = joined(w), joined(memory)
    clusters = np.arange(CLUSTERS)
    for s in range(0, len(at), BATCH):
        part = at[s:s + BATCH]
        part = part[np.argsort((ids.take(part) // CLUSTER).astype(np.uint8), kind="stable")]
        n, near, target = len(part), _rows_near(ids, part), ids.take(part)
        rows, cluster, inside = np.arange(n), target // CLUSTER, target % CLUSTER
        h = np.ones((n, WIDTH + 1), np.float32)
        h[:, :WIDTH] = _hidden(w, near)
        top = _softmax(h @ A)
        top.reshape(-1)[rows * CLUSTERS + cluster] -= 1
        count = np.bincount(cluster, minlength=CLUSTERS)
        lanes = -(-count // LANES)
        of_lane = np.repeat(clusters, lanes)
        slot = rows + ((np.cumsum(lanes) - lanes) * LANES - (np.cumsum(count) - count)).take(cluster)
        H = np.zeros((len(of_lane) * LANES, WIDTH + 1), np.float32)
        H[slot] = h
        H, near_B = H.reshape(-1, LANES, WIDTH + 1), B.take(of_lane, axis=0)
        p = _softmax((H @ near_B).reshape(-1, CLUSTER).take(slot, axis=0))
        p.reshape(-1)[rows * CLUSTER + inside] -= 1
        # gradients of the mean over the batch
        top /= n
        p /= n
        low = np.zeros((len(of_lane) * LANES, CLUSTER), np.float32)
        low[slot] = p
        low = low.reshape(-1, LANES, CLUSTER)
        dx = (low @ near_B[:, :WIDTH].transpose(0, 2, 1)).reshape(-1, WIDTH).take(slot, axis=0)
        dx += top @ A[:WIDTH].T
        dx *= 1 - np.square(h[:, :WIDTH])
        # a cluster's lanes are added up by a product as well; clusters without positions get gradients of 0, which change nothing
        of_cluster = (clusters[:, None] == of_lane).astype(np.float32)
        dB = (of_cluster @ (H.transpose(0, 2, 1) @ low).reshape(len(of_lane), -1)).reshape(B.shape)
        for v, m, g in ((b, b_m, np.ones(n, np.float32) @ dx), (A, A_m, h.T @ top), (B, B_m, dB)):
            v -= change(g, m)
        # only the rows of tokens that occur, of all offsets at once
        near = near.astype(np.uint16).ravel()
        order = np.argsort(near, kind="stable")
        near = near[order]
        first = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1])
        found = near[first]
        m, v = table_m.take(found, axis=0), table.take(found, axis=0)
        v -= change(_sums(dx.take(order % n, axis=0), first), m)
        table_m[found], table[found] = m, v
    for x, ab, BC in ((w, A, B), (memory, A_m, B_m)):
        x.A[:], x.a[:], x.B[:], x.c[:] = ab[:-1], ab[-1], BC[:, :-1], BC[:, -1]


def _documents(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, seed: int = SEED) -> tuple[list[str], Weights]:
    """Vocabulary and weights learned from all documents. Without any token the first weights stay."""
    words = frequent_words(docs, text)
    return words, learn(cut_lineage(encode(docs.withColumn("__key", F.lit(0)), words, text, "__key")), rounds, seed)


def learn(encoded: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> Weights:
    """Weights after ``rounds`` of training in the tasks and averaging over them. ``encoded`` has a column ids and should be stored."""
    spark = encoded.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    weights, texts = first_weights(seed), encoded.select("ids")
    shape = "block long, positions double, weights binary"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights.flat())

        def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = unflat(shared.value)
            memory, seen = Weights(*(np.full_like(v, 1e-4) for v in w)), 0
            for batch in batches:
                documents = _documents(batch.column(0))
                ids, at = stream_of(documents)
                nth = np.concatenate([np.arange(len(d)) for d in documents]) if documents else at
                at = at[nth % rounds == turn]
                train(w, ids, at, memory)
                seen += len(at)
            if seen:
                yield _blocks(w.flat() * np.float64(seen), seen, shape)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            count: dict[int, float] = {}
            for batch in batches:
                for block, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                    v = np.frombuffer(v, np.float64)
                    sums[block], count[block] = sums.get(block, 0) + v, count.get(block, 0) + n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(count.values()), pa.float64()),
                                                  pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=arrow_schema(shape))

        mine = texts.mapInArrow(train_task, shape)
        # a task adds up what it gets as it comes and holds no more than its blocks' sums
        means = mine.repartition("block").mapInArrow(total, shape).collect()
        if not means:
            break
        means.sort(key=lambda r: r["block"])
        weights = unflat(np.concatenate([np.frombuffer(r["weights"], np.float64) / r["positions"] for r in means]))
        shared.unpersist()
    return weights


def _blocks(flat: np.ndarray, positions: int, shape: str) -> pa.RecordBatch:
    parts = np.array_split(flat, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int64()), pa.array([float(positions)] * BLOCKS, pa.float64()),
                                       pa.array([p.tobytes() for p in parts], pa.binary())], schema=arrow_schema(shape))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", fitted: tuple[list[str], Weights] | None = None,
          counts: Counts | None = None) -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob, perplexity) of every whole text, by a model of the same documents unless one is given.

    A given model knows no words besides its tokens and scores the buckets of all others, unless ``counts`` come with it (the buckets' totals are
    those of the documents scored); words that these don't have count as seen once. Null, empty and blank texts have no tokens: log_prob 0,
    mean_log_prob and perplexity null. Repeated rows repeat; null keys stay.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if not fitted:
        counts = word_counts(docs, text)
    words = fitted[0] if fitted else counts.most_frequent()
    encoded = encode(docs, words, text, key, counts)
    if counts is not None:
        encoded = cut_lineage(encoded)
    totals = bucket_totals(encoded) if counts is not None else np.zeros(TOKENS)
    shared = spark.sparkContext.broadcast(((fitted[1] if fitted else learn(encoded)).flat(), totals))
    shape = f"{key} long, n_tokens long, log_prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, less = unflat(shared.value[0]), shared.value[1]
        for batch in batches:
            documents = _documents(batch.column(1))
            ids, at = stream_of(documents)
            sums = np.r_[0.0, np.cumsum(log_probabilities(w, ids, at) - less[ids[at]])]
            n = np.array([len(d) for d in documents], np.int64)
            ends = np.cumsum(n)
            logs = sums[ends] - sums[ends - n] + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(logs, pa.float64())], schema=arrow_schema(shape))

    scored = encoded.select(key, "ids", "logs").mapInArrow(run, shape)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select(key, "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.when(mean.isNotNull(), F.exp(F.least(-mean, F.lit(700.0)))).alias("perplexity"))
