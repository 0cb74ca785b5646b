"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Best fit places a document by its length alone, so equal lengths are placed together: a histogram of at most ``capacity``
lengths decides the whole packing. `plan_bins` walks it from the longest length down and asks a segment tree over the
remaining capacities for the tightest open bins; each answer is a run (so many pieces of this length go to these bins at this
offset). Pieces then find their place by their rank among the pieces of equal length. No group of documents is ever held
in one task, and the number of sequences is that of one global best-fit-decreasing pass.
"""
from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.frames import BATCH_ROWS, arrow_schema, whole_text
from tracesieve.llm.pretokens import Memo, split
from tracesieve.llm.token_counts import TOKENIZER, byte_alphabet, library
from tracesieve.session import cut_lineage

CAPACITY = 1024
END_OF_TEXT = 2


class OpenBins:
    """Segment tree over remaining capacities 1..capacity: runs of open bins, and the tightest that fit."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first bin, number of bins)

    def _set(self, remaining: int, value: bool) -> None:
        node = self.leaves + remaining
        self.filled[node] = value
        while node > 1:
            node >>= 1
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def put(self, remaining: int, first: int, number: int) -> None:
        if remaining and number:
            self.runs[remaining].append((first, number))
            self._set(remaining, True)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that takes ``length``."""
        node = self.leaves + length
        if self.filled[node]:
            return length
        while node > 1:
            if not node & 1 and self.filled[node + 1]:  # a left child: all of its sibling is larger
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.filled[2 * node])
                return node - self.leaves
            node >>= 1
        return None

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        if not self.runs[remaining]:
            self._set(remaining, False)
        return run


class Run(NamedTuple):
    """Pieces of rank ``rank``.. of one length: ``each`` to a bin, from bin ``first`` on, starting at ``offset``."""

    rank: int
    first: int
    each: int
    offset: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[Run]]:
    """Best-fit-decreasing runs by length. Lengths must lie in 1..capacity."""
    bins, opened, plan = OpenBins(capacity), 0, {}
    for length in sorted(histogram, reverse=True):
        left, rank, runs = histogram[length], 0, []
        while left:
            remaining = bins.tightest(length)
            if remaining is None:
                remaining = capacity
                first, number = opened, -(-left // (capacity // length))
                opened += number
            else:
                first, number = bins.take(remaining)
            each = remaining // length  # a bin that took one is the tightest for the next, while it fits
            full = min(number, left // each)
            runs.append(Run(rank, first, each, capacity - remaining))
            bins.put(remaining - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < number:
                if left:
                    bins.put(remaining - left * length, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                bins.put(remaining, first + full, number - full)
        plan[length] = runs
    return plan


def place(runs: list[Run], length: int, rank: int) -> tuple[int, int]:
    """(bin, offset) of the piece of this rank among those of its length."""
    run = runs[bisect_right(runs, rank, key=lambda r: r.rank) - 1]
    bin_, nth = divmod(rank - run.rank, run.each)
    return run.first + bin_, run.offset + nth * length


def piece_encoder(name: str) -> Callable[[str], list[int]]:
    """Ids of one pre-token as the library of a vocabulary file gives them.

    The merges of a byte-level vocabulary are ranks of byte strings, and where each merge makes a token of its own, merging by rank is what the
    library does; `tiktoken` does that several times faster for a pre-token not seen before. Other vocabularies go to their library.
    """
    lib = library(name)
    spec = json.loads(lib.tokenizer.to_str())
    model, split_by = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and split_by.get("type") == "ByteLevel" and not split_by.get("add_prefix_space") and spec["normalizer"] is None
             and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))
    if not plain:
        return lib.whole
    import tiktoken
    alphabet, vocabulary = byte_alphabet(), model["vocab"]
    if not all(c in vocabulary for c in alphabet):
        return lib.whole
    ids = [vocabulary[c] for c in alphabet]
    ranks = {bytes([b]): r for r, b in enumerate(alphabet.values())}
    for pair in model["merges"]:
        token = "".join(pair if isinstance(pair, list) else pair.split(" "))
        if ranks.setdefault(bytes(alphabet[c] for c in token), len(ids)) != len(ids):
            return lib.whole  # two merges make one token: ranks of byte strings can't tell them apart
        ids.append(vocabulary[token])
    encode = tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: [ids[r] for r in encode(piece.encode("utf-8"))]


class Encoder:
    """Packed ids of whole texts, each distinct pre-token once while a worker remembers it."""

    def __init__(self, name: str) -> None:
        self.lib, one = library(name), piece_encoder(name)
        self.memo = Memo(lambda piece: self._pack(one(piece)))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.lib.holds_special(text):
            return self._pack(self.lib.whole(text))
        return b"".join(map(self.memo.__getitem__, split(text)))


@cache
def _encoder(name: str) -> Encoder:
    """The worker's encoder; its memo outlives the task."""
    return Encoder(name)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER,
               capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): the pieces of every document's ids, an end id appended.

    Only documents above ``capacity`` are cut; the first piece takes the remainder, the others are full. ``nth`` counts
    the pieces of equal length within the task; both are only meaningful once the result is stored.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shape = _PIECES + ", task int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        task, seen, schema = TaskContext.get().partitionId(), [0] * (capacity + 1), arrow_schema(shape)
        last = end.to_bytes(4, "little")
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(t) + last
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, total, capacity)]):
                    length = capacity if piece else first
                    rows.append((k, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, shape)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in sequences of ``capacity`` tokens.

    A null or empty text is a document of the end id alone. Repeated rows and null keys are packed one by one like others.
    An empty table gives no rows.

    Texts are read and encoded once; the narrow pieces are stored in the shared checkpoint folder, which also fixes their
    ranks: a lost executor can't change them. The driver sees the histogram (``capacity`` rows at most) and broadcasts the runs,
    whose number is bounded by the histogram, not by the corpus.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, text, key, tokenizer, capacity, end))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    offsets = cut_lineage(by_task.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity))
    ranked = (pieces.join(offsets.select("task", "length", "before"), ["task", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("rank")))
    shape = _PIECES + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, schema = plan.value, arrow_schema(shape)
        for b in batches:
            if b.num_rows:
                lengths, ranks = b.column(3).to_pylist(), b.column(5).to_pylist()
                at = list(zip(*(place(runs[n], n, r) for n, r in zip(lengths, ranks))))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64())], schema=schema)

    return ranked.mapInArrow(run, shape)
