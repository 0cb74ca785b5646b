"""What a chain of filters removes in every order it may run in, per part of a table.

Each row's failures are a mask of bits, and all that an audit asks about a part is in the counts of its masks. Those counts become a
decision diagram: one level per filter, a low edge for rows that pass and a high edge for rows that fail, equal sub-diagrams shared, every node
holding the counts below it. In the diagram's order the all-pass path from the root reads off each step: what its high edges hold is
removed, what its low edges hold is kept. The next order is one swap of two adjacent levels away, which rewrites these two levels only, so
all orders are visited by as many swaps.

Spark makes the masks (one narrow scan of the texts), finds repeated texts by digest and adds up counts per part and mask; a part is one
row of at most 2^filters counts when it reaches its diagram, however many rows it has.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.frames import arrow_schema, map_rows, whole_text

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Counts that every mask and node carries, in this order.
MEASURES = ("rows", "good", "toxic")
Counts = tuple[int, ...]


class _Node:
    """A sub-diagram: where passing and failing rows go, and the counts of all rows below."""

    __slots__ = ("low", "high", "counts")

    def __init__(self, low: _Node | None, high: _Node | None, counts: Counts) -> None:
        self.low, self.high, self.counts = low, high, counts


class Diagram:
    """Count-weighted decision diagram over ``filters`` variables; ``order[k]`` is the filter tested at level k.

    Every path tests every filter, so a node's level is its distance from the root. Within a level no two nodes are equal.
    """

    def __init__(self, counts: Sequence[Counts], filters: int) -> None:
        self.order = list(range(filters))
        leaves: dict[Counts, _Node] = {}
        # in the first order filter 0 is tested first: leaf k of the row below has filter j's bit at place filters - 1 - j
        row = [leaves.setdefault(tuple(counts[self._mask(k, filters)]), _Node(None, None, tuple(counts[self._mask(k, filters)])))
               for k in range(1 << filters)]
        self.levels: list[list[_Node]] = []
        for _ in range(filters):
            table: dict[tuple[int, int], _Node] = {}
            row = [self._node(table, row[k], row[k + 1]) for k in range(0, len(row), 2)]
            self.levels.insert(0, list(table.values()))
        self.root = row[0]

    @staticmethod
    def _mask(leaf: int, filters: int) -> int:
        return int(f"{leaf:0{filters}b}"[::-1], 2)

    @staticmethod
    def _node(table: dict[tuple[int, int], _Node], low: _Node, high: _Node) -> _Node:
        key = (id(low), id(high))
        if key not in table:
            table[key] = _Node(low, high, tuple(a + b for a, b in zip(low.counts, high.counts)))
        return table[key]

    def swap(self, k: int) -> None:
        """Exchanges levels k and k + 1. Nodes above keep their children, nodes below stay as they are.

        Nodes of level k are rewritten in place. Two that were different stay different, as they still stand for different counts.
        """
        table: dict[tuple[int, int], _Node] = {}
        for node in self.levels[k]:
            pass_, fail = node.low, node.high
            node.low, node.high = self._node(table, pass_.low, fail.low), self._node(table, pass_.high, fail.high)
        self.levels[k + 1] = list(table.values())
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """(filter, kept, removed) along the all-pass path."""
        out, node = [], self.root
        for f in self.order:
            out.append((f, node.low.counts, node.high.counts))
            node = node.low
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, one after the other, to visit all n! orders once."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    leftwards = True
    while True:
        yield from (range(n - 2, -1, -1) if leftwards else range(n - 1))
        # the last item stands at one end; the others take their own next step behind or before it
        step = next(inner, None)
        if step is None:
            return
        yield step + leftwards
        leftwards = not leftwards


def audit_part(counts: Sequence[Counts], filters: int = len(LETTERS)) -> Iterator[tuple]:
    """(order, step, filter, kept, removed, redundant, unique fails, good lost, toxic lost, shapley) for all orders of one part."""
    diagram = Diagram(counts, filters)
    fails, unique, shapley, found = [0] * filters, [0] * filters, [0] * filters, []

    def visit() -> None:
        steps = diagram.steps()
        fails[steps[0][0]] = steps[0][2][0]  # tested first, a filter removes all that fail it
        unique[steps[-1][0]] = steps[-1][2][0]  # tested last, only those that fail nothing else
        for f, _, removed in steps:
            shapley[f] += removed[0]
        found.append((tuple(diagram.order), steps))
    visit()
    for k in adjacent_swaps(filters):
        diagram.swap(k)
        visit()
    for order, steps in found:
        for at, (f, kept, removed) in enumerate(steps, 1):
            yield order, at, f, kept[0], removed[0], fails[f] - removed[0], unique[f], removed[1], removed[2], shapley[f]


def text_failures(text: str) -> tuple[int, bytes]:
    """Bits of the failed filters A to D of a whole text (A is the lowest), and the text's digest."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()  # bytes split at exactly the six white-space characters of the contract
    n = len(words)
    capitals = len(b) - len(b.translate(None, _CAPITALS))
    mask = ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2
            | (len(b.translate(None, _MARKS)) < len(b)) << 3)
    return mask, hashlib.sha256(b).digest()


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, rows, good, toxic): documents of each part by the filters A to E they fail.

    Filter E, a text that some smaller id has too, needs the least id of every text. Copies are added up per text and part within the tasks
    before they meet, so a text that a third of all rows share arrives as one row per part and task. The labels are looked up by id,
    where rows are still one per document. Texts are compared by SHA-256.
    """
    def make() -> Callable[..., tuple]:
        return lambda k, p, t: (k, p, *text_failures(t))
    measured = map_rows(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                                    whole_text(text).alias("text")), make, "id long, part string, mask int, digest binary")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = measured.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("rows")).join(marks, "id", "left")
    rows = rows.withColumns({m: F.coalesce(m, F.lit(0)) * F.col("rows") for m in MEASURES[1:]})
    # a row without an id is never the least of its text, and no id is less than none, so such rows pass E
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *MEASURES))).alias("least")
    loose = [F.sum(F.when(F.col("id").isNull(), F.col("rows"))).alias("loose")]
    texts = rows.groupBy("digest", "part", "mask").agg(least, *loose, *[F.sum(m).alias(m) for m in MEASURES])
    first = texts.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    leads = F.col("least.id") == F.col("first")
    passing = {m: F.coalesce(F.when(leads, F.col(f"least.{m}")), F.lit(0)) + (F.coalesce("loose", F.lit(0)) if m == "rows" else F.lit(0))
               for m in MEASURES}
    both = first.select("part", F.explode(F.array(
        F.struct("mask", *[passing[m].alias(m) for m in MEASURES]),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), *[(F.col(m) - passing[m]).alias(m) for m in MEASURES]))).alias("c"))
    return both.select("part", "c.*").groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
       "toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, null parts as the empty part. Rows without an id have no labels and never fail E. Repeated rows with one id
    are not earlier than one another. Of several labels of a document one that says 1 is enough. Other columns are not read. An empty table has no parts.
    """
    counted = mask_counts(docs, labels, text, key, part)
    # at most 32 rows per part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("c")).select(
        "part", *[F.expr(f"transform(c, x -> cast(x.{m} as bigint))").alias(m) for m in ("mask", *MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(OUT)
        for b in batches:
            for name, masks, *measures in zip(*(c.to_pylist() for c in b.columns)):
                counts = [(0,) * len(MEASURES)] * (1 << len(LETTERS))
                for mask, *values in zip(masks, *measures):
                    counts[mask] = tuple(values)
                found = [(name, "".join(LETTERS[f] for f in order), at, *rest) for order, at, _, *rest in audit_part(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), shape)], schema=shape)

    return parts.mapInArrow(run, OUT)

