"""Near-duplicate groups by 64-bit SimHash and pivot distance tables.

Fingerprints within ``LINK`` bits of each other agree on at least ``blocks - LINK`` of ``blocks`` bit blocks, so every linked pair
meets in a bucket of some choice of that many blocks; no pair is lost. Inside a bucket

1. every fingerprint is compared with a few of the bucket's own members (its hubs), which ties a large group of near copies
   together with one row per member instead of one per pair;
2. what is then still in different components is compared pair by pair. Distances to ``PIVOTS`` reference fingerprints are
   computed once for each; a pair whose distances to any pivot differ by more than ``LINK`` can't be linked (triangle inequality)
   and is discarded, survivors are verified. Large buckets are dealt out in tiles, and only members outside the bucket's main
   component are compared with the rest.

Copies with equal fingerprints are one node throughout.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.components import components
from tracesieve.llm.frames import map_rows, whole_text
from tracesieve.session import cut_lineage

WORDS = 4
LINK = 4
SEED = 42
#: Members of a bucket with which all of its members are compared first.
HUBS = 4
#: Reference fingerprints: rows of a Hadamard matrix are as far from each other as can be.
PIVOTS = np.array([sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(1, 33)], np.uint64)
#: Side of a tile in which pairs are compared; rows that a task takes at once, and the least number of such cells.
TILE, CELL, CELLS = 512, 8192, 64


def simhash(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of the lower-cased (A-Z) words' shingles; a bit is set if it is in over half of them."""
    import xxhash
    found = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    n, digest = len(found) - k + 1, xxhash.xxh64_intdigest
    starts, ends = starts[:n].tolist(), ends[k - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + 65536], ends[at:at + 65536])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp): fingerprint of every whole text as a signed long; 0 for null, empty or blank texts."""
    def make():
        def row(k, t):
            h = simhash(t, words)
            return k, h - (1 << 64) if h >> 63 else h
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make, f"{key} long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(nodes: int, link: int = LINK) -> list[int]:
    """Bit masks of the bucket keys. More nodes take more, smaller blocks: longer keys keep buckets short. None loses a link."""
    blocks = link + 2
    while nodes > 1 << 64 * (blocks - link) // blocks + 3 and blocks < 12:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - link)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def bucketed(nodes: DataFrame, masks: list[int], *carried: str) -> DataFrame:
    """(mask, part, fp, carried...): every fingerprint in each of its buckets."""
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)))
    return nodes.select("fp", *carried, F.explode(keys).alias("k")).select("k.mask", "k.part", "fp", *carried)


def hub_links(buckets: DataFrame, link: int = LINK) -> DataFrame:
    """(u, v): members of a bucket and those of its hubs that they are linked to."""
    h = F.xxhash64("fp")
    hubs = (buckets.groupBy("mask", "part").agg(F.count("*").alias("n"), F.array_distinct(F.array(
        F.min("fp"), F.max("fp"), F.min_by("fp", h), F.max_by("fp", h))).alias("hubs")).where("n > 1").drop("n"))
    return (buckets.join(hubs, ["mask", "part"]).select("fp", F.explode("hubs").alias("hub"))
            .where((F.col("fp") != F.col("hub")) & (_bits("fp", "hub") <= link)).select(F.col("fp").alias("u"), F.col("hub").alias("v")))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to every pivot: one row per pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS]).astype(np.int8)


def linked(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that are linked: pivots discard, the rest is verified."""
    for distances in table:
        if len(i) < 64:
            break
        near = np.abs(distances[i] - distances[j]) <= link
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= link
    return i[near], j[near]


def _spanning(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """A forest of the given links: as many rows as it joins components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            yield x, y


def compare_cell(unit: np.ndarray, fps: np.ndarray, root: np.ndarray, asks: np.ndarray, link: int = LINK) -> list[tuple[int, int]]:
    """Links between different components within each unit (a bucket, or a tile of one). In tiles, pairs have one asking side."""
    order = np.lexsort((fps, unit))
    unit, fps, root, asks = unit[order], fps[order].view(np.uint64), root[order], asks[order]
    table, out = pivot_table(fps), []
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[start, len(unit)])
    of_row = np.repeat(size, size)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        other = (root[i] != root[j]) & (asks[i] | asks[j])
        i, j = linked(fps, table, i[other], j[other], link)
        out.extend(_spanning(root[i], root[j]))

    small = np.flatnonzero(of_row <= 64)  # all short units at once, by distance in the sorted order
    for d in range(1, min(64, len(unit))):
        i = small[small + d < len(unit)]
        i = i[unit[i] == unit[i + d]]
        if not len(i):
            break
        keep(i, i + d)
    for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist()):
        rows = np.arange(s, s + n)
        asking, chunk = rows[asks[s:s + n]], max(1, 1_000_000 // n)
        for at in range(0, len(asking), chunk):
            i, j = np.meshgrid(asking[at:at + chunk], rows, indexing="ij")
            keep(i.ravel(), j.ravel())
    return list(_spanning(*np.array(out, np.int64).T)) if out else []


def residual_links(buckets: DataFrame, link: int = LINK) -> DataFrame:
    """(u, v): links between components that meet in a bucket. ``buckets`` has (mask, part, fp, root)."""
    by_root = buckets.groupBy("mask", "part", "root").agg(F.count("*").alias("n"))
    mixed = (by_root.groupBy("mask", "part").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("most"),
                                                 F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1"))
    tiled = F.col("n") > TILE
    rows = buckets.join(mixed, ["mask", "part"]).withColumn("minor", F.col("root") != F.col("main"))
    ask_tiles, all_tiles = F.ceil((F.col("n") - F.col("most")) / TILE).cast("int"), F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.when(tiled, F.col("tiles")).otherwise(1)).cast("int")
    # an asking row visits all tiles of its bucket, any other row all asking tiles; short buckets have one of each
    every = F.lit(0).alias("ask"), F.lit(0).alias("tile")
    short = rows.where(~tiled).select("mask", "part", "fp", "root", F.lit(True).alias("asks"), *every)
    long = rows.where(tiled)
    asking = (long.where("minor").withColumn("tiles", ask_tiles).select("mask", "part", "fp", "root", F.lit(True).alias("asks"), mine.alias("ask"),
              F.explode(F.sequence(F.lit(0), all_tiles - 1)).alias("tile")))
    asked = (long.withColumn("tiles", all_tiles).select("mask", "part", "fp", "root", F.lit(False).alias("asks"),
             F.explode(F.sequence(F.lit(0), ask_tiles - 1)).alias("ask"), mine.alias("tile")))
    units = cut_lineage(short.union(asking).union(asked).select(F.xxhash64("mask", "part", "ask", "tile").alias("unit"), "fp", "root", "asks"))
    cells = max(CELLS, units.count() // CELL)

    def run(table: pa.Table) -> pa.Table:
        got = compare_cell(*(table.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "fp", "root", "asks")), link)
        u, v = zip(*got) if got else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return units.withColumn("cell", F.pmod(F.col("unit"), F.lit(cells))).groupBy("cell").applyInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, link: int = LINK) -> DataFrame:
    """(key, fingerprint, component_id, copies): groups of documents linked by fingerprints ``link`` or fewer bits apart.

    component_id is the smallest key reachable (itself included), fingerprint 16 hex digits, copies the number of documents with the same
    fingerprint. Texts without a word have fingerprint zero and are linked like any other. Null keys are kept and name no group unless
    it has no other key (then component_id is null). Repeated rows are repeated. An empty table gives no rows.
    """
    return (_grouped(docs, text, key, words, link)
            .select(F.col("doc_id").alias(key), as_hex(F.col("fp")).alias("fingerprint"), "component_id", "copies"))


def _grouped(docs: DataFrame, text: str, key: str, words: int = WORDS, link: int = LINK) -> DataFrame:
    """(doc_id, fp, root, component_id, copies): rows of `near_groups`, the group also by its root, as groups may share a component_id."""
    prints = cut_lineage(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words=words))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    masks = block_masks(nodes.count(), link)
    known = components(hub_links(bucketed(nodes, masks), link))
    rooted = nodes.join(known.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    more = components(residual_links(bucketed(rooted, masks, "root"), link))
    final = (rooted.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
             .select("fp", F.coalesce("top", "root").alias("root")))
    named = nodes.join(final, "fp")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(groups, "root").select("fp", "root", "copies", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id", "copies")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without their near copies: of each group the row with the smallest key stays, whole and with all its columns.

    Rows with a null key can't be told apart and all stay. Rows that share a key are judged by their own texts: of those in one group that have the
    kept key the least text stays.
    """
    leads = (_grouped(docs, text, key).where(F.col("doc_id") == F.col("component_id"))
             .select(F.col("doc_id").alias("__lead"), F.col("fp").alias("__of"), F.col("root").alias("__root")).distinct())

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([h - (1 << 64) if (h := simhash(t)) >> 63 else h for t in texts], dtype="int64")
    first = Window.partitionBy(key, "__root").orderBy(F.col(text), F.xxhash64(*docs.columns))
    kept = (docs.where(F.col(key).isNotNull()).withColumn("__fp", F.pandas_udf(prints, "long")(whole_text(text)))
            .join(leads, (F.col(key).cast("long") == F.col("__lead")) & (F.col("__fp") == F.col("__of")))
            .withColumn("__nth", F.row_number().over(first)).where("__nth = 1").select(*docs.columns))
    return kept.union(docs.where(F.col(key).isNull()))
