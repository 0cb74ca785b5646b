"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (lines). Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two. So it doesn't depend on their order, equal multisets have equal fingerprints, and paragraphs can be added or taken
away without the rest of the text (`combine`, `remove`).

The vector of a paragraph has two parts:

* ``EXACT`` lanes of 32 bits, hashed from the whole paragraph. They decide equality (256 bits in all).
* the number of its units (up to ``UNIT_WORDS`` words, ending at a sentence's end at the latest) and for each bit of a 60-bit unit hash how many units
  have it set, three counters to a 60-bit word. Twice a counter less the number of units is a sum of random signs, one for each unit, so the
  cosine of two such vectors estimates that of the two multisets of units, whatever their sizes: the likeness of two fingerprints.

Everything is DataFrame expressions.
"""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.session import cut_lineage

EXACT, EXACT_BITS = 8, 32
PACKED, FIELD, FIELDS = 20, 20, 3
UNIT_WORDS = 4
UNIT = "(?:\\S*[^\\s.!?][ \\t]+){0,%d}+\\S+" % (UNIT_WORDS - 1)
_LOW = (1 << EXACT_BITS) - 1
_EVERY = sum(1 << FIELD * k for k in range(FIELDS))
_WORD = (1 << FIELD * FIELDS) - 1
_ONE = (1 << FIELD) - 1
#: Neighbours in the order of ids are found within chunks of so many ids; each chunk also gets the first row of the next.
CHUNK_BITS, SUPER_BITS = 8, 12
#: First rows of chunks up to which their ids are broadcast (16 bytes each).
BROADCAST_HEADS = 500_000


def _sum_fold(items: Column, width: int, lane, modulo: int) -> Column:
    """Array of ``width`` sums over ``items`` of ``lane(item, k)``, each modulo ``modulo`` + 1 (a power of two)."""
    start = F.struct(*(F.lit(0).cast("long").alias(f"x{k}") for k in range(width)))
    return F.aggregate(items, start, lambda s, x: F.struct(*((s[f"x{k}"] + lane(x, k)).bitwiseAND(F.lit(modulo)).alias(f"x{k}") for k in range(width))),
                       lambda s: F.array(*(s[f"x{k}"] for k in range(width))))


def fingerprint(paragraphs: Column, unit_hashes: Column) -> Column:
    """Array of EXACT sums, the number of units, and PACKED words of counters. Both inputs must be columns."""
    exact = _sum_fold(paragraphs, EXACT, lambda p, k: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(_LOW)), _LOW)
    packed = _sum_fold(unit_hashes, PACKED, lambda h, k: F.shiftright(h, k).bitwiseAND(F.lit(_EVERY)), _WORD)
    return F.concat(exact, F.array(F.size(unit_hashes).cast("long")), packed)


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of the whole text. Null and empty texts have no paragraph and the zero fingerprint."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({
        f"__p_{name}": F.when(t != "", F.split(t, "\n", -1)).otherwise(F.array().cast("array<string>")),
        f"__h_{name}": F.transform(F.regexp_extract_all(t, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u).bitwiseAND(F.lit(_WORD)))})
    return step.withColumn(name, fingerprint(F.col(f"__p_{name}"), F.col(f"__h_{name}"))).drop(f"__p_{name}", f"__h_{name}")


def _modulo(x: Column, k: Column) -> Column:
    return F.when(k < EXACT, x.bitwiseAND(F.lit(_LOW))).otherwise(x.bitwiseAND(F.lit(_WORD)))


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), _modulo)


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), _modulo)


def fingerprint_of(docs: DataFrame, group: str, fingerprint_column: str) -> DataFrame:
    """(group, fingerprint): the fingerprint of all paragraphs of a group's documents, summed lane by lane before and after the shuffle."""
    lane = F.posexplode(fingerprint_column)
    sums = docs.select(group, lane.alias("k", "x")).groupBy(group, "k").agg(F.sum("x").alias("x"))
    return (sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("l"))  # EXACT + 1 + PACKED lanes a group
            .select(group, F.transform(F.transform("l", lambda s: s["x"]), _modulo).alias("fingerprint")))


def signs(fp: Column) -> Column:
    """The counters as sums of signs: twice a counter less the number of units."""
    n = F.get(fp, F.lit(EXACT))
    counters = F.flatten(F.transform(F.slice(fp, EXACT + 2, PACKED), lambda x: F.array(
        *(F.shiftright(x, FIELD * k).bitwiseAND(F.lit(_ONE)) for k in range(FIELDS)))))
    return F.transform(counters, lambda c: (2 * c - n).cast("double"))


def likeness(a: Column, b: Column, signs_a: Column, signs_b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 where only one has units. The cosine's standard error is about 0.13 for unlike texts."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(signs_a, signs_a) * dot(signs_b, signs_b))
    return F.when(a == b, F.lit(1.0)).when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(signs_a, signs_b) / size))).otherwise(F.lit(0.0))


def as_hex(fp: Column) -> Column:
    """Fixed-width hexadecimal of all lanes."""
    return F.lower(F.array_join(F.transform(fp, lambda x, k: F.lpad(F.hex(x), F.when(k < EXACT, EXACT_BITS // 4).otherwise(FIELD * FIELDS // 4), F.lit("0"))), ""))


def _chunk(key: Column) -> Column:
    return F.shiftright(key, CHUNK_BITS)


def heads(ids: DataFrame) -> DataFrame:
    """(doc_id, chunk): the largest id of every chunk of ids and the chunk that comes before it in descending order of ids.

    The last chunk's successor is the first, so the chain is closed. Chunks are numbered ranges of ids; their order is found within ranges of
    chunks, and only one row per such range meets in one task.
    """
    first = ids.where("doc_id IS NOT NULL").groupBy(_chunk(F.col("doc_id")).alias("chunk")).agg(F.max("doc_id").alias("doc_id"))
    first = cut_lineage(first.withColumn("range", F.shiftright("chunk", SUPER_BITS)))
    inside = first.withColumn("before", F.lag("chunk").over(Window.partitionBy("range").orderBy(F.desc("chunk"))))
    ranges = first.groupBy("range").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    around = ranges.withColumn("above", F.coalesce(F.lag("low").over(Window.orderBy(F.desc("range"))),
                                                   F.last("low").over(Window.orderBy(F.desc("range")).rowsBetween(
                                                       Window.unboundedPreceding, Window.unboundedFollowing))))
    return inside.join(around.select("range", "above"), "range").select("doc_id", F.coalesce("before", "above").alias("chunk"))


def compare_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last third (rounded down, in code points) replaced by as many first code points, or all, of the next
    document in descending order of keys; after the last comes the first, and a document alone is its own next. Rows with equal keys follow each other by
    their texts. Rows with a null key have no place in the order: their next document is empty. Null texts count as empty.

    Texts are shuffled once, by chunk of keys; where a chunk ends, the first row of the next chunk is sent along.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = rows.where("doc_id IS NOT NULL")
    head = cut_lineage(heads(rows.select("doc_id")))
    if head.count() <= BROADCAST_HEADS:
        head = F.broadcast(head)
    extra = named.join(head, "doc_id").select("chunk", "doc_id", "t", F.lit(False).alias("own"))
    dealt = named.select(_chunk(F.col("doc_id")).alias("chunk"), "doc_id", "t", F.lit(True).alias("own")).union(extra)
    order = Window.partitionBy("chunk").orderBy(F.desc("own"), F.desc("doc_id"), F.desc("t"))
    dealt = with_fingerprint(dealt.withColumn("next", F.lead("t").over(order)), "t", "fp")
    dealt = dealt.withColumn("next_fp", F.lead("fp").over(order)).where("own").select("doc_id", "t", "next", "fp", "next_fp")
    nothing = F.array_repeat(F.lit(0).cast("long"), EXACT + 1 + PACKED)
    unnamed = with_fingerprint(rows.where("doc_id IS NULL").withColumn("next", F.lit("")), "t", "fp").withColumn("next_fp", nothing)
    both = dealt.union(unnamed.select(*dealt.columns))
    n = F.char_length("t")
    cut = F.floor(n / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)))
    both = with_fingerprint(both, "edited", "edited_fp").withColumns(
        {f"s_{c}": signs(F.col(c)) for c in ("fp", "edited_fp", "next_fp")})
    return both.select(F.col("doc_id").alias(key), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp"), F.col("s_fp"), F.col("s_edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp"), F.col("s_fp"), F.col("s_next_fp")).alias("near_next"))
