"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects documents on which a share (of symbols, capitals, exclamation marks, repeated words, repeated lines) is above a cutoff.
A cutoff may be used in a stratum (a language) only if the labelled good documents there show that it rejects at most ``ALPHA`` / number of
rules of such documents: the exact binomial probability of seeing so few rejections, were the rate higher, must not be above the level.
Per rule and stratum the cutoffs are tried from the mildest on and testing stops at the first that fails (fixed-sequence testing,
which needs no further correction), and the level is ``DELTA`` divided by the number of rules and strata (Bonferroni). So with
probability 1 - ``DELTA`` every stratum loses at most ``ALPHA`` of its good documents to all rules together. Where labels are too few, nothing
can be certified and the rule stays silent.

Everything here is DataFrame expressions; texts are read once.
"""
from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.session import cut_lineage

WORD = "[^ \\t\\n\\x0B\\f\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of good documents that all rules together may reject in a stratum; probability that any stratum breaks this.
ALPHA, DELTA = 0.05, 0.05
#: Rule: counted, and out of what.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "shouts": ("n_shouts", "word_chars"),
         "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
#: Cutoffs from mild to strict.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: Strata up to which the cutoffs are broadcast (a row of numbers each); beyond, Spark chooses the join.
BROADCAST_STRATA = 10_000


def _others(c: Column, chars: str) -> Column:
    """Number of characters of ``c`` that are not among ``chars``."""
    return F.char_length(F.translate(c, chars, ""))


def _sorted_windows(windows: Column) -> Column:
    """(hash, position) of the windows in order of their hashes; empty where no window is repeated, the usual case."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeat_words(pairs: Column) -> Column:
    """Words that lie in a window whose hash a neighbour in the sorted order shares. No text costs its square.

    ``pairs`` must be a column, not an expression: a lambda evaluates what it names for every element.
    """
    at = F.sort_array(F.filter(F.transform(pairs, lambda p, j: F.when(
        (p["h"] == F.get(pairs, j - 1)["h"]) | (p["h"] == F.get(pairs, j + 1)["h"]), p["i"])), lambda i: i.isNotNull()))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda s, i: F.struct(
        (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts")


def with_measures(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` with a struct ``__m`` of the measures of the whole text and the stratum; null and empty texts have zero counts."""
    t, words = F.coalesce(F.col(text), F.lit("")), F.col("__words")
    n, chars = F.size(words), F.char_length(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    step = (docs.withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
            .withColumns({"__windows": windows, "__lines": lines}).withColumn("__pairs", _sorted_windows(F.col("__windows"))))
    values = (n, _others(t, SPACES), chars - _others(t, SYMBOLS), F.size("__lines"), F.size("__lines") - F.size(F.array_distinct("__lines")),
              _repeat_words(F.col("__pairs")), chars - _others(t, CAPITALS), chars - _others(t, "!"))
    return step.withColumn("__m", F.struct(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                                           *(v.cast("long").alias(m) for m, v in zip(MEASURES, values)))).drop("__words", "__windows", "__lines", "__pairs")


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, measures...) of every row."""
    return with_measures(docs.select(F.col(key).cast("long").alias("doc_id"), text, stratum), text, stratum).select("doc_id", "__m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def share(rule: str) -> Column:
    counted, of = RULES[rule]
    return F.when(F.col(of) > 0, F.col(counted) / F.col(of)).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for n draws at ``rate``, summed exactly in logarithms. 1 where k is above the mean: far from significant."""
    odds = math.log(rate / (1 - rate))
    start = n * math.log1p(-rate)
    terms = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))

    def plus(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["total"] - top) + F.exp(term - top))).alias("total"))
    total = F.aggregate(terms, F.struct(start.alias("term"), start.alias("total")), plus, lambda s: s["total"])
    return F.when(k > n * rate, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(F.exp(total))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule): the strictest certified cutoff, null where none is. ``labels`` has (doc_id, quality).

    ``measured`` should be stored: a filter on it would otherwise be pushed below the measures and repeat them in place of their columns.

    A document with several labels is good if all say so. Only counts per stratum, rule and cutoff leave the tasks.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id").select("stratum", F.explode(F.array(*(F.struct(
        F.lit(r).alias("rule"), reduce(add, ((share(r) > g).cast("int") for g in GRID)).alias("passed")) for r in RULES))).alias("x"))
    by_level = held.groupBy("stratum", "x.rule", "x.passed").agg(F.count("*").alias("docs"))
    over = [F.sum(F.when(F.col("passed") >= len(GRID) - i, F.col("docs")).otherwise(0)).alias(f"k{i}") for i in range(len(GRID))]
    counts = by_level.groupBy("stratum", "rule").agg(F.sum("docs").alias("n"), *over)
    # a share is above a cutoff if it is above all milder ones: it passed at least that many of the strict end
    counts = cut_lineage(counts)
    level = delta / len(RULES) / max(1, counts.select("stratum").distinct().count())
    fine = [binomial_tail(F.col(f"k{i}"), F.col("n"), alpha / len(RULES)) <= level for i in range(len(GRID))]
    upto = F.array(*fine)
    number = F.when(F.array_position(upto, False) > 0, F.array_position(upto, False) - 1).otherwise(len(GRID)).cast("int")
    cut = counts.select("stratum", "rule", F.get(F.array(*map(F.lit, GRID)), number - 1).alias("cutoff"))
    return cut.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per document row.

    Null and empty texts have zero counts and fail. A null stratum is one of its own. Without labels only the base rules act. Repeated rows
    get the same verdict; keys may be null. Measures (a few numbers per document) are stored once in the shared checkpoint folder, as
    both the calibration and the verdict read them.
    """
    measured = cut_lineage(measure(docs, text, key, stratum))
    cutoffs = certified_cutoffs(measured, labels.select("doc_id", "quality"), alpha, delta)
    return _verdict(measured, cutoffs, "stratum").select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang",
              alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and with all columns; the same verdicts as `judge`.

    A row is judged where its text is, so texts are never shuffled and null or repeated keys need no care.
    """
    cutoffs = certified_cutoffs(cut_lineage(measure(docs, text, key, stratum)), labels.select("doc_id", "quality"), alpha, delta)
    measured = with_measures(docs, text, stratum).select(*(F.col(c).alias(f"__doc_{c}") for c in docs.columns), "__m.*")
    return _verdict(measured, cutoffs, "stratum").where("kept").select(*(F.col(f"__doc_{c}").alias(c) for c in docs.columns))


def _verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with ``kept``. Cutoffs are a row of numbers per stratum and broadcast only after a check of their number."""
    cutoffs = cut_lineage(cutoffs)
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    fired = reduce(or_, (F.coalesce(share(r) > F.col(r), F.lit(False)) for r in RULES))
    # one expression over both sides of the join: a conjunction's first half would be pushed below the measures and repeat them
    return measured.join(cutoffs, stratum, "left").withColumn("kept", F.when(base_failed(), F.lit(False)).otherwise(~fired))
