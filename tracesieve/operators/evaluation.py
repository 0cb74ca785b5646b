"""Classifier evaluation: confusion, precision / recall / F1, votes, comparison and promotion."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.stats import Z_SHORT, f1, ratio, wilson


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n): everything below works on this small table."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Fixed-label matrix with zero rows kept."""
    dim = pairs.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    m = pairs.where(F.col("pred").isin(*labels)).groupBy("truth").pivot("pred", list(labels)).agg(F.sum("n"))
    return F.broadcast(dim).join(m, "truth", "left").na.fill(0)


def _class_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, support) of every label that is a truth or a prediction."""
    zero = F.lit(0).cast("bigint")
    same = F.col("truth") == F.col("pred")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.when(same, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"), F.col("n").alias("support")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), F.when(same, zero).otherwise(F.col("n")).alias("fp"), zero.alias("support")))).alias("s"))
    return sides.groupBy("s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.support").alias("support"))


def _scores() -> tuple[Column, Column, Column]:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("support"))
    return p, r, f1(p, r)


def per_class(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined."""
    g = _class_counts(pairs)
    if labels is not None:
        dim = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        g = F.broadcast(dim).join(g, "label", "left").na.fill(0)
    p, r, f = _scores()
    return g.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")


def summary(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro scores over the labels that occur as truth or prediction."""
    p, r, f = _scores()
    return _class_counts(pairs).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.sum("support").alias("rows"), F.avg(p).alias("macro_precision"),
        F.avg(r).alias("macro_recall"), F.avg(f).alias("macro_f1"), F.count("*").alias("labels"))


def majority(df: DataFrame, key: str, pred: str, pos: str) -> DataFrame:
    """Most frequent prediction per key; ties go to the first seen. Votes are counted map-side and
    the winner is a max over (count, -first position), so no key is ever gathered."""
    votes = df.groupBy(key, pred).agg(F.count("*").alias("__n"), F.min(pos).alias("__p"))
    return votes.groupBy(key).agg(F.max_by(pred, F.struct(F.col("__n"), (-F.col("__p")).alias("__q"), pred)).alias(pred))


def method_scores(labelled: DataFrame, preds: dict[str, DataFrame], key: str, truth: str) -> DataFrame:
    """Correct files per method and category; a file without prediction is wrong for every method."""
    j = labelled.select(key, truth)
    for name, p in preds.items():
        j = j.join(p.select(key, p.columns[-1]).toDF(key, f"__{name}"), key, "left")
    hit = {n: F.count_if(F.coalesce(F.col(f"__{n}") == F.col(truth), F.lit(False))).alias(n) for n in preds}
    return j.groupBy(truth).agg(F.count("*").alias("total"), *hit.values()) \
        .withColumns({f"{n}_pct": F.round(F.lit(100.0) * F.col(n) / F.col("total"), 1) for n in preds})


def promotion(old: DataFrame, new: DataFrame, old_cls: DataFrame, new_cls: DataFrame, labels: Sequence[str],
              watched: Sequence[str]) -> DataFrame:
    """Four promotion criteria of a candidate against the current model, and their conjunction.

    old/new: one row (accuracy, macro_f1, bench_correct); *_cls: (label, f1).
    """
    cls = new_cls.select("label", F.col("f1").alias("n")).join(old_cls.select("label", F.col("f1").alias("o")), "label", "full_outer")
    n, o = F.coalesce("n", F.lit(0.0)), F.coalesce("o", F.lit(0.0))
    c = cls.agg(F.coalesce(F.bool_and(F.when(F.col("label").isin(*watched), n >= o)), F.lit(True)).alias("watched_ok"),
                F.count_if(F.col("label").isin(*labels) & (n > 0)).alias("predicted"))
    # three one-row tables side by side: stacked, then one aggregate
    names = ("accuracy", "macro_f1", "bench_correct")
    stack = (old.select(*[F.col(x).alias(f"old_{x}") for x in names])
             .unionByName(new.select(*[F.col(x).alias(f"new_{x}") for x in names]), allowMissingColumns=True)
             .unionByName(c, allowMissingColumns=True))
    j = stack.agg(*[F.max(x).alias(x) for x in stack.columns])
    checks = {"all_labels": F.col("predicted") == len(labels),
              "scores_hold": (F.col("new_accuracy") >= F.col("old_accuracy")) & (F.col("new_macro_f1") >= F.col("old_macro_f1")),
              "bench_holds": F.col("new_bench_correct") >= F.col("old_bench_correct"), "watched_hold": F.col("watched_ok")}
    out = j.select(*[v.alias(k) for k, v in checks.items()])
    return out.withColumn("promote", F.col("all_labels") & F.col("scores_hold") & F.col("bench_holds") & F.col("watched_hold"))


def best_variant(df: DataFrame, name: str, score: Column, place: str) -> DataFrame:
    """Name with the highest score; the first in ``place`` wins ties."""
    return df.agg(F.max_by(name, F.struct(score.alias("s"), (-F.col(place)).alias("p"))).alias("winner"))


def corpus_evaluation(files: DataFrame, findings: DataFrame, key: str, bad: str, repaired: str | None = None) -> DataFrame:
    """Recall, false-positive rate and precision over flawed and clean files, with intervals."""
    hit = findings.select(key).distinct().withColumn("__hit", F.lit(True))
    j = files.join(hit, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    a = j.agg(F.count_if(F.col(bad)).alias("flawed"), F.count_if(F.col(bad) & F.col("__hit")).alias("tp"),
              F.count_if(~F.col(bad)).alias("clean"), F.count_if(~F.col(bad) & F.col("__hit")).alias("fp"),
              F.count_if(F.col(bad) & (F.col(repaired) if repaired else F.lit(False))).alias("repaired"))
    rl, rh = wilson(F.col("tp"), F.col("flawed"), Z_SHORT, (0.0, 1.0))
    fl, fh = wilson(F.col("fp"), F.col("clean"), Z_SHORT, (0.0, 1.0))
    return a.select("flawed", "tp", "clean", "fp", ratio(F.col("tp"), F.col("flawed")).alias("recall"), rl.alias("recall_low"), rh.alias("recall_high"),
                    ratio(F.col("fp"), F.col("clean")).alias("fpr"), fl.alias("fpr_low"), fh.alias("fpr_high"),
                    ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), ratio(F.col("repaired"), F.col("flawed")).alias("repair_rate"))


def codes_per_file(findings: DataFrame, key: str, code: str) -> DataFrame:
    """Sorted set of codes found per file."""
    return findings.where(F.col(code).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(code)), ";").alias("codes"))
