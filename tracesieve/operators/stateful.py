"""Rate limits, budgets, token buckets and duplicate suppression over event tables.

Acceptance depends on earlier acceptances, so the core is a sequential fold. It is only run where
it has to be: a key's history is cut at points where the state is known from the events alone, and
each piece between two cuts is folded on its own.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.ordered import carry_forward, fold_runs, running


def _limiter_step(n: int, width: int):
    """Fold of the sliding-log limiter: at most ``n`` accepted events in ``(t - width, t]``."""
    accepted: deque[int] = deque(maxlen=n)

    def step(at: int, known: bool) -> bool:
        ok = known or len(accepted) < n or accepted[0] <= at - width
        if ok:
            accepted.append(at)
        return ok

    return step


def limit_rate(df: DataFrame, keys: Sequence[str], at: str, ident: str, n: int, width: int,
               bucket: int | None = None) -> DataFrame:
    """Adds ``accepted`` for the limiter "fewer than n accepted events in the last ``width``".

    An event whose whole trailing window never held more than ``n`` events is accepted, whatever
    happened before. Only the remaining stretches ("hot") are folded, each started with the
    accepted events of the window before it. ``at`` is an integer time, ``ident`` a unique integer
    that orders ties.
    """
    keys = list(keys)
    bucket = max(bucket or width * 8, width * 4)  # short buckets: a busy key is split, at the price of the halo's rows
    halo = 3 * width
    own = F.floor(F.col("at") / F.lit(bucket)).cast("bigint")
    base = df.select(*keys, F.col(at).alias("at"), F.col(ident).alias("ident")).withColumn("__own", own)
    spread = base.withColumn("__b", F.explode(F.when(
        F.col("at") > (F.col("__own") + 1) * F.lit(bucket) - F.lit(halo), F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))))
    rng = Window.partitionBy(*keys, "__b").orderBy("at").rangeBetween(-(width - 1), 0)
    row = Window.partitionBy(*keys, "__b").orderBy("at", "ident")
    busy = spread.withColumn("__over", (F.count("*").over(rng) > n).cast("int"))
    hot = busy.withColumn("__hot", F.max("__over").over(rng) == 1)
    marked = hot.withColumn("__start", F.col("__hot") & ~F.coalesce(F.lag("__hot").over(row), F.lit(False))) \
        .where("__own = __b").select(*keys, "at", "ident", F.col("__hot").alias("hot"), F.col("__start").alias("start"))
    runs = running(marked, keys, F.floor(F.col("at") / F.lit(bucket)), ["at", "ident"],
                   {"run": ("sum", F.col("start").cast("bigint"))})
    starts = runs.where("start").select(*keys, (F.col("run") - 1).alias("run"), F.col("at").alias("__from"))
    # Everything in the window before a stretch was accepted: an over-full event there would have
    # made the last row before the stretch hot as well.
    context = runs.join(starts, [*keys, "run"]).where(F.col("at") > F.col("__from") - F.lit(width)) \
        .select(*keys, (F.col("run") + 1).alias("run"), "at", "ident", F.lit(True).alias("known"))
    todo = runs.where("hot").select(*keys, "run", "at", "ident", F.lit(False).alias("known")).unionByName(context)
    folded = fold_runs(todo, [*keys, "run"], ["at", "ident"], ["at", "known"], ["ident", "known"], "accepted",
                       lambda: _limiter_step(n, width)).where("NOT known").select("ident", "accepted")
    verdict = runs.where("NOT hot").select("ident", F.lit(True).alias("accepted")).unionByName(folded)
    return df.join(verdict.withColumnRenamed("ident", ident), ident)


def limit_budget(df: DataFrame, keys: Sequence[str], at: str, ident: str, size: Column, max_size: float,
                 n: int = 60, width: int = 3_600_000_000) -> DataFrame:
    """Rolling budget; a request over ``max_size`` is refused first and consumes nothing."""
    sized = df.withColumn("__big", size > max_size)
    ok = limit_rate(sized.where("NOT __big"), keys, at, ident, n, width)
    return ok.withColumn("outcome", F.when(F.col("accepted"), "accepted").otherwise("over_limit")).drop("__big", "accepted") \
        .unionByName(sized.where("__big").withColumn("outcome", F.lit("too_large")).drop("__big"))


def suppress_repeats(df: DataFrame, keys: Sequence[str], at: str, ident: str, width: int = 60_000_000) -> DataFrame:
    """Keeps an event unless one with the same key was kept less than ``width`` before."""
    return limit_rate(df, keys, at, ident, 1, width).withColumnRenamed("accepted", "kept")


def _bucket_step(capacity: float, per_us: float, reserved: float):
    tokens, last = capacity, None

    def step(at: int, urgent: bool) -> bool:
        nonlocal tokens, last
        if last is not None:
            tokens = min(capacity, tokens + (at - last) * per_us)
        last = at
        ok = tokens >= 1.0 and (urgent or tokens > reserved)
        if ok:
            tokens -= 1.0
        return ok

    return step


def token_bucket(df: DataFrame, keys: Sequence[str], at: str, ident: str, urgent: Column, per_minute: int,
                 chunk: int = 3_600_000_000) -> DataFrame:
    """Token bucket with a reserve for urgent events.

    A pause as long as a full refill (one minute) resets the bucket, so a key is cut at every such
    pause and the pieces are folded apart.
    """
    keys = list(keys)
    capacity, per_us = float(per_minute), per_minute / 60e6
    reserved = min(2.0, per_minute * 0.25)
    base = df.select(*keys, F.col(at).alias("at"), F.col(ident).alias("ident"), urgent.alias("urgent"))
    step = F.floor(F.col("at") / F.lit(chunk))
    prev = carry_forward(base, keys, step, ["at", "ident"], {"__prev": F.col("at")})
    cut = F.coalesce(F.col("at") - F.col("__prev") >= F.lit(60_000_000), F.lit(True))
    pieces = running(prev, keys, step, ["at", "ident"], {"run": ("sum", cut.cast("bigint"))}).drop("__prev")
    got = fold_runs(pieces, [*keys, "run"], ["at", "ident"], ["at", "urgent"], ["ident"], "accepted",
                    lambda: _bucket_step(capacity, per_us, reserved))
    return df.join(got.withColumnRenamed("ident", ident), ident)
