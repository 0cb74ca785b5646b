"""Order-dependent building blocks that stay parallel when one key owns most rows.

A plain ``partitionBy(key)`` window sorts a whole key in one task. These helpers split a key by
ranges of its order column ("chunks"), work inside each (key, chunk), and pass only one summary
row per chunk across the key. The results equal the plain window exactly.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.session import share

CHUNK = "__chunk"
#: Column of `by_ranges`.
RANGE = "__range"


def by_ranges(df: DataFrame, by: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """Adds ``RANGE``, the number of the range of ``by`` that a row lies in; numbers ascend with ``by``.

    The edges are quantiles that Spark samples from the rows, so ranges hold about equally many rows whatever their values: an outlier or
    a burst moves edges, and a hot key is spread over several ranges. Without ``ranges`` their number follows the size of the
    data. Numbers are those of one computation: share the frame, or hand it to a helper that does, before reading it twice.
    """
    cols = [ranges, *by] if ranges else by
    return df.repartitionByRange(*cols).withColumn(RANGE, F.spark_partition_id())


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Adds ``out``, the place (from 1, bigint) of each row among those of its key; ``order`` must leave no ties. Null keys are a key.

    Rows are sorted into ranges of (keys, order). A row's number within its task, one count per task and one least position per key give
    its place, so no task holds more of a key than its range.
    """
    task, row = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = share(df.orderBy(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("__n")) \
        .select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row per task
    placed = rows.join(F.broadcast(starts), task == F.col("__task")).withColumn(out, F.col("__start") + row + 1).drop("__task", "__start", "__at")
    if not keys:
        return placed
    first = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(out).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return placed.join(first, same).withColumn(out, F.col(out) - F.col("__first") + 1).drop("__first", *[f"__{k}" for k in keys])


def numbered(df: DataFrame, key: str, at: str, aggs: Sequence[Column], out: str, width: int = 1 << 20) -> DataFrame:
    """One row per (key, at) with ``aggs``, and ``out``, its place (from 1, bigint) in the key by ``at``; both are integers, nulls come last.

    Rows are dealt by key and stretch of ``at`` once; grouping and places need no other exchange. A stretch holds at most ``width`` different
    ``at``, so no task sorts more of a key than that, however hot it is. Only one count per stretch crosses the key.
    """
    dealt = ["__k", "__null", "__s"]
    last = (1 << 63) - 1
    rows = df.withColumns({"__k": F.coalesce(F.col(key).cast("bigint"), F.lit(0)), "__null": F.col(key).isNull(),
                           "__s": F.coalesce(F.floor(F.col(at) / F.lit(width)), F.lit(last))}).repartition(*dealt)
    local = rows.groupBy(*dealt, at).agg(*aggs).withColumn(out, F.row_number().over(Window.partitionBy(*dealt).orderBy(at)).cast("bigint"))
    before = Window.partitionBy("__k", "__null").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = local.groupBy(*dealt).agg(F.count("*").alias("__n")) \
        .select(*dealt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return local.join(starts, dealt).withColumns({out: F.col("__start") + F.col(out), key: F.when(~F.col("__null"), F.col("__k"))}) \
        .drop(*dealt, "__start")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given total order.

    ``row_number() = 1`` is planned as a window group limit on both sides of the shuffle, so a
    group of copies leaves every map task as a single row.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str | None = None, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each key: exact top-n per (key, salt), then top-n per key.

    A row in the final top-n is in the top-n of its salt, so nothing is lost; the last stage of
    a hot key receives at most ``salts * n`` rows.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    part = salted.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    out = rank or "__rn"
    res = part.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= n)
    return res if rank else res.drop(out)


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str],
            specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sum / min / max per key, inclusive of the current row.

    ``chunk`` must be monotone in ``order``; keys must be non-null. ``specs`` maps an output
    column to ``("sum" | "min" | "max", value)``.
    """
    base = share(df.withColumn(CHUNK, chunk))
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({o: _AGG[a](v).over(w) for o, (a, v) in specs.items()})
    totals = base.groupBy(*keys, CHUNK).agg(*[_AGG[a](v).alias(f"__{o}") for o, (a, v) in specs.items()])
    wt = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, CHUNK,
                           *[_AGG[a](f"__{o}").over(wt).alias(f"__{o}") for o, (a, _) in specs.items()])
    joined = local.join(before, [*keys, CHUNK], "left")
    return joined.withColumns({o: _COMBINE[a](F.col(o), F.col(f"__{o}")) for o, (a, _) in specs.items()}) \
        .drop(CHUNK, *[f"__{o}" for o in specs])


def running_floored(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], delta: Column,
                    lowest: Column, out: str) -> DataFrame:
    """Running sum that never falls below zero, in one pass.

    Each row moves the level by ``delta`` after dipping by ``lowest`` (<= 0) on the way. Within a
    chunk the level is ``max(start + sum, floored)``, and chunks compose the same way, so two
    numbers per chunk are enough. Adds ``out`` (before the row) and ``out_after``.
    """
    base = share(df.withColumns({CHUNK: chunk, "__d": delta.cast("bigint"), "__m": lowest.cast("bigint")}))

    def levels(rows: DataFrame, w: Window) -> DataFrame:
        s = rows.withColumn("__s", F.sum("__d").over(w))
        s = s.withColumn("__lo", F.min(F.col("__s") - F.col("__d") + F.col("__m")).over(w))
        return s.withColumn("__f", F.col("__s") - F.least(F.lit(0), F.col("__lo")))

    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = levels(base, w)
    tails = local.groupBy(*keys, CHUNK).agg(F.sum("__d").alias("__d"), F.min("__lo").alias("__m"))
    wt = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    prev = Window.partitionBy(*keys).orderBy(CHUNK)
    start = levels(tails, wt).select(*keys, CHUNK, F.coalesce(F.lag("__f").over(prev), F.lit(0)).alias("__in"))
    j = local.join(start, [*keys, CHUNK], "left")
    # from a start level L the floor bites only where the local walk dips below -L
    after = F.greatest(F.col("__in") + F.col("__s"), F.col("__s") - F.least(F.lit(0), F.col("__lo")))
    rows = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return j.withColumn(f"{out}_after", after).withColumn(out, F.coalesce(F.lag(f"{out}_after").over(rows), F.col("__in"))) \
        .drop(CHUNK, "__d", "__m", "__s", "__lo", "__f", "__in")


def carry_forward(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str],
                  specs: dict[str, Column], include_current: bool = False) -> DataFrame:
    """Last non-null value before (or up to) each row: the as-of primitive."""
    base = share(df.withColumn(CHUNK, chunk))
    end = 0 if include_current else -1
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumns({o: F.last(v, ignorenulls=True).over(w) for o, v in specs.items()})
    pos = F.struct(*order)
    tails = base.groupBy(*keys, CHUNK).agg(
        *[F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"__{o}") for o, v in specs.items()])
    wt = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = tails.select(*keys, CHUNK, *[F.last(f"__{o}", ignorenulls=True).over(wt).alias(f"__{o}") for o in specs])
    joined = local.join(before, [*keys, CHUNK], "left")
    return joined.withColumns({o: F.coalesce(F.col(o), F.col(f"__{o}")) for o in specs}) \
        .drop(CHUNK, *[f"__{o}" for o in specs])


def trailing(df: DataFrame, keys: Sequence[str], at: str, width: int,
             specs: dict[str, Callable[[], Column]], bucket: int | None = None) -> DataFrame:
    """Aggregates over the half-open range ``(at - width, at]`` per key, ``at`` an integer column.

    Rows are placed in fixed buckets of the order column; a row within ``width`` of the next
    bucket is also sent there as context, so each (key, bucket) is computed on its own.
    """
    bucket = bucket or width * 4  # a busy key is split as finely as a quarter of context rows allows
    own = F.floor(F.col(at) / F.lit(bucket)).cast("bigint")
    nearly = F.col(at) > (own + 1) * F.lit(bucket) - F.lit(width)
    spread = df.withColumn("__own", own).withColumn(
        "__b", F.explode(F.when(nearly, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))))
    w = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(-(width - 1), 0)
    out = spread.withColumns({o: make().over(w) for o, make in specs.items()})
    return out.where("__own = __b").drop("__own", "__b")


def fold_runs(df: DataFrame, run_keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], keep: Sequence[str],
              result: str, make_step: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Sequential fold over each run of rows; ``step(*inputs)`` gives the flag ``result``.

    Rows are hash-partitioned by run and sorted, then stream through in Arrow batches. Only the
    fold's own state is held, never a whole run, and it restarts where the run key changes.
    """
    keys = list(run_keys)
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep) + f", {result} boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            rows = list(zip(*[pdf[k].tolist() for k in keys]))
            flags = []
            for key, args in zip(rows, zip(*[pdf[c].tolist() for c in inputs])):
                if key != last:
                    last, step = key, make_step()
                flags.append(step(*args))
            yield pdf[list(keep)].assign(**{result: flags})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def exact_percentiles(dist: DataFrame, keys: Sequence[str], value: str, n: str, ps: dict[str, float],
                      ranges: int | None = None) -> DataFrame:
    """Linear-interpolated percentiles from a (keys, value, n) histogram.

    The histogram is cut into ranges of (keys, value) with about equally many values each; the cumulative count runs per range and is
    offset across ranges. So no task holds the values of a whole key, and one outlier does not crowd the others.
    """
    bounds = dist.groupBy(*keys).agg(F.sum(n).alias("__n"))
    j = by_ranges(dist.join(bounds, list(keys)), [*keys, value], ranges)
    cum = running(j, keys, F.col(RANGE), [value], {"__cum": ("sum", F.col(n))})
    aggs = []
    for name, p in ps.items():
        k = (F.col("__n") - 1) * F.lit(p)
        aggs += [F.min(F.when(F.col("__cum") > F.floor(k), F.col(value))).alias(f"__{name}_lo"),
                 F.min(F.when(F.col("__cum") > F.ceil(k), F.col(value))).alias(f"__{name}_hi")]
    got = cum.groupBy(*keys, "__n").agg(*aggs)
    outs = []
    for name, p in ps.items():
        k = (F.col("__n") - 1) * F.lit(p)
        frac = k - F.floor(k)
        outs.append((F.col(f"__{name}_lo") * (F.lit(1.0) - frac) + F.col(f"__{name}_hi") * frac).alias(name))
    return got.select(*keys, *outs)
