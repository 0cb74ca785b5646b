"""Event-log analytics: summaries, tails, trailing counts and energy accounting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import RANGE, by_ranges, carry_forward, running, top_n_per_key, trailing

# One permissive schema for every record shape found in a log file.
LOG_SCHEMA = ("timestamp string, kind string, purpose string, action string, risk_score int, file_name string, payload_sha256 string, "
              "findings array<struct<agents:array<string>,category:string,severity:string,line:int,evidence:string>>, "
              "timings map<string,double>, event string, details map<string,string>, agents array<string>, categories array<string>, "
              "_corrupt string")


def parse_log_lines(df: DataFrame, line: str) -> DataFrame:
    """JSON lines to records; blank, corrupt and non-object lines are dropped."""
    rec = F.from_json(F.col(line), LOG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.where(F.col(line).rlike(r"^\s*\{")).withColumn("__r", rec).where("__r IS NOT NULL AND __r._corrupt IS NULL") \
        .select(*[c for c in df.columns if c != line], "__r.*").drop("_corrupt")


def log_summary(records: DataFrame, top: int = 5) -> DataFrame:
    """(dimension, name, n, place): total, by action, by agent, by category with its top places.

    Agents and categories are read from both record shapes: flat lists and nested findings.
    """
    agents = F.concat(F.coalesce("agents", F.array().cast("array<string>")),
                      F.coalesce(F.flatten(F.transform("findings", lambda f: F.coalesce(f["agents"], F.array().cast("array<string>")))), F.array().cast("array<string>")))
    cats = F.concat(F.coalesce("categories", F.array().cast("array<string>")),
                    F.coalesce(F.transform("findings", lambda f: f["category"]), F.array().cast("array<string>")))
    facts = F.concat(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("name")),
                             F.struct(F.lit("action").alias("dimension"), F.coalesce("action", F.lit("unknown")).alias("name"))),
                     F.transform(agents, lambda a: F.struct(F.lit("agent").alias("dimension"), a.alias("name"))),
                     F.transform(cats, lambda c: F.struct(F.lit("category").alias("dimension"), c.alias("name"))))
    counts = records.select(F.explode(facts).alias("f")).groupBy("f.dimension", "f.name").agg(F.count("*").alias("n"))
    ranked = top_n_per_key(counts.where("dimension = 'category'"), ["dimension"], [F.desc("n"), F.col("name")], top, rank="place")
    return counts.join(ranked.select("dimension", "name", "place"), ["dimension", "name"], "left")


def tail(df: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """Last n rows in their original order (top-n per task, then merged)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def last_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return top_n_per_key(df, keys, [F.desc(c) for c in order], n)


def trailing_counts(df: DataFrame, keys: list[str], at: str, width: int, out: str = "recent") -> DataFrame:
    """All events of the key in ``(at - width, at]``: a rate report, not the limiter."""
    return trailing(df, keys, at, width, {out: lambda: F.count("*")})


# fixed values: power model and grid intensity
IDLE_WATTS = 3.0
LOAD_WATTS = 12.0
GRAMS_PER_KWH = 475.0


def energy(samples: DataFrame, at: str, ident: str, load_pct: Column, ranges: int | None = None) -> DataFrame:
    """Power, step energy and running session energy per sample, in time order.

    ``at`` in microseconds. The gap to the sample before is clamped to [0.1, 5] seconds; the first
    sample counts one second. The time line is cut where samples are, not by the clock: running sums are computed per range of
    about equally many samples and offset across ranges, so a burst is split like any other stretch. Steps are added as decimals:
    a running sum of doubles drifts by more than the digits reported after some million samples, and differs with the cuts.
    """
    line = by_ranges(samples, [at, ident], ranges)
    prev = carry_forward(line, [], F.col(RANGE), [at, ident], {"__prev": F.col(at)})
    gap = (F.col(at) - F.col("__prev")) / F.lit(1e6)
    dt = F.when(gap.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(5.0), gap)))
    watts = F.lit(IDLE_WATTS) + F.lit(LOAD_WATTS) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), load_pct / 100.0))
    s = prev.withColumns({"power_mw": watts * 1000.0, "step_wh": watts * dt / 3600.0}).drop("__prev")
    out = running(s, [], F.col(RANGE), [at, ident], {"__wh": ("sum", F.col("step_wh").cast("decimal(30,20)"))})
    return out.withColumn("__wh", F.col("__wh").cast("double")).withColumns({"energy_mwh": F.col("__wh") * 1000.0, "co2_mg": F.col("__wh") * GRAMS_PER_KWH}).drop("__wh", RANGE)


def running_action(samples: DataFrame, actions: DataFrame, at: str, ident: str, ranges: int | None = None) -> DataFrame:
    """Adds the action running at each sample, else 'idle'.

    actions: (label, start, end). The latest start not after the sample decides, so the interval
    join is an as-of carry over the merged time line instead of a range join.
    """
    marks = actions.select(F.col("start").alias(at), F.lit(-1).cast("bigint").alias(ident),
                           F.struct("start", "label", "end").alias("__a")).groupBy(at, ident).agg(F.max("__a").alias("__a"))
    line = samples.withColumn("__a", F.lit(None).cast(marks.schema["__a"].dataType)).unionByName(marks, allowMissingColumns=True)
    j = carry_forward(by_ranges(line, [at, ident], ranges), [], F.col(RANGE), [at, ident], {"__last": F.col("__a")}).drop(RANGE)
    live = F.col("__last.end") > F.col(at)
    return j.where(F.col("__a").isNull()).withColumns({
        "action": F.when(live, F.col("__last.label")).otherwise("idle"),
        "action_start": F.when(live, F.col("__last.start"))}).drop("__a", "__last")


def action_energy(metered: DataFrame, actions: DataFrame, at: str, ident: str) -> DataFrame:
    """Seconds, energy and CO2 per action: the steps inside it, or an estimate for fast ones from the power of its last sample."""
    per = metered.where("action <> 'idle'").groupBy(F.col("action").alias("label"), F.col("action_start").alias("start")).agg(
        (F.sum("step_wh") * 1000.0).alias("__mwh"), F.max_by("power_mw", F.struct(at, ident)).alias("__mw"))
    j = actions.join(per, ["label", "start"], "left")
    seconds = F.greatest(F.lit(0.01), (F.col("end") - F.col("start")) / F.lit(1e6))
    mwh = F.coalesce("__mwh", F.lit(0.0))
    mwh = F.when((mwh <= 0.001) & F.col("__mw").isNotNull(), F.col("__mw") * seconds / F.lit(3600.0)).otherwise(mwh)
    return j.select("label", "start", seconds.alias("seconds"), mwh.alias("energy_mwh"),
                    F.greatest(F.lit(0.001), mwh / 1000.0 * GRAMS_PER_KWH).alias("co2_mg"))


def window_counts(events: DataFrame, ts: str, by: str, size: str) -> DataFrame:
    """Events per time window and value; the same call serves batch and stream."""
    return events.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")) \
        .select(F.unix_seconds("w.start").alias("window_start"), by, "n")
