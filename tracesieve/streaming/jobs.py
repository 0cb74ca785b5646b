"""Structured Streaming forms of the stateful operators."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracesieve.operators.dataset import entry_problems
from tracesieve.operators.eventlog import window_counts
from tracesieve.functions.text import dataset_form


def use_state_store(spark) -> None:
    """The state API needs the RocksDB store, which keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SlidingLimiter(StatefulProcessor):
    """Accepts an event while fewer than n were accepted in (t - width, t]; keeps n times per key."""

    def __init__(self, key: str, n: int, width: int) -> None:
        self.key, self.n, self.width = key, n, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.times.get()[0]) if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        flags = []
        for at in batch["us"]:
            ok = len(kept) < self.n or kept[-self.n] <= at - self.width
            if ok:
                kept = [*kept[-(self.n - 1):], int(at)] if self.n > 1 else [int(at)]
            flags.append(ok)
        self.times.update((kept,))
        yield pd.DataFrame({self.key: key[0], "event_id": batch["event_id"].to_numpy(), "accepted": flags})

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """Token bucket with a reserve for urgent events; state is (tokens, last time) per key."""

    def __init__(self, key: str, per_minute: int) -> None:
        self.key, self.capacity = key, float(per_minute)
        self.per_us, self.reserved = per_minute / 60e6, min(2.0, per_minute * 0.25)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.state.get() if self.state.exists() else (self.capacity, None)
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        flags = []
        for at, urgent in zip(batch["us"], batch["urgent"]):
            if last is not None:
                tokens = min(self.capacity, tokens + (int(at) - last) * self.per_us)
            last = int(at)
            ok = tokens >= 1.0 and (bool(urgent) or tokens > self.reserved)
            tokens -= 1.0 if ok else 0.0
            flags.append(ok)
        self.state.update((tokens, last))
        yield pd.DataFrame({self.key: key[0], "event_id": batch["event_id"].to_numpy(), "accepted": flags})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, n: int, width: int) -> DataFrame:
    """events: (key, event_id, us). Duplicate suppression is the same with n = 1."""
    kt = dict(events.dtypes)[key]
    return events.select(key, "event_id", "us").groupBy(key).transformWithStateInPandas(
        SlidingLimiter(key, n, width), f"{key} {kt}, event_id bigint, accepted boolean", "Append", "None")


def bucket_stream(events: DataFrame, key: str, per_minute: int) -> DataFrame:
    """events: (key, event_id, us, urgent)."""
    kt = dict(events.dtypes)[key]
    return events.select(key, "event_id", "us", "urgent").groupBy(key).transformWithStateInPandas(
        TokenBucket(key, per_minute), f"{key} {kt}, event_id bigint, accepted boolean", "Append", "None")


def suppress_within_watermark(events: DataFrame, ts: str, keys: list[str], delay: str = "60 seconds") -> DataFrame:
    """Built-in near form of the 60 s suppression; it may suppress longer, until the watermark passes."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def live_counts(events: DataFrame, ts: str, by: str, size: str, late: str = "1 hour") -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are dropped."""
    return window_counts(events.withWatermark(ts, late), ts, by, size)


def quarantine(entries: DataFrame, pending: str, rejected: str, checkpoint: str, source_text: str = "source_text") -> StreamingQuery:
    """Gate every entry; accepted ones go to the pending store, the others to the event log.

    Both writes sit in one batch folder named by batch id and replace it, so a replayed batch after
    a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("problems", entry_problems(F.col("message"), F.col("category"), F.col(source_text))).persist()
        ok = checked.where(F.size("problems") == 0).select(
            "ts", dataset_form(F.col("message")).alias("message"), F.col("message").alias("raw_message"), "category", "confidence",
            F.lit("pending").alias("status"))
        no = checked.where(F.size("problems") > 0).select("ts", F.lit("dataset_rejected").alias("event"), F.struct(
            F.array_join("problems", ";").alias("categories"), F.col("message")).alias("details"))
        ok.write.mode("overwrite").json(f"{pending}/batch={batch_id}")
        no.write.mode("overwrite").json(f"{rejected}/batch={batch_id}")
        checked.unpersist()

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
