"""Named queries over the star-schema, document and event tables, each with its SQL twin."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.session import dealt

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet readers for one scale folder; event and ship times come back as TIMESTAMP."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    HEAVY = ("documents", "pages", "conversations", "lineitem", "orders")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return dealt(df) if name in self.HEAVY else df

    @cached_property
    def timed_events(self) -> DataFrame:
        """events with ``ts`` as TIMESTAMP and ``us`` as epoch microseconds."""
        ts = F.col("ts").cast("timestamp")
        return self.events.withColumns({"ts": ts, "us": F.unix_micros(ts)})


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
