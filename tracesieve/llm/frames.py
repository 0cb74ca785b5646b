"""Small frame helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at once; texts may be long, so far fewer than Spark's default.
BATCH_ROWS = 1000

#: White space as the contracts of this library's word counts have it.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text with null taken as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row per input row: ``make()`` runs once per task and gives the function of a row's values.

    Narrow, so a lost executor only costs its own tasks. Values go through Arrow in batches of ``BATCH_ROWS``.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, shape = make(), None
        for b in batches:
            if b.num_rows:
                shape = shape or arrow_schema(schema)
                out = zip(*map(row, *(c.to_pylist() for c in b.columns)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, shape, strict=True)], schema=shape)

    return df.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
          "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of ``"a long, b string, c array<int>"``."""
    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]
    return pa.schema([(name, kind(t)) for name, t in (x.split() for x in ddl.split(","))])
