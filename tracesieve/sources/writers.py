"""Sinks: append logs, flat reports, SARIF, telemetry and metrics documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.operators.findings import SARIF_LEVELS

LOG_FILE_ROWS = 20_000  # keeps a log file near the 5 MB rotation size


def append_log(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Appends JSON lines, one folder per day and bounded files instead of size rotation."""
    df.withColumn("day", F.to_date(F.to_timestamp(ts))).write.mode("append").partitionBy("day").option(
        "maxRecordsPerFile", LOG_FILE_ROWS).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sarif_documents(findings: DataFrame, run: str, tool: str = "tracesieve") -> DataFrame:
    """One SARIF 2.1.0 document per value of ``run``: results in order, rules once each.

    A document holds one scan run; runs are the unit that bounds its size.
    """
    level = F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv])
    rule = F.coalesce("cwe_id", F.upper(F.replace("finding_type", F.lit(" "), F.lit("_"))))
    res = findings.select(run, F.struct(
        F.col("file").alias("__f"), F.coalesce("line", F.lit(1)).alias("__l"), F.coalesce("column", F.lit(1)).alias("__c"), rule.alias("ruleId"),
        level[F.col("severity")].alias("level"), F.struct(F.col("finding_type").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.coalesce("file", F.lit("unknown.cpp")).alias("uri")).alias("artifactLocation"),
                                  F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"),
                                           F.greatest(F.coalesce("column", F.lit(1)), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))).alias("locations")).alias("r"))
    results = res.groupBy(run).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    names = res.groupBy(run, F.col("r.ruleId").alias("id")).agg(F.min_by(F.col("r.message.text"), F.struct("r.__f", "r.__l", "r.__c")).alias("name")) \
        .groupBy(run).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("rules"))
    doc = F.to_json(F.struct(
        F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"),
                         F.transform("rs", lambda x: x.dropFields("__f", "__l", "__c")).alias("results"))).alias("runs")))
    return results.join(names, run).select(run, doc.alias("value"))


def write_sarif(findings: DataFrame, run: str, path: str) -> None:
    """One text file row per run document, in a folder per run."""
    sarif_documents(findings, run).write.mode("overwrite").partitionBy(run).text(path)


def write_telemetry(samples: DataFrame, actions: DataFrame, path: str) -> None:
    """Samples and action table side by side, each with its own header."""
    write_report(samples, f"{path}/samples")
    write_report(actions, f"{path}/actions")


def write_metrics(parts: dict[str, DataFrame], path: str) -> None:
    """One nested JSON document from named one-row tables."""
    spark = next(iter(parts.values())).sparkSession
    doc = spark.range(1).select(*[df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in parts.items()])
    doc.write.mode("overwrite").json(path)
