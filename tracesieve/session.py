"""Session construction and lineage cutting."""
from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tracesieve") -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE with skew handling, Arrow.

    Cluster-sized settings (memory, executors, shuffle partitions) stay with the caller's
    spark-defaults; only local runs pass ``master`` and ``shuffle_partitions``.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = (b.master(master).config(INPUT_TASKS, str(shuffle_partitions or 8)).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("TRACESIEVE_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


_GENERATE_FILTERS = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def tune(spark: SparkSession) -> None:
    """Runtime settings of the operators, for sessions built elsewhere too.

    The excluded rule adds a filter "array not empty" below every explode and thereby evaluates the
    exploded expression (tokenising, splitting, scanning) a second time, inlined. Rules that a user excluded stay excluded.

    Small sides of joins are broadcast by their measured size only: Spark guesses 20 bytes for a text made from a few numbers and ignores
    what an explode adds, so a guess below the limit may be a table too large for the driver.
    """
    guessed = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if guessed != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", guessed)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rules = [r for r in spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if r]
    if _GENERATE_FILTERS not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, _GENERATE_FILTERS]))


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever the driver was started; once per application."""
    context = spark.sparkContext
    if not getattr(context, "_tracesieve_shipped", False):
        root = Path(__file__).resolve().parent.parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/tracesieve_package", "zip", root, "tracesieve"))
        context._tracesieve_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; a scratch folder
    only where that is unset and driver and executors share the machine (tests). Elsewhere it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and bounds plan size in iterative jobs."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Session setting: inputs of text-heavy queries with fewer splits than this are dealt out to so many tasks. Unset on clusters.
INPUT_TASKS = "spark.tracesieve.inputTasks"


def dealt(df: DataFrame) -> DataFrame:
    """The input as it is, unless the session asks for a least number of tasks.

    A file with one row group is one split, whatever the machine. Only who runs such files (tests, the bench) sets
    `INPUT_TASKS`; without it no plan depends on sizes or cores.
    """
    tasks = df.sparkSession.conf.get(INPUT_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


_SHARED: list[DataFrame] = []


def share(df: DataFrame) -> DataFrame:
    """Computes an intermediate once although the plan reads it several times.

    Two-pass operators (local result plus per-chunk summary) read their input twice; chained, that
    would double the work at every step. The copy is lazy, spills to disk, and a lost executor only
    costs the recomputation of its partitions.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(kept)
    return kept


def release_shared() -> None:
    """Frees the intermediates of finished jobs; a frame still in use is recomputed on demand."""
    while _SHARED:
        _SHARED.pop().unpersist()


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is shared in the block and the shuffle files of its queries go when it ends; only checkpoints outlive it.

    Spark keeps shuffle files until the driver's JVM collects the frames that wrote them, which a long query made of many steps
    may never see: files of finished steps pile up on the executors' disks. Those below shared frames go with a collection at the end.
    """
    kept, before = len(_SHARED), spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        while len(_SHARED) > kept:
            _SHARED.pop().unpersist()
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
        gc.collect()  # frames nobody holds any more go here and in the driver's JVM
        spark.sparkContext._jvm.System.gc()
