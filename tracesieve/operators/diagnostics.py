"""Raw log lines to typed diagnostic rows.

Every operator takes a line table (log key, ``line_no``, ``line``); texts become one with
``functions.text.explode_lines``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.ordered import ranked
from tracesieve.functions.rules import any_of
from tracesieve.functions.text import strip
from tracesieve.session import share


@dataclass(frozen=True)
class LineFormat:
    """Pattern of a diagnostic line; group numbers, 0 = not captured."""
    pattern: str
    severity: int
    message: int
    file: int = 0
    line: int = 0
    column: int = 0


# fixed values: the four accepted line layouts
FULL = LineFormat(r"^(.+?):(\d+)(?::(\d+))?:\s*(error|warning|note):\s*(.*)$", 4, 5, 1, 2, 3)
DRIVER = LineFormat(r"^(.+?):(\d+):(\d+):\s*(fatal error|error|warning):\s*(.*)$", 4, 5, 1, 2, 3)
CORPUS = LineFormat(r"^[^\s:][^:]*:\d+(?::\d+)?:\s*(error|warning|note|fatal error):\s*(.+)$", 1, 2)
PORTABLE = LineFormat(r"^(?:[A-Za-z]:)?[^:\r\n]+:\d+(?::\d+)?: (?:fatal )?(error|warning|note): (.*)$", 1, 2)

BLOCK_OPEN = "Undefined symbols for architecture"
BLOCK_CLOSE = "ld: symbol(s) not found for architecture"


def parse_lines(lines: DataFrame, keys: list[str], fmt: LineFormat) -> DataFrame:
    """One row per line that fits the layout."""
    raw = strip(F.col("line"))
    hit = lines.withColumn("raw", raw).where(F.col("raw").rlike(fmt.pattern))

    def grp(i: int) -> Column:
        return F.regexp_extract("raw", fmt.pattern, i)

    cols: list[Column] = [grp(fmt.severity).alias("severity"), strip(grp(fmt.message)).alias("message"), F.col("raw")]
    if fmt.file:
        cols = [grp(fmt.file).alias("file_name"), grp(fmt.line).cast("int").alias("line"),
                F.nullif(grp(fmt.column), F.lit("")).cast("int").alias("column"), *cols]
    return hit.select(*keys, "line_no", *cols)


def mark_blocks(lines: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Adds ``block``: the ordinal of the linker block a line belongs to, NULL outside.

    A block runs from an opening line through its closing line, or to the end of the log; an
    opening line inside a block opens nothing.
    """
    opens, closes = F.col("line").contains(BLOCK_OPEN), F.col("line").contains(BLOCK_CLOSE)
    base = lines.withColumns({"__c": chunk, "__o": opens, "__e": F.when(closes, F.lit("c")).when(opens, F.lit("o"))})
    w = Window.partitionBy(*keys, "__c").orderBy("line_no")
    upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    # one sort gives state and count within a chunk as if it began outside a block; __f: whether its first event opens
    local = base.withColumn("__s", F.last("__e", ignorenulls=True).over(above))
    local = share(local.withColumns({"__n": F.sum((F.col("__o") & ~F.coalesce(F.col("__s") == "o", F.lit(False))).cast("bigint")).over(upto),
                                     "__f": F.first(F.when(F.col("__e").isNotNull(), F.col("__o")), ignorenulls=True).over(upto)}))
    at = F.when(F.col("__e").isNotNull(), F.col("line_no"))
    tails = local.groupBy(*keys, "__c").agg(F.max_by("__e", at).alias("__e"), F.max("__n").alias("__n"), F.bool_or("__f").alias("__f"))
    wt = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("__in", F.coalesce(F.last("__e", ignorenulls=True).over(wt) == "o", F.lit(False)))
    tails = tails.withColumn("__n0", F.sum(F.col("__n") - (F.col("__in") & F.coalesce("__f", F.lit(False))).cast("bigint")).over(wt))
    # a first chunk begins outside and at zero, so only later ones are looked up
    before = tails.where("__in OR __n0 > 0").select(*keys, "__c", "__in", "__n0")
    j = local.join(before, [*keys, "__c"], "left")
    came = F.coalesce("__in", F.lit(False))
    inside = F.coalesce(F.col("__s") == "o", came)
    number = F.col("__n") + F.coalesce("__n0", F.lit(0)) - (came & F.coalesce("__f", F.lit(False))).cast("bigint")
    return j.withColumn("block", F.when(inside | F.col("__o"), number)).drop("__c", "__o", "__e", "__s", "__n", "__f", "__in", "__n0")


def parse_log(lines: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Diagnostics and linker blocks of each log, one row each, positioned by first line."""
    marked = mark_blocks(lines.select(*keys, "line_no", "line"), keys, chunk)
    single = parse_lines(marked.where("block IS NULL"), keys, FULL)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("line")).alias("t")))),
                                    lambda e: e["t"]), "\n")
    blocks = (marked.where("block IS NOT NULL").groupBy(*keys, "block")
              .agg(F.min("line_no").alias("line_no"), text.alias("message"))
              .select(*keys, "line_no", F.lit(None).cast("string").alias("file_name"),
                      F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"),
                      F.lit("linker").alias("severity"), "message", F.col("message").alias("raw")))
    return single.unionByName(blocks)


def parse_driver(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Layout with a mandatory column; fatal errors count as errors, notes do not fit."""
    return parse_lines(lines, keys, DRIVER).withColumn(
        "severity", F.when(F.col("severity") == "fatal error", "error").otherwise(F.col("severity")))


def parse_corpus(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Messages for a labelled corpus: no notes, carets or fragments; residual prefixes dropped."""
    out = parse_lines(lines, keys, CORPUS).where((F.col("severity") != "note") & ~F.col("message").rlike(r"^\s*\^"))
    clean = strip(F.regexp_replace("message", r"(?i)^\s*(error|warning|fatal error):\s*", ""))
    return out.withColumn("message", clean).where(F.length("message") >= 4)


def first_diagnostic(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First error, warning or undefined reference of each log (map-side combined)."""
    t = strip(F.col("line"))
    symbol = F.regexp_extract(t, r"undefined reference to ['`\x22]?([^'\x22\n]+)['`\x22]?", 1)
    is_ref = t.contains("undefined reference to")
    fits = t.rlike(PORTABLE.pattern) & (F.regexp_extract(t, PORTABLE.pattern, 1) != "note")
    ref_msg = F.concat(F.lit("undefined reference to '"), F.when(symbol == "", "symbol").otherwise(symbol), F.lit("'"))
    cand = lines.where(is_ref | fits).select(
        *keys, "line_no", t.alias("raw"),
        F.when(is_ref, ref_msg).otherwise(F.regexp_extract(t, PORTABLE.pattern, 2)).alias("message"))
    return cand.groupBy(*keys).agg(F.min("line_no").alias("line_no"),
                                   F.min_by(F.struct("raw", "message"), "line_no").alias("__d")) \
        .select(*keys, "line_no", "__d.raw", "__d.message")


FIND_ALL = r"(?m):\s*(?:error|fatal error|warning):\s*(.+)$"


def find_all(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Every message anywhere in a text; flag suffixes dropped, longer than four characters."""
    out = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(FIND_ALL), F.lit(1))).alias("pos", "m"))
    msg = strip(F.regexp_replace(strip(F.col("m")), r"\[-W[^\]]+\]", ""))
    return out.select(*keep, "pos", msg.alias("message")).where(F.length("message") > 4)


def source_context(diags: DataFrame, source: DataFrame, key: str, around: int = 2) -> DataFrame:
    """Lines around each diagnostic, clamped to the file.

    The window becomes at most ``2 * around + 1`` exact keys, so this is an equi-join on
    (file, line) and never a range join.
    """
    ids = [c for c in diags.columns]
    want = diags.withColumn("__at", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    j = want.join(source.select(key, F.col("line_no").alias("__at"), F.col("raw").alias("__src")), [key, "__at"])
    return j.groupBy(*ids).agg(
        F.min("__at").alias("start_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__src"))), lambda e: e["__src"]), "\n").alias("context"))


# fixed values: warnings that only matter to the security view
QUIET_WARNINGS = ("unused variable", "set but not used", "declared but never used")


def is_quiet(severity: Column, message: Column) -> Column:
    return (severity == "warning") & any_of(F.lower(message), QUIET_WARNINGS)


def priority(severity: Column, message: Column) -> Column:
    """0 errors and return problems, 2 statements without effect, 1 the rest."""
    m = F.lower(message)
    return (F.when(any_of(m, ("no return statement", "return-type")) | (severity == "error"), 0)
            .when(m.contains("statement has no effect"), 2).otherwise(1))


def display_order(diags: DataFrame, keys: list[str]) -> DataFrame:
    """Visible diagnostics with their ``place`` in each log: by priority, then line, then position. A long log is ranked by many tasks."""
    seen = diags.where(~is_quiet(F.col("severity"), F.col("message")))
    order = [priority(F.col("severity"), F.col("message")), F.coalesce("line", F.lit(0)), F.col("line_no")]
    return ranked(seen, keys, order, "place").withColumn("place", F.col("place").cast("int"))


def log_status(diags: DataFrame, all_logs: DataFrame, keys: list[str]) -> DataFrame:
    """Visible error and warning counts and the overall status; logs without rows are 'success'."""
    visible = diags.where(~is_quiet(F.col("severity"), F.col("message")))
    counts = visible.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("errors"),
                                        F.count_if(F.col("severity") == "warning").alias("warnings"))
    e, w = F.coalesce("errors", F.lit(0)), F.coalesce("warnings", F.lit(0))
    return all_logs.join(counts, keys, "left").select(
        *keys, e.alias("errors"), w.alias("warnings"),
        F.when(e > 0, "error").when(w > 0, "warning").otherwise("success").alias("status"))
