"""Structure of brace-delimited source as line tables: depth, scopes, functions, calls.

Input lines carry (file, line_no, raw, code) with ``code`` free of comments and literals. All
order-dependent state is a running sum, running minimum or as-of carry over line chunks, so a very
long file is spread over tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import carry_forward, running, running_floored
from tracesieve.functions.rules import bound
from tracesieve.functions.text import LINE_BREAK, strip_code
from tracesieve.session import cut_lineage, share

LINE_CHUNK = 4096


def chunk(col: str = "line_no") -> Column:
    return F.floor(F.col(col) / F.lit(LINE_CHUNK))


def source_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Line table of whole source texts; comments and raw strings may span lines."""
    flat = F.regexp_replace(F.col(text), LINE_BREAK, "\n")
    pair = F.arrays_zip(F.split(flat, "\n").alias("raw"), F.split(strip_code(flat), "\n").alias("code"))
    return df.select(F.col(key).alias("file"), F.posexplode(pair).alias("__p", "__l")) \
        .select("file", (F.col("__p") + 1).cast("bigint").alias("line_no"), "__l.raw", "__l.code")


def strip_lines(lines: DataFrame) -> DataFrame:
    """Adds ``code`` to a line table whose comments stay within their line."""
    return lines.withColumn("code", strip_code(F.col("raw")))


def brace_events(lines: DataFrame) -> DataFrame:
    """(file, line_no, idx, delta) per brace; ``idx`` is its place among the braces of the line."""
    b = lines.where(braced()).select("file", "line_no", F.posexplode(
        F.split(F.regexp_replace("code", "[^{}]", ""), "")).alias("idx", "ch"))
    return b.where("ch <> ''").select("file", "line_no", "idx", F.when(F.col("ch") == "{", 1).otherwise(-1).alias("delta"))


def braced() -> Column:
    """True on lines that move the depth; what holds for the depth of all others follows from these."""
    return F.col("code").contains("{") | F.col("code").contains("}")


def with_depth(lines: DataFrame) -> DataFrame:
    """Adds ``depth``: open braces before each line, never below zero.

    Within a line only the sum and the lowest prefix matter, so one row per line carries both. Lines without braces may be left out of
    ``lines`` where their depth is not asked for; the others keep theirs.
    """
    pair = lambda s, m: F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"))

    def walk(b: Column) -> Column:
        steps = F.aggregate(F.split(b, ""), pair(0, 0),
                            lambda a, c: F.struct((a["s"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("s"),
                                                  F.least(a["m"], a["s"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("m")))
        return F.when(b == "{", pair(1, 0)).when(b == "}", pair(-1, -1)).otherwise(steps)

    moved = F.when(braced(), bound(F.regexp_replace("code", "[^{}]", ""), walk)).otherwise(pair(0, 0))
    return running_floored(lines.withColumn("__w", moved), ["file"], chunk(), ["line_no"], F.col("__w.s"), F.col("__w.m"), "depth").drop("__w")


def brace_levels(lines: DataFrame) -> DataFrame:
    """Brace events with the ``depth`` of the scope that they open or close; a closing brace without an open scope is left out."""
    ev = running_floored(brace_events(lines), ["file"], chunk(), ["line_no", "idx"], F.col("delta"), F.least(F.col("delta"), F.lit(0)), "__lv")
    depth = F.when(F.col("delta") > 0, F.col("__lv_after")).otherwise(F.col("__lv"))
    return ev.withColumn("depth", depth.cast("int")).where("depth > 0").drop("__lv", "__lv_after")


def scopes(lines: DataFrame) -> DataFrame:
    """One row per scope: (file, depth, open_line, open_idx, close_line, close_idx); a scope that stays open has no close.

    Openings and closings of one depth of a file take turns, so the closing brace of a scope is the next one of its depth: an as-of carry
    from the end of the file.
    """
    ev = brace_levels(lines).select("file", "depth", "delta", (-F.col("line_no")).alias("__l"), (-F.col("idx")).alias("__i"))
    at = F.struct((-F.col("__l")).alias("close_line"), (-F.col("__i")).alias("close_idx"))
    ends = carry_forward(ev, ["file", "depth"], chunk("__l"), ["__l", "__i"], {"__c": F.when(F.col("delta") < 0, at)}).where("delta > 0")
    return ends.select("file", "depth", (-F.col("__l")).alias("open_line"), (-F.col("__i")).alias("open_idx"), "__c.close_line", "__c.close_idx")


def innermost_scope(lines: DataFrame, probes: DataFrame) -> DataFrame:
    """(file, line_no, open_line, open_idx) of the innermost scope open at the start of each probed line; lines at file level have none.

    It is the last scope that opened at the line's own depth: braces and probes share one running depth, then one as-of carry by (file, depth).
    """
    asks = probes.select("file", "line_no").distinct().select("file", "line_no", F.lit(-1).alias("idx"), F.lit(0).alias("delta"))
    level = running_floored(brace_events(lines).unionByName(asks), ["file"], chunk(), ["line_no", "idx"], F.col("delta"), F.least(F.col("delta"), F.lit(0)), "__lv")
    known = level.withColumn("depth", F.col("__lv_after").cast("int")).where("delta >= 0 AND depth > 0").drop("__lv", "__lv_after")
    at = F.struct(F.col("line_no").alias("open_line"), F.col("idx").alias("open_idx"))
    j = carry_forward(known, ["file", "depth"], chunk(), ["line_no", "idx"], {"__o": F.when(F.col("delta") > 0, at)})
    return j.where("delta = 0").select("file", "line_no", "__o.open_line", "__o.open_idx")


def count_within(spans: DataFrame, marks: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: how many ``marks`` (keys, line_no) lie behind ``open_line`` up to and with ``close_line`` (null: to the end).

    Running counts at both ends of a span are subtracted, so nested spans share one pass over marks and ends. The counts, one row per
    line with a mark or an end, are written once; the plans that read them stay small.
    """
    ends = spans.select(*keys, F.col("open_line").alias("line_no")).union(spans.select(*keys, F.col("close_line").alias("line_no"))) \
        .where("line_no IS NOT NULL").distinct().withColumn("__n", F.lit(0).cast("bigint"))
    per_line = marks.groupBy(*keys, "line_no").agg(F.count("*").alias("__n")).unionByName(ends).groupBy(*keys, "line_no").agg(F.sum("__n").alias("__n"))
    upto = cut_lineage(running(per_line, keys, chunk(), ["line_no"], {"__upto": ("sum", F.col("__n"))}).select(*keys, "line_no", "__upto"))
    total = marks.groupBy(*keys).agg(F.count("*").alias("__all"))
    at_open = upto.select(*keys, F.col("line_no").alias("open_line"), F.col("__upto").alias("__from"))
    at_close = upto.select(*keys, F.col("line_no").alias("close_line"), F.col("__upto").alias("__to"))
    j = spans.join(at_open, [*keys, "open_line"]).join(at_close, [*keys, "close_line"], "left").join(total, keys, "left")
    last = F.when(F.col("close_line").isNull(), F.coalesce("__all", F.lit(0))).otherwise(F.col("__to"))
    return j.withColumn(out, last - F.col("__from")).drop("__from", "__to", "__all")


def enclosing_scopes(lines: DataFrame, probes: DataFrame) -> DataFrame:
    """Every open scope around the start of each probed line: (file, line_no, depth, open_line, open_idx).

    A probe asks, for each depth up to its own, which brace last opened that depth: an as-of carry
    keyed by (file, depth) instead of an interval join. The result lists every pair; where a count or the innermost scope is enough,
    `count_within` and `innermost_scope` stay linear in the lines.
    """
    ev = brace_events(lines).select("file", "line_no", "idx", "delta")
    ask = probes.select("file", "line_no").distinct().select("file", "line_no", F.lit(-1).alias("idx"), F.lit(0).alias("delta"))
    allv = ev.unionByName(ask)
    level = running_floored(allv, ["file"], chunk(), ["line_no", "idx"], F.col("delta"), F.least(F.col("delta"), F.lit(0)), "__lv")
    at = level.withColumn("depth", F.col("__lv_after").cast("int")).drop("__lv", "__lv_after")
    opens = at.where("delta = 1").withColumn("open_at", F.struct(F.col("line_no").alias("open_line"), F.col("idx").alias("open_idx")))
    asks = at.where("delta = 0 AND depth > 0").withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("depth")))) \
        .withColumn("open_at", F.lit(None).cast("struct<open_line:bigint,open_idx:int>"))
    j = carry_forward(opens.unionByName(asks), ["file", "depth"], chunk(), ["line_no", "idx"], {"__o": F.col("open_at")})
    return j.where("delta = 0").select("file", "line_no", "depth", "__o.open_line", "__o.open_idx")


# fixed values: shape of a function header, and words that only look like one
FUNCTION = (r"^\s*(?:(?:const|static|inline|virtual|explicit)\s+)*(?:(?:unsigned|signed)\s+)?"
            r"(?:long\s+long|int|void|bool|double|float|long|auto|char|[A-Za-z_]\w*)\s*(?:\*+|&+|\s+)\s*"
            r"([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:const)?\s*(?:override)?\s*\{")
NOT_FUNCTIONS = ("if", "for", "while", "switch", "return", "sizeof", "catch", "delete", "new", "static_cast",
                 "dynamic_cast", "reinterpret_cast", "const_cast")


def with_function(lines: DataFrame) -> DataFrame:
    """Adds ``fn``, ``fn_line``, ``fn_params`` of the function a line belongs to (header included).

    A line belongs to the last header before it while the depth has not fallen back to the
    header's own; that is a running minimum per (file, header). Lines without braces may be left out of ``lines``: the next line kept
    has the depth they had.
    """
    d = with_depth(lines)
    name = F.regexp_extract("code", FUNCTION, 1)
    params = F.trim(F.regexp_extract("code", FUNCTION, 2))
    opens = F.col("code").contains("{") & F.col("code").contains("(")
    head = F.when(opens & F.col("code").rlike(FUNCTION) & ~name.isin(*NOT_FUNCTIONS),
                  F.struct(F.col("line_no").alias("fn_line"), name.alias("fn"), params.alias("fn_params"), F.col("depth").alias("d0")))
    c = carry_forward(d, ["file"], chunk(), ["line_no"], {"__h": head}, include_current=True)
    c = c.withColumn("__fl", F.coalesce("__h.fn_line", F.lit(0)))
    low = running(c, ["file", "__fl"], chunk(), ["line_no"], {
        "__low": ("min", F.when(F.col("line_no") > F.col("__fl"), F.col("depth")).otherwise(F.lit(1 << 30)))})
    inside = F.col("__h").isNotNull() & ((F.col("line_no") == F.col("__fl")) | (F.col("__low") > F.col("__h.d0")))
    return low.withColumns({k: F.when(inside, F.col(f"__h.{k}")) for k in ("fn", "fn_line", "fn_params")}).drop("__h", "__fl", "__low")


def body_text() -> Column:
    """Code of a line inside its function: the header line only counts after its brace."""
    return F.when(F.col("line_no") == F.col("fn_line"), F.regexp_replace("code", FUNCTION, "")).otherwise(F.col("code"))


def calls(fns: DataFrame) -> DataFrame:
    """(file, fn, callee) distinct calls inside functions, own calls and keywords left out."""
    c = fns.where("fn IS NOT NULL").select("file", "fn", F.explode(F.array_distinct(
        F.regexp_extract_all(body_text(), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("callee"))
    return c.where((F.col("callee") != F.col("fn")) & ~F.col("callee").isin(*NOT_FUNCTIONS)).distinct()


def call_graph(lines: DataFrame) -> DataFrame:
    """Distinct edges with ``internal`` telling whether the callee is defined in the same file."""
    fns = share(with_function(lines.where(braced() | F.col("code").contains("(")).select("file", "line_no", "code")).where("fn IS NOT NULL"))
    defined = fns.where("fn IS NOT NULL").select("file", F.col("fn").alias("callee")).distinct().withColumn("__in", F.lit(True))
    return calls(fns).join(defined, ["file", "callee"], "left").select("file", "fn", "callee", F.coalesce("__in", F.lit(False)).alias("internal"))


def modules(lines: DataFrame) -> DataFrame:
    """Distinct included headers per file."""
    inc = F.regexp_extract("raw", r'^\s*#include\s+[<"]([^>"]+)[>"]', 1)
    return lines.select("file", inc.alias("module")).where("module <> ''").distinct()
