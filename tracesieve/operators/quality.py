"""Quality hints and complexity signals of source lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import carry_forward, running
from tracesieve.functions.rules import any_of, first_match
from tracesieve.operators.structure import body_text, braced, chunk, scopes, with_depth, with_function
from tracesieve.session import cut_lineage, share

# fixed values: hint patterns
STRLEN_LOOP = r"\b(?:for\s*\([^;]*;[^;]*|while\s*\([^)]*)\bstrlen\s*\("
VECTOR_DECL = r"\b(?:std::)?vector\s*<[^>]+>\s+([a-zA-Z_]\w*)"
RESERVE = r"\b([a-zA-Z_]\w*)\.reserve\s*\("
RANGE_COPY = r"\bfor\s*\(\s*(?:const\s+)?(?:std::)?(?:string|vector\s*<[^>]+>|map\s*<[^>]+>|set\s*<[^>]+>)\s+([a-zA-Z_]\w*)\s*:"
HEAVY = (r"[(,]\s*(?:const\s+)?(?:std::)?(?:string|vector\s*<[^>]+>|map\s*<[^>]+>|set\s*<[^>]+>|unordered_map\s*<[^>]+>|unordered_set\s*<[^>]+>)"
         r"\s+([a-zA-Z_]\w*)\s*(?:=[^,)]*)?(?=[,)])")
CALL_SHAPE = r"\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b|sizeof\b|decltype\b)[a-zA-Z_]\w*\s*\([^)]*\)"
LOOP = r"\b(?:for|while)\s*\("
HALVES = r"(?i)/\s*2|\bmid\b|\bleft\b|\bright\b|>>\s*1|\bmerge\b|\bpartition\b"
TREE = r"(?i)->\s*(?:left|right|children|next)|pair\.second|\bnode\b"
SMALLER = r"-\s*1|-\s*2"
SORT = r"\b(?:std::)?sort\s*\("
ORDERED = r"\b(?:std::)?(?:map|set|priority_queue)\b"
SIZED_ARRAY = r"\b(?:int|double|float|char|long|size_t)\s+[a-zA-Z_]\w*\[\s*([0-9]+)\s*\]"
BULKY = r"\b(?:std::)?(?:vector|string|map|set|unordered_map|unordered_set)<[^>]+>\s+[a-zA-Z_]\w*\s*[,)]"
CONCAT = r"\b([a-zA-Z_]\w*)\s*=\s*(?:[^;=]*[^\w;=])?\1\b[^;=]*;"


def looping() -> Column:
    return F.col("code").contains("for") | F.col("code").contains("while")


def loop_lines(lines: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(file, line_no, depth, root): loops around each line, the line's own header included, and
    the line of the outermost one. ``while`` right after a closing brace ends a do-loop.

    A loop reaches from the line after its header to the line where the last scope of the header closes. These stretches nest, so the number
    around a line is a running sum of starts and ends, and the outermost one changes only where no stretch goes on.
    ``probes`` (file, line_no) are the lines that are asked for, all by default; no others are numbered.
    """
    head = looping() & F.col("code").rlike(LOOP) & ~F.col("code").rlike(r"\}\s*while\s*\(")
    d = with_depth(lines.where(braced() | looping()).select("file", "line_no", "code", head.alias("__head")))
    heads = cut_lineage(d.where("__head").select("file", "line_no", "depth", "depth_after"))
    open_ = (1 << 62)
    reach = scopes(lines).join(heads.where("depth_after > depth").select("file", F.col("line_no").alias("open_line")), ["file", "open_line"], "left_semi") \
        .groupBy("file", "open_line").agg(F.max(F.coalesce("close_line", F.lit(open_))).alias("end")).where("end > open_line")
    turns = reach.select("file", F.explode(F.array(F.struct((F.col("open_line") + 1).alias("line_no"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
                                                   F.struct((F.col("end") + 1).alias("line_no"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))).alias("t")) \
        .select("file", "t.*")
    what = lambda **on: [F.lit(on.get(c, 0)).alias(c) for c in ("starts", "ends", "__own", "__ask")]
    every = turns.select("file", "line_no", "starts", "ends", F.lit(0).alias("__own"), F.lit(0).alias("__ask")) \
        .unionByName(heads.select("file", "line_no", *what(__own=1))) \
        .unionByName((lines if probes is None else probes).select("file", "line_no", *what(__ask=1))) \
        .groupBy("file", "line_no").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("__own").alias("__own"), F.max("__ask").alias("__ask"))
    around = running(every, ["file"], chunk(), ["line_no"], {"__in": ("sum", F.col("starts") - F.col("ends"))})
    first = F.when((F.col("starts") > 0) & (F.col("__in") == F.col("starts")), F.col("line_no") - 1)
    rooted = carry_forward(around, ["file"], chunk(), ["line_no"], {"__root": first}, include_current=True)
    return rooted.where("__ask > 0 AND __in + __own > 0").select("file", "line_no", (F.col("__in") + F.col("__own")).alias("depth"),
                                                   F.when(F.col("__in") > 0, F.col("__root")).otherwise(F.col("line_no")).alias("root"))


def quality_hints(lines: DataFrame) -> DataFrame:
    """(file, line_no, hint, weight)."""
    code = F.col("code")

    def each(p: str, hint: str, weight: int, base: DataFrame) -> DataFrame:
        return base.select("file", "line_no", F.explode(F.regexp_extract_all(code, F.lit(p), F.lit(1)))).select(
            "file", "line_no", F.lit(hint).alias("hint"), F.lit(weight).alias("weight"))

    def hint(df: DataFrame, name: str, weight: int) -> DataFrame:
        return df.select("file", "line_no", F.lit(name).alias("hint"), F.lit(weight).alias("weight"))

    # plain substring tests come before the patterns; only lines that a loop matters to are asked where they lie
    is_loop = looping() & code.rlike(LOOP)
    ends_line = code.contains("endl") & code.rlike(r"\b(?:std::)?endl\b")
    grows = code.contains("+") & code.contains("=") & code.rlike(CONCAT)
    pushes = F.when(code.contains(".push_back"), F.regexp_extract_all(code, F.lit(r"\b([a-zA-Z_]\w*)\.push_back\s*\("), F.lit(1)))
    asked = share(lines.where(looping() | code.contains("endl") | code.contains("+") | code.contains(".push_back")).select(
        "file", "line_no", is_loop.alias("__loop"), ends_line.alias("__endl"), grows.alias("__grows"), pushes.alias("__push"))
        .where("__loop OR __endl OR __grows OR size(__push) > 0"))
    loops = share(loop_lines(lines, asked).join(asked, ["file", "line_no"]))
    strlen = hint(lines.where(code.contains("strlen") & code.rlike(STRLEN_LOOP)), "strlen_in_loop_condition", 2)
    copies = each(RANGE_COPY, "copy_in_range_for", 1, lines.where(code.contains("for")))
    by_value = each(HEAVY, "pass_by_value", 1, lines.where(code.contains("(") & any_of(code, ("string", "vector", "map", "set")) & code.rlike(CALL_SHAPE)))
    nested = loops.where("__loop AND depth >= 2").groupBy("file", "root").agg(F.min("line_no").alias("line_no"), F.max("depth").alias("d")) \
        .select("file", "line_no", F.lit("nested_loops").alias("hint"), F.when(F.col("d") >= 3, 3).otherwise(2).alias("weight"))
    endl = hint(loops.where("__endl"), "endl_in_loop", 1)
    concat = hint(loops.where("__grows"), "string_concat_in_loop", 1)
    var = lambda p, word: lines.where(code.contains(word)).select("file", F.explode(F.regexp_extract_all(code, F.lit(p), F.lit(1))).alias("var")).distinct()
    growing = var(VECTOR_DECL, "vector").join(var(RESERVE, ".reserve"), ["file", "var"], "left_anti")
    push = loops.select("file", "line_no", F.explode("__push").alias("var")).join(growing, ["file", "var"], "left_semi").groupBy("file", "var") \
        .agg(F.min("line_no").alias("line_no")).select("file", "line_no", F.lit("push_back_without_reserve").alias("hint"), F.lit(1).alias("weight"))
    out = strlen
    for p in (copies, by_value, nested, endl, concat, push):
        out = out.unionByName(p)
    return out


def quality_level(files: DataFrame, hints: DataFrame) -> DataFrame:
    """Summed weight per file and its level; files without hints are Good."""
    s = hints.groupBy("file").agg(F.sum("weight").alias("__s"))
    score = F.coalesce("__s", F.lit(0))
    return files.join(s, "file", "left").select("file", score.cast("bigint").alias("score"),
                                                F.when(score <= 1, "Good").when(score <= 4, "Fair").otherwise("Needs work").alias("level"))


def complexity(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Time and space class per file from loop depth, recursion shape and containers."""
    code = F.col("code")
    loops = loop_lines(lines).groupBy("file").agg(F.max("depth").alias("loops"))
    fns = with_function(lines).where("fn IS NOT NULL").withColumn("body", body_text())
    own = F.concat(F.lit(r"\b"), F.col("fn"), F.lit(r"\s*\("))
    rec = fns.where("fn <> 'main'").groupBy("file", "fn_line").agg(
        F.sum(F.regexp_count("body", own)).alias("calls"),
        F.bool_or(F.col("body").rlike(HALVES)).alias("halves"),
        F.bool_or(F.col("body").rlike(TREE)).alias("tree"),
        F.bool_or(F.col("body").rlike(SMALLER)).alias("less")).where("calls > 0")
    r = rec.groupBy("file").agg(F.bool_or("halves").alias("halving"), F.bool_or(~F.col("halves") & F.col("tree")).alias("walking"),
                                F.bool_or(~F.col("halves") & ~F.col("tree") & (F.col("calls") >= 2) & F.col("less")).alias("branching"))
    arr = F.regexp_extract(code, SIZED_ARRAY, 1).try_cast("bigint")
    f = lines.groupBy("file").agg(
        F.bool_or(code.rlike(SORT)).alias("sorts"), F.bool_or(code.rlike(ORDERED)).alias("maps"),
        F.bool_or(code.rlike(VECTOR_DECL)).alias("vectors"),
        F.bool_or(F.coalesce(arr >= 1000, F.lit(False)) | code.rlike(BULKY)).alias("bulky"))
    j = files.join(loops, "file", "left").join(r, "file", "left").join(f, "file", "left")
    no = F.lit(False)
    depth = F.coalesce("loops", F.lit(0))
    br, ha, wa = (F.coalesce(c, no) for c in ("branching", "halving", "walking"))
    so, ma, ve, bu = (F.coalesce(c, no) for c in ("sorts", "maps", "vectors", "bulky"))
    time = first_match([(br, "O(2^n)"), (ha & (depth >= 2), "O(n²)"), (ha, "O(n log n)"), (wa & (depth >= 2), "O(n²)"), (wa & so, "O(n log n)"),
                        (wa, "O(n)"), (depth >= 3, "O(n³)"), (depth == 2, "O(n²)"), ((depth == 1) & so, "O(n log n)"), (depth == 1, "O(n)"),
                        (so, "O(n log n)"), (ma, "O(log n)"), (ve, "O(n)")], "O(1)")
    space = first_match([(br | ha | wa | bu | ve | ma, "O(n)")], "O(1)")
    return j.select("file", depth.cast("bigint").alias("loop_depth"), time.alias("time_class"), space.alias("space_class"))
