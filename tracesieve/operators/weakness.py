"""Weakness findings in source lines: stateless line rules and facts that hold across lines."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import carry_forward, running, trailing
from tracesieve.functions.rules import LineRule, any_of, scan_lines
from tracesieve.session import cut_lineage, scratch, share
from tracesieve.operators.structure import body_text, chunk, count_within, innermost_scope, scopes, with_function

# fixed values: stateless line rules (type, pattern, severity, column read)
LINE_RULES: tuple[LineRule, ...] = (
    LineRule("Division by Zero", r"/\s*0\b", "High", holds=("/",)),
    LineRule("Buffer Overflow", r"\bgets\s*\(", "Critical", holds=("gets",)),
    LineRule("Unsafe String Function", r"\b(?:strcpy|strcat|sprintf)\s*\(", "High", holds=("strcpy", "strcat", "sprintf")),
    LineRule("Unbounded Input", r'^(?:(?!//).)*\b(?:scanf\s*\(|sscanf\s*\([^,]+,|fscanf\s*\([^,]+,)\s*"(?![^"]*%\d+s)[^"]*%\s*s', "High", on="raw", holds=("scanf",)),
    LineRule("Format String Vulnerability", r"\b(?:printf|fprintf)\s*\(\s*(?:[^,()]+,)?\s*[A-Za-z_]\w*\s*\)\s*;", "High", on="raw", holds=("printf",)),
    LineRule("Insecure Temporary File", r"\b(?:tmpnam|tmpnam_s|mktemp|tempnam)\s*\(", "High", holds=("tmpnam", "mktemp", "tempnam")),
    LineRule("Unchecked Type Conversion", r"\b(?:atoi|atol|atoll|atof)\s*\(", "Medium", holds=("ato",)),
    LineRule("Unsafe Memory Copy", r"\b(?:memcpy|memmove)\s*\([^,]+,[^,]+,(?!.*sizeof)\s*(?:[^,]*\b\d+\b|[^,]*[+\-*/])[^,]*\)\s*;?\s*$", "Medium", holds=("memcpy", "memmove")),
    LineRule("Command Injection", r"\bsystem\s*\(", "High", holds=("system",)),
    LineRule("Unsafe Pointer Arithmetic", r"\*\s*\(\s*[A-Za-z_]\w*\s*\+\s*[^)]+\)|\b(?:[A-Za-z_]\w*ptr|[A-Za-z_]\w*cursor)\s*\+\+", "Medium", holds=("*", "++")),
    LineRule("Integer Overflow", r"^(?!\s*(?:for|while)\s*\()(?=.*\b[A-Za-z_]\w*\s*[+\-*/]\s*[A-Za-z_0-9()]+)"
             r"(?=.*(?:INT_MAX|SIZE_MAX|\b(?:malloc|realloc|calloc)\s*\([^)]*[*+]))", "High", holds=("INT_MAX", "SIZE_MAX", "alloc")),
)
SENSITIVE_CALL = (r"(?i)\b(?:gets|strcpy|strcat|sprintf|scanf|sscanf|fscanf|system|rand|memcpy|memmove|assert|malloc|free|new|delete"
                  r"|fopen|tmpnam|mktemp|atoi)\s*\(?")
SENSITIVE_WORD = r"(?i)\b(?:key|token|password|secret)\b"


def _out(df: DataFrame, kind: Column | str, sev: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("file", "line_no", lit(kind).alias("finding_type"), lit(sev).alias("severity"))


def line_findings(lines: DataFrame) -> DataFrame:
    """Stateless rules, one finding per line and rule."""
    got = scan_lines(lines, LINE_RULES, ["file", "line_no"])
    return got.select("file", "line_no", F.col("rule").alias("finding_type"), "severity")


def assert_findings(lines: DataFrame) -> DataFrame:
    """assert() in files that never test NDEBUG."""
    guarded = lines.where(F.col("raw").contains("#") & F.col("raw").rlike(r"(?i)#\s*(?:if|ifdef|ifndef)\s+.*NDEBUG")).select("file").distinct()
    return _out(lines.where(F.col("code").contains("assert") & F.col("code").rlike(r"\bassert\s*\(")).join(guarded, "file", "left_anti"), "Disabled Safety Check", "Low")


def proximity_findings(lines: DataFrame) -> DataFrame:
    """rand() in a sensitive context and TODO notes on, or one line after, a sensitive line."""
    sensitive = F.col("code").rlike(SENSITIVE_CALL)
    marked = lines.select("file", "line_no", F.coalesce(sensitive, F.lit(False)).cast("int").alias("__s"),
                          (F.col("code").contains("rand") & F.col("code").rlike(r"\brand\s*\(")).alias("__rand"),
                          F.when(F.col("code").contains("rand"), F.col("raw").rlike(SENSITIVE_WORD)).alias("__word"),
                          F.col("raw").rlike(r"(?i)\b(?:TODO|FIXME)\b").alias("__todo"))
    # other lines neither ask nor answer
    near = trailing(marked.where("__s = 1 OR __rand OR __todo"), ["file"], "line_no", 2, {"__near": lambda: F.max("__s")}, bucket=4096)
    return _out(near.where("__rand AND (__near = 1 OR __word)"), "Weak Randomness", "High").unionByName(
        _out(near.where("__todo AND __near = 1"), "Unresolved Security Debt", "Low"))


def _each(lines: DataFrame, pattern: str, name: str = "var", col: str = "code", holds: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, line_no, keep, var) of every match of group 1. Only lines with one of ``holds`` are matched, where they are named."""
    found = F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(1)))
    return (lines.where(any_of(F.col(col), holds)) if holds else lines).select("file", "line_no", *keep, F.explode(found).alias(name))


#: Bits of the sets of names that `_among` sends to the lines of a file.
NAME_BITS = 64


def _name_bit(name: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(name), F.lit(NAME_BITS)))


def _among(lines: DataFrame, patterns: tuple[str, ...], known: DataFrame) -> DataFrame:
    """(file, line_no, var) of every match of group 1 of a pattern in ``code`` that is one of ``known`` (file, var).

    A file sends its lines one number, with a bit for each name's hash, whatever the number of names; words without their bit are dropped
    before they become rows, those left are compared by name.
    """
    bits = known.groupBy("file").agg(F.bit_or(_name_bit(F.col("var"))).alias("__bits"))
    here = lines.select("file", "line_no", "code").join(bits, "file")
    words = F.concat(*[F.regexp_extract_all("code", F.lit(p), F.lit(1)) for p in patterns])
    maybe = F.filter(F.array_distinct(words), lambda x: F.col("__bits").bitwiseAND(_name_bit(x)) != 0)
    return here.select("file", "line_no", F.explode(maybe).alias("var")).join(known, ["file", "var"], "left_semi").select("file", "line_no", "var")


def _first_touch(sets: DataFrame, touches: DataFrame) -> DataFrame:
    """First touching line after each setting line of the same variable; a new setting restarts.

    A touch counts when the event before it is a setting: one as-of carry of the last event.
    """
    known = sets.select("file", "var").distinct()
    ev = sets.select("file", "var", "line_no").distinct().withColumn("__k", F.lit(1)).unionByName(
        touches.join(known, ["file", "var"], "left_semi").select("file", "var", "line_no").distinct()
        .join(sets.select("file", "var", "line_no").distinct(), ["file", "var", "line_no"], "left_anti").withColumn("__k", F.lit(0)))
    j = carry_forward(ev, ["file", "var"], chunk(), ["line_no"], {"__p": F.struct(F.col("__k").alias("k"), F.col("line_no").alias("l"))})
    return j.where("__k = 0 AND __p.k = 1").select("file", "var", "line_no", F.col("__p.l").alias("set_line"))


def uninitialised_uses(lines: DataFrame) -> DataFrame:
    """Variables declared without value and read before any assignment or input."""
    sets = share(_each(lines, r"^\s*(?:int|float|double|char|long)\s+([A-Za-z_]\w*)\s*;\s*$", holds=("int", "float", "double", "char", "long"))
                 .where(~F.col("var").isin("main", "return")))
    touch = _among(lines, (r"(?<![.\->:])\b([A-Za-z_]\w*)\b", r"[:,]\s*([A-Za-z_]\w*)\s*\("), sets.select("file", "var").distinct())
    first = _first_touch(sets, touch).join(lines.select("file", "line_no", "code"), ["file", "line_no"])
    v = F.col("var")
    rhs = F.regexp_extract("code", r"^\s*[A-Za-z_]\w*\s*=\s*(.+);", 1)
    word = lambda pre, post: F.rlike(F.col("code"), F.concat(F.lit(pre), v, F.lit(post)))
    sets_it = (word(r"[:,]\s*", r"\s*\(") | word(r"^\s*(?:int|float|double|char|long|unsigned|short|size_t|auto)\s+", r"\s*=")
               | (word(r"^\s*", r"\s*=\s*.+;") & ~F.rlike(rhs, F.concat(F.lit(r"(?<![.\->:])\b"), v, F.lit(r"\b"))))
               | word(r"cin\s*>>.*?\b", r"\b") | word(r"scanf\s*\(.*&", r"\b") | word(r"getline\s*\([^,]+,\s*", r"\b"))
    return _out(first.where(~sets_it), "Uninitialized Variable", "High")


def _guarded(lines: DataFrame, pattern: str, holds: tuple[str, ...], span: int = 4) -> DataFrame:
    """(file, var, line_no) shielded by a guard on the line itself or one of the ``span - 1`` before."""
    g = _each(lines, pattern, col="raw", holds=holds)
    return g.select("file", "var", F.explode(F.sequence(F.col("line_no"), F.col("line_no") + (span - 1))).alias("line_no")).distinct()


def null_uses(lines: DataFrame) -> DataFrame:
    """First dereference after a null initialisation, unless guarded just before."""
    sets = _each(lines, r"\b(?:int|char|void|double|float)\s*\*\s*([A-Za-z_]\w*)\s*=\s*(?:nullptr|NULL|0)\s*;", holds=("*",))
    touch = _each(lines, r"\*\s*([A-Za-z_]\w*)\b", holds=("*",)).unionByName(_each(lines, r"\b([A-Za-z_]\w*)\s*->", holds=("->",)))
    guard = _guarded(lines, r"\bif\s*\(\s*(?:(?:nullptr|NULL|0)\s*!=\s*)?([A-Za-z_]\w*)\s*(?:!=\s*(?:nullptr|NULL|0)\s*)?\)", ("if",))
    return _out(_first_touch(sets, touch).join(guard, ["file", "var", "line_no"], "left_anti"), "Null Pointer Dereference", "Critical")


def _after(sets: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses on a later line than the first setting of the variable; lines that set are no uses."""
    first = sets.groupBy("file", "var").agg(F.min("line_no").alias("__f"))
    later = uses.join(first, ["file", "var"]).where(F.col("line_no") > F.col("__f")).drop("__f")
    return later.join(sets.select("file", "line_no").distinct(), ["file", "line_no"], "left_anti")


def arithmetic_uses(lines: DataFrame) -> DataFrame:
    """Overflow of INT_MAX values, underflow of unsigned zeros and division by zero variables."""
    hi = _each(lines, r"\b(?<!long\s)(?:int|short)\s+([A-Za-z_]\w*)\s*=\s*(?:INT_MAX|2147483647)\b", holds=("INT_MAX", "2147483647"))
    plus = _each(lines, r"\b([A-Za-z_]\w*)\s*(?:\+\+|\+=|\+)", holds=("+",)).unionByName(_each(lines, r"(?:\+\+|\+)\s*([A-Za-z_]\w*)\b", holds=("+",))).distinct()
    over = _out(_after(hi, plus), "Integer Overflow", "High")
    zero = _each(lines, r"\bunsigned\s+(?:int\s+)?([A-Za-z_]\w*)\s*=\s*0\b", holds=("unsigned",))
    minus = _each(lines, r"\b([A-Za-z_]\w*)\s*(?:--|-=|-)", holds=("-",)).unionByName(_each(lines, r"(?:--|-)\s*([A-Za-z_]\w*)\b", holds=("-",))).distinct()
    positive = _each(lines, r"\b([A-Za-z_]\w*)\s*>\s*0\b", holds=(">",)).select("file", "var").distinct()
    under = _out(_after(zero, minus).join(positive, ["file", "var"], "left_anti"), "Integer Underflow", "High")
    nil = _each(lines, r"\b(?:int|double|float)\s+([A-Za-z_]\w*)\s*=\s*0\b", holds=("=",))
    div = _each(lines, r"/\s*([A-Za-z_]\w*)\b", holds=("/",))
    checked = _each(lines, r"if\s*\(\s*([A-Za-z_]\w*)\s*!=\s*0", col="raw", holds=("if",)).select("file", "var").unionByName(
        _each(lines, r"if\s*\(\s*([A-Za-z_]\w*)\s*==\s*0\s*\)\s*\1\s*=", col="raw", holds=("if",)).select("file", "var")).distinct()
    here = _each(lines, r"\b([A-Za-z_]\w*)\s*!=\s*0", holds=("!=",))
    bad = _after(nil, div).join(checked, ["file", "var"], "left_anti").join(here, ["file", "var", "line_no"], "left_anti")
    return over.unionByName(under).unionByName(_out(bad, "Division by Zero", "High"))


def vector_bounds(lines: DataFrame) -> DataFrame:
    """Constant index past the initialiser length of the latest vector of that name."""
    p = r"\bvector\s*<[^>]+>\s*([A-Za-z_]\w*)\s*=\s*\{([^}]+)\}"
    size = F.size(F.filter(F.split(F.regexp_extract("code", p, 2), ","), lambda x: F.trim(x) != ""))
    sets = lines.where(F.col("code").contains("vector") & F.col("code").rlike(p)).select("file", "line_no", F.regexp_extract("code", p, 1).alias("var"), size.cast("bigint").alias("n"))
    u = r"\b([A-Za-z_]\w*)\s*(?:\[|\.at\()\s*(\d+)\s*(?:\]|\))"
    uses = lines.where(any_of(F.col("code"), ("[", ".at(")) & F.col("code").rlike(u)).select("file", "line_no", F.regexp_extract("code", u, 1).alias("var"),
                                                       F.regexp_extract("code", u, 2).try_cast("bigint").alias("at"))
    uses = uses.join(sets.select("file", "var").distinct(), ["file", "var"], "left_semi")
    ev = sets.withColumn("at", F.lit(None).cast("bigint")).unionByName(uses.withColumn("n", F.lit(None).cast("bigint")))
    j = carry_forward(ev, ["file", "var"], chunk(), ["line_no"], {"__n": F.col("n")}).where(F.col("at") >= F.col("__n"))
    guard = _guarded(lines, r"\bif\s*\(.*?([A-Za-z_]\w*)\.size\(\)", (".size()",))
    return _out(j.join(guard, ["file", "var", "line_no"], "left_anti"), "Vector Out of Bounds", "High")


# ---- structural rules ------------------------------------------------------------------------
ARRAY_DECL = r"\b(?:int|char|float|double|long|short|unsigned|uint\w*|size_t)\s+([A-Za-z_]\w*)\s*\[\s*(\d+)\s*\]"
ARRAY_USE = r"\b([A-Za-z_]\w*)\s*\[\s*(\d+)\s*\]"


def _live(lines: DataFrame, holds: tuple[str, ...]) -> DataFrame:
    """Lines the structural rules look at: not blank, not a line comment, and with one of ``holds``."""
    t = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    return lines.where(any_of(F.col("raw"), holds)).select("file", "line_no", t.alias("__t")).where((F.col("__t") != "") & ~F.col("__t").startswith("//"))


def array_bounds(lines: DataFrame) -> DataFrame:
    """Constant subscripts checked against the latest earlier declaration of the array (as-of)."""
    live = share(_live(lines, ("[",)))
    decl = live.where(F.col("__t").rlike(ARRAY_DECL)).select("file", "line_no", F.regexp_extract("__t", ARRAY_DECL, 1).alias("var"),
                                                              F.regexp_extract("__t", ARRAY_DECL, 2).try_cast("bigint").alias("size"))
    names, idx = F.regexp_extract_all("__t", F.lit(ARRAY_USE), F.lit(1)), F.regexp_extract_all("__t", F.lit(ARRAY_USE), F.lit(2))
    use = live.where(F.col("__t").rlike(ARRAY_USE)).select("file", "line_no", F.explode(F.arrays_zip(names.alias("v"), idx.alias("i"))).alias("u")) \
        .select("file", "line_no", F.col("u.v").alias("var"), F.col("u.i").try_cast("bigint").alias("at"))
    use = use.join(decl, ["file", "line_no", "var"], "left_anti").join(decl.select("file", "var").distinct(), ["file", "var"], "left_semi")
    ev = decl.withColumn("at", F.lit(None).cast("bigint")).unionByName(use.withColumn("size", F.lit(None).cast("bigint")))
    j = carry_forward(ev, ["file", "var"], chunk(), ["line_no"], {"__size": F.col("size"), "decl_line": F.when(F.col("size").isNotNull(), F.col("line_no"))})
    return j.where(F.col("at") >= F.col("__size")).select("file", "line_no", "var", F.col("at").alias("index"), F.col("__size").alias("size"), "decl_line")


# fixed values: calls that are dangerous under any name
DANGEROUS = {"gets": ("Buffer Overflow", "Critical"), "strcpy": ("Unsafe String Function", "High"), "strcat": ("Unsafe String Function", "High"),
             "sprintf": ("Format String Vulnerability", "High"), "system": ("Command Injection", "Critical")}


def dangerous_calls(lines: DataFrame) -> DataFrame:
    """Dangerous calls by name and through macro aliases; the last definition of an alias wins."""
    live = _live(lines, ("(",))
    called = live.select("file", "line_no", F.explode(F.array_distinct(
        F.regexp_extract_all("__t", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("token"))
    d = r"^\s*#\s*define\s+([A-Za-z_]\w*)\s+([A-Za-z_]\w*)"
    defs = lines.where(F.col("raw").contains("define") & F.regexp_extract("raw", d, 2).isin(*DANGEROUS)).select(
        "file", "line_no", F.regexp_extract("raw", d, 1).alias("token"), F.regexp_extract("raw", d, 2).alias("target"))
    alias = defs.groupBy("file", "token").agg(F.max_by("target", "line_no").alias("target"))
    direct = called.where(F.col("token").isin(*DANGEROUS)).select("file", "line_no", "token", F.col("token").alias("target"), F.lit(False).alias("aliased"))
    via = called.join(alias, ["file", "token"]).select("file", "line_no", "token", "target", F.lit(True).alias("aliased"))
    kind = F.create_map(*[F.lit(x) for k, (n, _) in DANGEROUS.items() for x in (k, n)])
    sev = F.create_map(*[F.lit(x) for k, (_, s) in DANGEROUS.items() for x in (k, s)])
    return direct.unionByName(via).select("file", "line_no", "token", "target", "aliased", kind[F.col("target")].alias("finding_type"), sev[F.col("target")].alias("severity"))


FREE = r"\b(?:free\s*\(\s*([A-Za-z_]\w*)\s*\)|delete\s*(?:\[\])?\s*([A-Za-z_]\w*))\s*;"
DEREF = r"(?:\*\s*([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*->)"


def free_misuse(lines: DataFrame) -> DataFrame:
    """Second frees and uses after the first free, per variable and scope.

    A scope ends at a line that is exactly ``}``; its id is a running count of such lines. A line
    that frees is never a use.
    """
    live = running(_live(lines, ("}", "free", "delete", "*", "->")), ["file"], chunk(), ["line_no"], {"__c": ("sum", (F.col("__t") == "}").cast("bigint"))}).where("__t <> '}'")
    var = F.coalesce(F.nullif(F.regexp_extract("__t", FREE, 1), F.lit("")), F.regexp_extract("__t", FREE, 2))
    frees = live.where(F.col("__t").rlike(FREE)).select("file", "__c", "line_no", var.alias("var"))
    first = frees.groupBy("file", "__c", "var").agg(F.min("line_no").alias("first_line"))
    double = frees.join(first, ["file", "__c", "var"]).where("line_no > first_line").withColumn("finding_type", F.lit("Double Free"))
    names = F.filter(F.concat(F.regexp_extract_all("__t", F.lit(DEREF), F.lit(1)), F.regexp_extract_all("__t", F.lit(DEREF), F.lit(2))), lambda x: x != "")
    uses = live.where(~F.col("__t").rlike(FREE) & F.col("__t").rlike(DEREF)).select("file", "__c", "line_no", F.explode(names).alias("var"))
    after = uses.join(first, ["file", "__c", "var"]).where("line_no > first_line").withColumn("finding_type", F.lit("Use After Free"))
    return double.unionByName(after).select("file", "line_no", "var", "first_line", "finding_type")


# fixed values: resource kinds as (kind, acquire, release, finding)
RESOURCES = (("malloc", r"malloc\(", r"free\(", "Potential Memory Leak"),
             ("new", r"\bnew\s+(?:nothrow\s+)?(?:[A-Za-z_]|::)", r"\bdelete\s*(?:\[\])?\s*[A-Za-z_]", "Potential Memory Leak"),
             ("fopen", r"\b(?:fopen|fopen_s|freopen)\s*\(", r"fclose\(", "File Descriptor Leak"))
NEW_EXEMPT = r"\boperator\s+new\b|\breturn\b.*?\bnew\b|(?:->|\.|\[|\bthis->)\s*.*=\s*(?:[A-Za-z_]\w*::)?new\b"
BARE_NEW = r"^\s*([A-Za-z_]\w*)\s*=\s*(?:[A-Za-z_]\w*::)?new\b"
LOCAL_DECL = (r"^\s*(?:const\s+)?(?:int|char|float|double|long|short|bool|auto|[A-Za-z_]\w*)\s+(?:\*|&)?\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=|[;{])")


def local_vars(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file, line_no, keep, var) of local declarations."""
    return _each(lines.where(~(F.col("code").contains("static") & F.col("code").rlike(r"\bstatic\b"))), LOCAL_DECL, keep=keep).where(
        ~F.col("var").isin("return", "if", "for", "while", "switch", "case", "struct", "class", "namespace"))


def resource_leaks(lines: DataFrame) -> DataFrame:
    """Acquisitions in a scope that no release closes while the scope is open.

    An acquisition belongs to the innermost scope of its line; releases within a scope are counted by running counts at its ends,
    however deep scopes nest. The file level is no scope.
    """
    flags = {k: F.col("code").rlike(a) for k, a, _, _ in RESOURCES}
    flags["new"] = flags["new"] & ~F.col("code").rlike(NEW_EXEMPT)
    acq = lines.where(any_of(F.col("code"), ("malloc(", "new", "open"))).select("file", "line_no", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))).alias("kind"),
                       F.regexp_extract("code", BARE_NEW, 1).alias("var"))
    decl = local_vars(lines).groupBy("file", "var").agg(F.min("line_no").alias("__l"))
    acq = share(acq.join(decl, ["file", "var"], "left").where("kind <> 'new' OR var = '' OR __l < line_no").select("file", "line_no", "kind"))
    rel = lines.where(any_of(F.col("code"), ("free(", "delete", "fclose("))).select("file", "line_no", F.explode(F.array_compact(F.array(*[F.when(F.col("code").rlike(r), F.lit(k)) for k, _, r, _ in RESOURCES]))).alias("kind"))
    held = share(acq.join(innermost_scope(lines, acq), ["file", "line_no"]))
    spans = held.select("file", "kind", "open_line", "open_idx").distinct().join(scopes(lines), ["file", "open_line", "open_idx"])
    kept = count_within(spans, rel, ["file", "kind"], "__rel").where("__rel = 0").select("file", "kind", "open_line", "open_idx")
    kind = F.create_map(*[F.lit(x) for k, _, _, n in RESOURCES for x in (k, n)])
    return _out(held.join(kept, ["file", "kind", "open_line", "open_idx"], "left_semi"), kind[F.col("kind")], "Medium")


def function_findings(lines: DataFrame, fns: DataFrame | None = None) -> DataFrame:
    """Recursion without a base case and addresses of locals that outlive their function."""
    fns = share(fns if fns is not None else with_function(lines.select("file", "line_no", "code"))).where("fn IS NOT NULL").withColumn("body", body_text())
    count = lambda c: F.when(F.trim(c).isin("", "void"), 0).otherwise(F.size(F.split(F.regexp_replace(c, r"\([^()]*\)", ""), ",")))
    own = F.concat(F.lit(r"(?<![A-Za-z0-9_:.>-])"), F.col("fn"), F.lit(r"\s*\(([^;{}]*)\)"))
    arg = F.call_function("regexp_extract", F.col("body"), own, F.lit(1))
    rec = F.rlike(F.col("body"), own) & (count(arg) == count(F.col("fn_params")))
    base = ((any_of(F.col("code"), ("if", "switch", "while", "?")) & F.col("code").rlike(r"\b(?:if|switch|while)\s*\(|\?"))
            | (F.col("code").contains("return") & F.col("code").rlike(r"\breturn\b") & ~F.rlike(F.col("code"), F.concat(F.lit(r"(?<![A-Za-z0-9_:.>-])\b"), F.col("fn"), F.lit(r"\s*\(")))))
    grounded = fns.where(base).select("file", "fn_line").distinct()
    calling = fns.where(F.col("body").contains("(") & F.col("body").contains(F.col("fn")))
    endless = _out(calling.where(rec).join(grounded, ["file", "fn_line"], "left_anti"), "Infinite Recursion", "Critical")
    ret = r"\breturn\s+&\s*([A-Za-z_]\w*)\s*;"
    out = _each(fns, ret, holds=("return",), keep=("fn_line",))
    decl = local_vars(fns, ("fn_line",)).groupBy("file", "fn_line", "var").agg(F.min("line_no").alias("__l"))
    dangling = _out(out.join(decl, ["file", "fn_line", "var"]).where("__l <= line_no"), "Dangling Pointer", "Critical")
    return endless.unionByName(dangling)


def sign_mismatch(lines: DataFrame, fns: DataFrame | None = None) -> DataFrame:
    """Comparisons between a strictly signed and a strictly unsigned variable of the same function."""
    fns = share(fns if fns is not None else with_function(lines.select("file", "line_no", "code"))).withColumn("fl", F.coalesce("fn_line", F.lit(0)))
    u = _each(fns, r"\b(?:unsigned(?:\s+(?:int|char|long|short))?|uint\w*|size_t)\s+([A-Za-z_]\w*)", holds=("unsigned", "uint", "size_t"), keep=("fl",))
    s = _each(fns, r"\b(?:int|long|short)\s+([A-Za-z_]\w*)", holds=("int", "long", "short"), keep=("fl",))
    sign = (u.withColumn("t", F.lit("u")).unionByName(s.withColumn("t", F.lit("s"))).groupBy("file", "fl", "var")
            .agg(F.min(F.when(F.col("t") == "u", F.col("line_no"))).alias("ul"), F.min(F.when(F.col("t") == "s", F.col("line_no"))).alias("sl")))
    p = r"\b([A-Za-z_]\w*)\s*(?:<|<=|>|>=)\s*([A-Za-z_]\w*)\b"
    cmp = fns.where(any_of(F.col("code"), ("<", ">")) & F.col("code").rlike(p) & ~F.col("code").contains("static_cast")).select(
        "file", "fl", "line_no", F.regexp_extract("code", p, 1).alias("a"), F.regexp_extract("code", p, 2).alias("b"))

    def side(df: DataFrame, v: str) -> DataFrame:
        k = sign.select("file", "fl", F.col("var").alias(v), "ul", "sl")
        j = df.join(k, ["file", "fl", v], "left")
        has_u, has_s = F.coalesce(F.col("ul") <= F.col("line_no"), F.lit(False)), F.coalesce(F.col("sl") <= F.col("line_no"), F.lit(False))
        return j.withColumn(f"__{v}", F.when(has_u & ~has_s, "u").when(has_s & ~has_u, "s")).drop("ul", "sl")

    return _out(side(side(cmp, "a"), "b").where("__a <> __b"), "Signed/Unsigned Mismatch", "Medium")


def weakness_parts(lines: DataFrame) -> list[Callable[[], list[DataFrame]]]:
    """Makers of every static finding as (file, line_no, finding_type, severity): a maker per group of rules, a frame per family of rules."""
    def by_function() -> list[DataFrame]:
        fns = share(with_function(lines.select("file", "line_no", "code")))
        return [function_findings(lines, fns), sign_mismatch(lines, fns)]

    def frees() -> list[DataFrame]:
        return [free_misuse(lines).select("file", "line_no", "finding_type", F.lit("High").alias("severity"))]

    alone = (line_findings, assert_findings, proximity_findings, uninitialised_uses, null_uses, arithmetic_uses, vector_bounds, resource_leaks)
    return [*[lambda rule=rule: [rule(lines)] for rule in alone], by_function, frees]


def all_weaknesses(lines: DataFrame) -> DataFrame:
    """Every static finding as (file, line_no, finding_type, severity)."""
    return reduce(DataFrame.unionByName, [frame for make in weakness_parts(lines) for frame in make()])


def weakness_counts(lines: DataFrame) -> DataFrame:
    """(file, finding_type, n) over all static rules.

    Each family is counted and written by itself: as one plan, all of it would be planned again after each of its stages. What a group of
    rules leaves in caches and shuffles goes before the next one starts, so disks hold that of one group at a time.
    """
    per = []
    for make in weakness_parts(lines):
        with scratch(lines.sparkSession):
            per += [cut_lineage(p.groupBy("file", "finding_type").agg(F.count("*").alias("n"))) for p in make()]
    return reduce(DataFrame.unionByName, per).groupBy("file", "finding_type").agg(F.sum("n").alias("n"))
