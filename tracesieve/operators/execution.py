"""Execution and resource risk of source texts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import all_matches
from tracesieve.functions.text import has_any
from tracesieve.operators.structure import braced, count_within, scopes, with_depth
from tracesieve.session import cut_lineage, share

# fixed values: identifiers that run, load, connect, delete or read the environment
DANGEROUS_NAMES = ("system", "popen", "exec", "execl", "execle", "execlp", "execv", "execve", "execvp", "execvpe", "fexecve",
                   "posix_spawn", "posix_spawnp", "fork", "vfork", "CreateProcess", "CreateProcessA", "CreateProcessW",
                   "ShellExecute", "ShellExecuteA", "ShellExecuteW", "WinExec", "dlopen", "dlsym", "LoadLibrary", "LoadLibraryA",
                   "LoadLibraryW", "GetProcAddress", "socket", "getaddrinfo", "gethostbyname", "inet_addr", "WSAStartup",
                   "curl_easy_init", "remove", "unlink", "rmdir", "rename", "remove_all", "getenv", "_dupenv_s",
                   "GetEnvironmentVariable", "GetEnvironmentVariableA", "GetEnvironmentVariableW")
PROCESS = (r"\b(?:system|popen|execlp|execle|execl|execvpe|execve|execvp|execv|fexecve|exec|posix_spawnp|posix_spawn|vfork|fork"
           r"|CreateProcess[A-Za-z0-9_]*|ShellExecute[A-Za-z0-9_]*|WinExec)\s*\(")
ASM = r"\b(?:__asm__|__asm|_asm|asm)\b"
DYNAMIC = r"\b(?:dlopen|dlsym|LoadLibrary[A-Za-z0-9_]*|GetProcAddress)\s*\("
NETWORK_CALL = r"\b(?:socket|getaddrinfo|gethostbyname|inet_addr|WSAStartup|curl_easy_init)\s*\("
NETWORK_INCLUDE = r'#\s*include\s*[<"](?:sys/socket\.h|netinet/in\.h|arpa/inet\.h|winsock2\.h|curl/curl\.h)[>"]'
FILE_OPEN = r"\b(?:fopen|freopen|open|ifstream|ofstream|fstream)\b|(?:::|\b)filesystem::"
DESTRUCTIVE = r"\b(?:remove|unlink|rmdir|rename|remove_all)\s*\("
ENVIRONMENT = r"\b(?:getenv|_dupenv_s|GetEnvironmentVariable[A-Za-z0-9_]*)\s*\("
#: Substrings without one of which no execution rule can match, by the column that the rules read.
CODE_HINTS = ("system", "popen", "exec", "posix_spawn", "fork", "CreateProcess", "ShellExecute", "WinExec", "asm", "dlopen", "dlsym", "LoadLibrary",
              "GetProcAddress", "socket", "getaddrinfo", "gethostbyname", "inet_addr", "WSAStartup", "curl_easy_init", "open", "stream",
              "remove", "unlink", "rmdir", "rename", "getenv", "_dupenv_s", "GetEnvironmentVariable")
RAW_HINTS = ("define", "include", "constructor", "pragma")
LITERAL = r'"((?:[^"\\]|\\.)*+)"'
STARTUP = r"__attribute__\s*\(\s*\(\s*constructor\s*\)\s*\)|#\s*pragma\s+.*?\b(?:startup|init_seg)\b"
ALIAS = r"^\s*#\s*define\s+([A-Za-z_]\w*)\s+([A-Za-z_]\w*)"
PASTE = r"^\s*#\s*define\s+[A-Za-z_]\w*(?:\([^)]*\))?\s+(.*##.*)$"
ABSOLUTE = r"^(?:[/\\]|[a-zA-Z]:[/\\])"
SENSITIVE_NAMES = (".env", "id_rsa", "passwd", "shadow", ".ssh", ".aws", "credentials")


def execution_findings(lines: DataFrame, keep: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """One row per (line, category, severity). Calls are read from stripped code, path and name
    checks from the literals of the raw line."""
    raw, code = F.col("raw"), F.col("code")
    comment = F.trim(raw).startswith("//")
    lits = F.regexp_extract_all(raw, F.lit(LITERAL), F.lit(1))
    outside = F.exists(lits, lambda x: x.rlike(ABSOLUTE) | x.contains(".."))
    secretive = F.exists(lits, lambda x: F.lower(x).rlike("|".join(n.replace(".", r"\.") for n in SENSITIVE_NAMES)))
    keyed = F.exists(lits, lambda x: x.rlike("(?i)KEY|TOKEN|SECRET|PASSWORD|API"))
    glued = F.regexp_replace(F.regexp_extract(raw, PASTE, 1), r"\s*##\s*", "")
    bad_glue = glued.rlike("|".join(DANGEROUS_NAMES))
    sys_header = F.lower(F.regexp_extract(raw, r"#\s*include\s*<sys/([^>]+)>", 1))

    def f(cat: str, sev: Column | str) -> Column:
        return F.struct(F.lit(cat).alias("category"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"))

    two = lambda cond, low: F.when(cond, F.lit("High")).otherwise(F.lit(low))
    hits = all_matches([
        (~comment & F.regexp_extract(raw, ALIAS, 2).isin(*DANGEROUS_NAMES), f("obfuscation", "High")),
        (~comment & raw.rlike(PASTE), f("obfuscation", two(bad_glue, "Medium"))),
        (code.rlike(PROCESS), f("process_execution", "High")),
        (code.rlike(ASM), f("inline_assembly", "High")),
        (code.rlike(DYNAMIC), f("dynamic_loading", "High")),
        (code.rlike(NETWORK_CALL) | (~comment & raw.rlike(NETWORK_INCLUDE)), f("network_access", "High")),
        (code.rlike(FILE_OPEN) & (outside | secretive), f("sensitive_file_access", "High")),
        (code.rlike(DESTRUCTIVE), f("destructive_file_op", two(outside, "Medium"))),
        (code.rlike(ENVIRONMENT) & keyed, f("secret_env_access", "High")),
        (~comment & raw.rlike(STARTUP), f("startup_code", "Medium")),
        (~comment & (sys_header != "") & (sys_header != "socket.h"), f("unsafe_include", "High")),
        (~comment & raw.rlike(r"#\s*include\s*<unistd\.h>"), f("unsafe_include", "Low")),
    ])
    hint = has_any(code, CODE_HINTS) | has_any(raw, RAW_HINTS)  # most lines end here
    return lines.select(*keep, F.explode(F.when(hint, hits)).alias("h")).select(*keep, "h.category", "h.severity")


def alias_calls(lines: DataFrame) -> DataFrame:
    """Calls through a dangerous macro alias on or after the line that defines it.

    Only the first definition matters for a use, so the alias side is one row per (file, name).
    """
    d = (lines.where(~F.trim(F.col("raw")).startswith("//") & F.regexp_extract("raw", ALIAS, 2).isin(*DANGEROUS_NAMES))
         .groupBy("file", F.regexp_extract("raw", ALIAS, 1).alias("token")).agg(F.min("line_no").alias("__d")))
    c = lines.where(F.col("code").contains("(") & ~F.col("code").rlike(PROCESS)).select("file", "line_no", F.explode(F.array_distinct(
        F.regexp_extract_all("code", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("token"))
    return c.join(d, ["file", "token"]).where("line_no >= __d").select("file", "line_no").distinct() \
        .select("file", "line_no", F.lit("process_execution").alias("category"), F.lit("High").alias("severity"))


def include_closure(edges: DataFrame) -> DataFrame:
    """(file, header, hops): every file reached over include edges (file, header), with the least number of edges.

    Paths double in each round, so rounds grow with the logarithm of the longest chain; cycles close by themselves, as a pair is kept once.
    """
    now, size = cut_lineage(edges.select("file", "header").distinct().withColumn("hops", F.lit(1))), None
    while True:
        on = now.select(F.col("file").alias("header"), F.col("header").alias("next"), F.col("hops").alias("more"))
        longer = now.join(on, "header").select("file", F.col("next").alias("header"), (F.col("hops") + F.col("more")).alias("hops"))
        now = cut_lineage(now.unionByName(longer).groupBy("file", "header").agg(F.min("hops").alias("hops")))
        seen = now.agg(F.count("*"), F.sum("hops")).first()
        if seen == size:
            return now
        size = seen


def next_stops(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(file, stop): the first of ``stops`` (file) at or behind each file, along files that include just one other.

    Every file that includes several others must be a stop. Files without any stop behind them are left out. Pointers double in each round: a
    chain takes as many rounds as its length has binary digits, and a file never has more than one row.
    """
    stops = stops.select("file").distinct()
    one = edges.groupBy("file").agg(F.count("*").alias("__n"), F.min("header").alias("at")).where("__n = 1").select("file", "at")
    mark = stops.select(F.col("file").alias("at"), F.lit(True).alias("there"))
    walk = cut_lineage(one.join(stops, "file", "left_anti").join(mark, "at", "left").select("file", "at", F.coalesce("there", F.lit(False)).alias("there")))
    for _ in range(int(walk.count()).bit_length() + 1):  # a cycle without stops never gets anywhere
        if walk.where("NOT there").isEmpty():
            break
        on = walk.select(F.col("file").alias("at"), F.col("at").alias("next"), F.col("there").alias("next_there"))
        moved = walk.where("NOT there").join(on, "at").select("file", F.col("next").alias("at"), F.col("next_there").alias("there"))
        walk = cut_lineage(walk.where("there").unionByName(moved))
    return stops.select("file", F.col("file").alias("stop")).unionByName(walk.where("there").select("file", F.col("at").alias("stop")))


def reached_targets(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, target): every one of ``targets`` (file) that include edges (file, header) lead to, from files where they branch or that are targets.

    Targets travel backwards over the edges, each pair once, in rounds as long as the longest way; a way back into a cycle finds its pairs known.
    """
    front = cut_lineage(edges.join(targets.select(F.col("file").alias("header")).distinct(), "header", "left_semi")
                        .select("file", F.col("header").alias("target")).distinct())
    known = [front]
    while not front.isEmpty():
        back = edges.select("file", F.col("header").alias("__at"))
        found = back.join(front.withColumnRenamed("file", "__at"), "__at").select("file", "target").distinct()
        for k in known:
            found = found.join(k, ["file", "target"], "left_anti")
        front = cut_lineage(found)
        known.append(front)
        if len(known) > 8:
            known = [cut_lineage(reduce(DataFrame.unionByName, known))]
    return reduce(DataFrame.unionByName, known)


def header_findings(includes: DataFrame, findings: DataFrame, sizes: DataFrame, max_bytes: int | None = None,
                    max_depth: int | None = None) -> DataFrame:
    """Findings of local headers, reported at the first line of the top file that leads to them.

    includes: (file, line_no, header); findings: (file, ...) of every file; sizes: (file, bytes) of the files that exist. All headers
    are followed to any depth unless limits are asked for; each counts once per top file.

    Only headers with findings are carried, from stop to stop: a stop has findings or includes several files, and the files between two stops
    are skipped at once. So the rows are those of the result and of the edges, not all pairs of files. A limit on the depth
    bounds the pairs by itself and needs their lengths, so it goes through `include_closure`.
    """
    findings = share(findings)
    there = (sizes if max_bytes is None else sizes.where(F.col("bytes") <= max_bytes)).select(F.col("file").alias("header"))
    first = cut_lineage(includes.join(there, "header").groupBy("file", "header").agg(F.min("line_no").alias("line_no")))
    if max_depth is not None:
        beyond = include_closure(first.select("file", "header")).withColumnRenamed("file", "via").withColumnRenamed("header", "reached").where(F.col("hops") < max_depth)
        far = first.join(beyond, first["header"] == beyond["via"]).select("file", F.col("reached").alias("header"), "line_no")
        all_ = first.select("file", "header", "line_no").unionByName(far)
    else:
        edges = first.select("file", "header")
        targets = cut_lineage(findings.select("file").distinct())
        branching = edges.groupBy("file").agg(F.count("*").alias("__n")).where("__n > 1").select("file")
        stops = cut_lineage(targets.unionByName(branching).distinct())
        following = cut_lineage(next_stops(edges, stops)).withColumnRenamed("file", "header")
        short = cut_lineage(edges.join(stops, "file", "left_semi").join(following, "header").select("file", F.col("stop").alias("header")).distinct())
        beyond = reached_targets(short, targets).withColumnRenamed("file", "stop")
        near = first.join(following, "header").select("file", "stop", "line_no")
        own = near.join(targets.withColumnRenamed("file", "stop"), "stop", "left_semi").select("file", F.col("stop").alias("header"), "line_no")
        all_ = own.unionByName(near.join(beyond, "stop").select("file", F.col("target").alias("header"), "line_no"))
    reached = all_.where("file <> header").groupBy("file", "header").agg(F.min("line_no").alias("line_no"))
    return reached.join(findings.withColumnRenamed("file", "header").drop("line_no"), "header").select("file", "line_no", "header", "category", "severity")


# ---------------------------------------------------------------------------------------------
# Resource risk. Size limits and type sizes.
MAX_BYTES, MAX_LINE = 2 * 1024 * 1024, 100_000
TYPE_SIZES = {"char": 1, "int8_t": 1, "uint8_t": 1, "bool": 1, "short": 2, "int16_t": 2, "uint16_t": 2, "int": 4, "int32_t": 4,
              "uint32_t": 4, "float": 4, "unsigned": 4, "long": 8, "int64_t": 8, "uint64_t": 8, "double": 8, "size_t": 8}
DEVICES = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])


def size_findings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts over 2 MB (High) and texts with a line over 100 000 characters (Medium)."""
    hits = all_matches([
        (F.octet_length(text) > MAX_BYTES, F.struct(F.lit("oversized_input").alias("category"), F.lit("High").alias("severity"))),
        (F.exists(F.split(text, "\n"), lambda l: F.length(l) > MAX_LINE), F.struct(F.lit("oversized_input").alias("category"), F.lit("Medium").alias("severity")))])
    return texts.select(key, F.explode(hits).alias("h")).select(key, "h.category", "h.severity")


def special_includes(lines: DataFrame) -> DataFrame:
    """Includes of device nodes, virtual files and network shares."""
    target = F.trim(F.regexp_extract("raw", r'#\s*include\s*[<"]([^>"]+)[>"]', 1))
    norm = F.replace(target, F.lit("\\"), F.lit("/"))
    base = F.upper(F.regexp_extract(F.regexp_extract(norm, r"[^/]*$", 0), r"^[^.]*", 0))
    bad = norm.rlike("^/(?:dev|proc|sys)/") | norm.startswith("//") | base.isin(*DEVICES) | F.upper(target).isin(*DEVICES)
    return lines.where(~F.trim(F.col("raw")).startswith("//") & (target != "") & bad).select(
        "file", "line_no", F.lit("special_file_include").alias("category"), F.lit("High").alias("severity"))


# number of elements as a product of literals, with C suffixes
_PRODUCT = r"\s*((?:0x[0-9a-fA-F]+|\d+)[uUlL]*(?:\s*(?:\*|<<)\s*(?:0x[0-9a-fA-F]+|\d+)[uUlL]*)*)\s*"


def _count(expr: Column) -> Column:
    """Value of a product or left-shift chain of integer literals; NULL when it is none."""
    ops = F.regexp_extract_all(expr, F.lit(r"(\*|<<)"), F.lit(1))
    nums = F.transform(F.regexp_extract_all(expr, F.lit(r"(0x[0-9a-fA-F]+|\d+)[uUlL]*"), F.lit(1)),
                       lambda n: F.when(n.startswith("0x"), F.conv(F.substring(n, 3, 40), 16, 10)).otherwise(n).try_cast("double"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit("*")), ops).alias("o"), nums.alias("n"))
    return F.aggregate(pairs, F.lit(1.0), lambda a, p: F.when(p["o"] == "<<", a * F.pow(F.lit(2.0), p["n"])).otherwise(a * p["n"]))


ALLOCATIONS = (
    ("array", r"\b(?!return\b|delete\b|goto\b|else\b|case\b|new\b)([A-Za-z_]\w*)\s+[A-Za-z_]\w*\s*\[" + _PRODUCT + r"\]"),
    ("new", r"\bnew\s+([A-Za-z_]\w*)\s*\[" + _PRODUCT + r"\]"),
    ("vector", r"\bvector\s*<\s*([A-Za-z_]\w*)\s*>\s+[A-Za-z_]\w*\s*\(" + _PRODUCT + r"\)"),
    ("resize", r"(\.)resize\s*\(" + _PRODUCT + r"\)"),
    ("malloc", r"\b(malloc)\s*\(" + _PRODUCT + r"\)"),
)


def huge_allocations(lines: DataFrame) -> DataFrame:
    """Constant allocations of 2^28 elements or 2^30 bytes (malloc: 2^28 bytes) and more."""
    sizes = F.create_map(*[F.lit(x) for kv in TYPE_SIZES.items() for x in kv])
    parts = []
    for name, p in ALLOCATIONS:
        types = F.regexp_extract_all("code", F.lit(p), F.lit(1))
        counts = F.regexp_extract_all("code", F.lit(p), F.lit(2))
        unit = F.lit(1) if name == "malloc" else None

        def entry(z: Column) -> Column:
            size = unit if unit is not None else F.coalesce(F.try_element_at(sizes, z["t"]), F.lit(4))
            return F.struct(F.lit(name).alias("form"), _count(z["n"]).alias("n"), size.alias("unit"))

        parts.append(F.transform(F.arrays_zip(types.alias("t"), counts.alias("n")), entry))
    got = lines.where(F.col("code").rlike("|".join(f"(?:{p})" for _, p in ALLOCATIONS))).select("file", "line_no", F.explode(F.concat(*parts)).alias("a"))
    n, unit = F.col("a.n"), F.col("a.unit")
    big = (n >= float(1 << 28)) | (n * unit >= float(1 << 30))
    return got.where(big).select("file", "line_no", "a.form", n.cast("bigint").alias("elements"), F.lit("huge_allocation").alias("category"), F.lit("High").alias("severity"))


ENDLESS = r"\b(?:while\s*\(\s*(?:true|1)\s*\)|for\s*\(\s*;\s*;\s*\))"
ESCAPE = r"\b(?:break|return|exit|abort|terminate|throw|goto|_Exit|quick_exit)\b"
ESCAPES = ("break", "return", "exit", "abort", "terminate", "throw", "goto", "_Exit")


def endless_loops(lines: DataFrame) -> DataFrame:
    """Endless loop headers whose body has no way out.

    The body is the rest of the header line, or the lines inside the scope that the header opens;
    escapes within it are counted by running counts at its ends.
    """
    endless = (F.col("code").contains("while") | F.col("code").contains("for")) & F.col("code").rlike(ENDLESS)
    tail = F.when(endless, F.regexp_replace("code", "^.*?" + ENDLESS, ""))
    turns = with_depth(lines.where(braced() | endless).select("file", "line_no", "code")).withColumn("__tail", tail)
    heads = share(turns.where("__tail IS NOT NULL").select("file", "line_no", "depth", "depth_after", "__tail"))
    closed = heads.where("depth_after <= depth").where(~F.col("__tail").rlike(ESCAPE))
    opened = heads.where("depth_after > depth").where(~F.col("__tail").rlike(ESCAPE))
    outs = lines.where(has_any(F.col("code"), ESCAPES) & F.col("code").rlike(ESCAPE)).select("file", "line_no")
    spans = scopes(lines).join(opened.select("file", F.col("line_no").alias("open_line")), ["file", "open_line"], "left_semi")
    left = count_within(spans, outs, ["file"], "__n").where("__n > 0").select("file", F.col("open_line").alias("line_no")).distinct()
    kept = closed.select("file", "line_no").unionByName(opened.select("file", "line_no").join(left, ["file", "line_no"], "left_anti"))
    return kept.select("file", "line_no", F.lit("possible_infinite_loop").alias("category"), F.lit("Medium").alias("severity"))


DEFINE = r"^\s*#\s*define\s+([A-Za-z_]\w*)(?:\(([^)]*)\))?\s*(.*)$"
GROWTH_LIMIT, DEEP, WIDE = 1_000_000.0, 8, 4


#: Levels of macros that are resolved between two looks at how many are left.
LEVELS_AT_ONCE = 6


def resolved_macros(macros: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, start, lg, depth) of the macros whose expansion ends: logarithm of the growth, and levels of macros within.

    macros: (file, name, lm); edges: (file, name, ref, w), ref not name. A macro is resolved once all that it refers to are, so macros come by
    topological level, one row each, and a level is one join: lg = lm + sum of w times the lg of the references. Macros on cycles, or that
    lead to one, are never resolved and left out. Lineage is cut, and the rest counted, once in ``LEVELS_AT_ONCE`` levels.
    """
    degree = edges.groupBy("file", "name").agg(F.count("*").alias("refs"))
    base = cut_lineage(macros.select("file", "name", "lm").join(degree, ["file", "name"], "left").na.fill(0, ["refs"]))
    links = edges.select("file", "name", F.col("ref").alias("__ref"), "w")
    done = base.where("refs = 0").select("file", "name", F.col("lm").alias("lg"), F.lit(1).alias("depth"))
    size = -1
    while True:
        for _ in range(LEVELS_AT_ONCE):
            seen = links.join(done.withColumnRenamed("name", "__ref"), ["file", "__ref"]).groupBy("file", "name").agg(
                F.count("*").alias("__n"), F.sum(F.col("w") * F.col("lg")).alias("__more"), F.max("depth").alias("__d"))
            full = base.join(seen, ["file", "name"], "left").where(F.col("refs") == F.coalesce("__n", F.lit(0)))
            done = full.select("file", "name", (F.col("lm") + F.coalesce("__more", F.lit(0.0))).alias("lg"), (F.coalesce("__d", F.lit(0)) + 1).alias("depth"))
        done = cut_lineage(done)
        now = done.count()
        if now == size:
            return done.withColumnRenamed("name", "start")
        size = now


def walked_macros(macros: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(file, start, lg, depth) of ``starts`` (file, start), by following expansion paths step by step.

    Each step carries one row per (start macro, macro reached) with the number of paths, never the paths themselves. Paths that return to
    their start end there; others are followed for as many steps as the file has macros, or ``max_depth``.
    """
    longest = cut_lineage(macros.groupBy("file").agg(F.count("*").alias("macros")))
    links = edges.join(macros.select("file", F.col("name").alias("ref"), "lm"), ["file", "ref"]).select("file", F.col("name").alias("at"), "ref", "w", "lm")
    own = starts.join(macros.select("file", F.col("name").alias("start"), F.col("lm").alias("lg")), ["file", "start"])
    total = own.select("file", "start", "lg", F.lit(1).alias("depth"))
    front = cut_lineage(own.select("file", "start", F.col("start").alias("at"), F.lit(1.0).alias("paths")))
    step = 1
    while (max_depth is None or step < max_depth) and not front.isEmpty():
        step += 1
        front = front.join(longest.where(F.col("macros") >= step), "file", "left_semi")
        front = cut_lineage(front.join(links, ["file", "at"]).where("ref <> start").groupBy("file", "start", F.col("ref").alias("at"), "lm")
                            .agg(F.sum(F.col("paths") * F.col("w")).alias("paths")))
        total = total.unionByName(front.groupBy("file", "start").agg(F.sum(F.col("paths") * F.col("lm")).alias("lg")).withColumn("depth", F.lit(step)))
        front = front.drop("lm")
    return total.groupBy("file", "start").agg(F.sum("lg").alias("lg"), F.max("depth").alias("depth"))


def macro_bombs(lines: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files whose macro definitions expand explosively: (file, growth, depth, fanout, bomb).

    Growth is kept as a logarithm, because a product over expansion paths is a weighted sum. Macros without cycles behind them are resolved
    level by level, one row per macro; only those on or before a cycle are walked from each start. With ``max_depth`` all are walked so far.
    """
    m = lines.where(F.col("raw").rlike(DEFINE)).select(
        "file", "line_no", F.regexp_extract("raw", DEFINE, 1).alias("name"), F.regexp_extract("raw", DEFINE, 2).alias("params"),
        F.regexp_extract("raw", DEFINE, 3).alias("body"))
    last = m.groupBy("file", "name").agg(F.max_by(F.struct("params", "body"), "line_no").alias("d")).select("file", "name", "d.params", "d.body")
    words = F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1))
    par = F.filter(F.transform(F.split("params", ","), lambda p: F.trim(p)), lambda p: p != "")
    mult = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(par, lambda p: F.size(F.filter(F.col("__w"), lambda w: w == p)))), F.lit(1)))
    macros = cut_lineage(last.withColumn("__w", words).select("file", "name", F.col("__w").alias("words"), F.log(mult.cast("double")).alias("lm")))
    edges = cut_lineage(macros.select("file", "name", F.explode("words").alias("ref")).where("ref <> name")
                        .groupBy("file", "name", "ref").agg(F.count("*").cast("double").alias("w"))
                        .join(macros.select("file", F.col("name").alias("ref")), ["file", "ref"], "left_semi"))
    fan = edges.groupBy("file", "name").agg(F.sum("w").alias("fan")).groupBy("file").agg(F.max("fan").alias("fanout"))
    starts = macros.select("file", F.col("name").alias("start"))
    if max_depth is None:
        ended = resolved_macros(macros, edges)
        per = ended.unionByName(walked_macros(macros, edges, starts.join(ended, ["file", "start"], "left_anti")))
    else:
        per = walked_macros(macros, edges, starts, max_depth)
    per = per.groupBy("file").agg(F.max("lg").alias("lg"), F.max("depth").alias("depth"))
    nested = lines.select("file", F.explode(F.regexp_extract_all("raw", F.lit(r"\b([A-Za-z_]\w*)\s*\(\s*\1\b"), F.lit(1))).alias("name")).distinct() \
        .join(macros.select("file", "name"), ["file", "name"]).groupBy("file").agg(F.count("*").alias("nested"))
    j = per.join(fan, "file", "left").join(nested, "file", "left")
    growth = F.col("lg") + F.coalesce("nested", F.lit(0)) * F.log(F.lit(2.0))
    wide = F.coalesce("fanout", F.lit(0.0))
    return j.select("file", F.round(growth / F.log(F.lit(10.0)), 4).alias("log10_growth"), "depth", wide.cast("bigint").alias("fanout"),
                    ((growth >= F.log(F.lit(GROWTH_LIMIT)) - 1e-9) | ((F.col("depth") >= DEEP) & (wide >= WIDE))).alias("bomb"))
