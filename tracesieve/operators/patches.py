"""Gate and audit of (original, patched) text pairs.

The line difference is a multiset difference: one group-by of (pair, line) with a count per side.
A moved line is no change here, where an alignment diff would count it twice.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import all_matches, bound
from tracesieve.functions.text import SECRET_KINDS, SECRET_WORDS, boundary_leak, has_any, injection_form, split_lines, strip, strip_code, visible_lower
from tracesieve.operators.execution import CODE_HINTS, RAW_HINTS, execution_findings
from tracesieve.operators.scans import NORMAL_RULES, RAW_RULES, RULE_HINTS, rule_hint
from tracesieve.operators.weakness import LINE_RULES
from tracesieve.session import share

# fixed values: standard headers a patch may add
STANDARD_HEADERS = (
    "algorithm", "any", "array", "atomic", "barrier", "bit", "bitset", "charconv", "chrono", "codecvt", "compare", "complex",
    "concepts", "coroutine", "deque", "exception", "execution", "expected", "format", "forward_list", "fstream", "functional",
    "future", "generator", "initializer_list", "iomanip", "ios", "iosfwd", "iostream", "istream", "iterator", "latch", "limits",
    "list", "locale", "map", "mdspan", "memory", "memory_resource", "mutex", "new", "numbers", "numeric", "optional", "ostream",
    "print", "queue", "random", "ranges", "ratio", "regex", "scoped_allocator", "semaphore", "set", "shared_mutex",
    "source_location", "span", "spanstream", "sstream", "stack", "stacktrace", "stdexcept", "stop_token", "streambuf", "string",
    "string_view", "syncstream", "system_error", "tuple", "type_traits", "typeindex", "typeinfo", "unordered_map", "unordered_set",
    "utility", "valarray", "variant", "vector", "version", "cassert", "cctype", "cerrno", "cfenv", "cfloat", "cinttypes", "ciso646",
    "climits", "clocale", "cmath", "csetjmp", "csignal", "cstdarg", "cstdbool", "cstddef", "cstdint", "cstdio", "cstdlib",
    "cstring", "ctgmath", "ctime", "cuchar", "cwchar", "cwctype", "assert.h", "ctype.h", "errno.h", "fenv.h", "float.h",
    "inttypes.h", "iso646.h", "limits.h", "locale.h", "math.h", "setjmp.h", "signal.h", "stdarg.h", "stdbool.h", "stddef.h",
    "stdint.h", "stdio.h", "stdlib.h", "string.h", "tgmath.h", "time.h", "uchar.h", "wchar.h", "wctype.h")
WATCHED_HEADERS = ("filesystem", "thread")
INCLUDE = r'(?m)^\s*#\s*include\s*[<"]([^>"\r\n]+)[>"]'
SUPPRESS = (r"(?i)(?:#\s*pragma\s+GCC\s+diagnostic\s+ignored|#\s*pragma\s+warning\s*\(\s*disable|#\s*define\s+NDEBUG"
            r"|__attribute__\s*\(\s*\(\s*no_sanitize|//\s*NOLINT|-w\b)")
#: Lower-case substrings without one of which nothing is suppressed.
SUPPRESS_HINTS = ("pragma", "ndebug", "no_sanitize", "nolint", "-w")
GUARD = (r"(?i)(?:assert\s*\(|static_assert\s*\(|if\s*\(.*?\)\s*(?:return|exit|abort|throw|break|continue)\b|if\s*\(.*?(?:!=|==)\s*nullptr\)"
         r"|if\s*\(.*?(?:<|<=|>|>=)\s*(?:size\b|len\b|n\b|count\b))")
DOWNGRADES = (("strncpy", "strcpy"), ("strncat", "strcat"), ("snprintf", "sprintf"), ("fgets", "gets"), ("getline", "gets"))
BOUNDED_SCAN, OPEN_SCAN = r"scanf\s*\(\s*[\x22'][^\x22']*%[0-9]+s", r"scanf\s*\(\s*[\x22'][^\x22']*%s"
AI_MIN_LINES, AI_SHARE, OFFLINE_LINES, COMMENT_LIMIT = 10, 0.25, 12, 3
BACKDOORS: tuple[tuple[str, str, str], ...] = (
    ("process_execution", "Critical", r"(?i)\b(?:system|popen|exec[lv]p?|fork|CreateProcess[AW]?|WinExec|ShellExecute[AW]?)\s*\("),
    ("dynamic_loading", "High", r"(?i)\b(?:dlopen|LoadLibrary[AW]?)\s*\("),
    ("obfuscation", "Medium", r"(?i)##\s*[A-Za-z_]"),
    ("network_access", "High", r"(?i)(?:socket|connect|WSAStartup|getaddrinfo)\s*\("),
)


def line_changes(pairs: DataFrame, pid: str) -> DataFrame:
    """(pid, line, was, now): how often each line occurs on both sides."""
    def side(c: str, was: int) -> Column:
        return F.transform(F.coalesce(split_lines(F.col(c)), F.array().cast("array<string>")),
                           lambda l: F.struct(l.alias("line"), F.lit(was).alias("was"), F.lit(1 - was).alias("now")))

    # both sides from one reading of the pair; input dealt out by pair stays where it is
    return pairs.select(pid, F.explode(F.concat(side("original", 1), side("patched", 0))).alias("l")).select(pid, "l.*") \
        .groupBy(pid, "line").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))


def _is_comment(c: Column) -> Column:
    return c.startswith("//") | c.startswith("/*") | c.startswith("*")


def _muted(changes: DataFrame, pid: str) -> DataFrame:
    """(pid, commented_out): removed lines that come back as comments; both reduce to the same body."""
    t, added, removed = F.col("t"), F.col("now") > F.col("was"), F.col("was") > F.col("now")
    body = F.when(t.startswith("//"), F.regexp_replace(t, r"^//+\s*", "")).otherwise(t)
    gone = F.when(~_is_comment(t) & removed, F.col("was") - F.col("now")).otherwise(0)
    back = F.when(t.startswith("//") & added, 1).otherwise(0)
    return (changes.withColumn("t", strip(F.col("line"))).withColumn("b", body).where("b <> ''").groupBy(pid, "b").agg(F.sum(gone).alias("g"), F.max(back).alias("k"))
            .groupBy(pid).agg(F.sum(F.when(F.col("k") == 1, F.col("g")).otherwise(0)).alias("commented_out")))


def change_profile(pairs: DataFrame, pid: str, changes: DataFrame | None = None) -> DataFrame:
    """One row per pair: line counts and the flags that every line rule needs, in one shuffle."""
    c = (changes if changes is not None else line_changes(pairs, pid)).withColumn("t", strip(F.col("line")))
    added, removed = F.col("now") > F.col("was"), F.col("was") > F.col("now")

    def seen(cond: Column) -> Column:
        return F.coalesce(F.bool_or(cond), F.lit(False))

    def names(word: str) -> Column:
        return F.col("line").contains(word) & F.col("line").rlike(rf"\b{word}\b")

    flags = {}
    for i, (safe, bad) in enumerate(DOWNGRADES):
        flags[f"safe_{i}"] = seen(removed & names(safe))
        flags[f"bad_{i}"] = seen(added & names(bad))
        flags[f"had_{i}"] = seen((F.col("was") > 0) & names(safe))
    code_part = F.split_part(F.col("line"), F.lit("//"), F.lit(1))
    per_line = c.groupBy(pid).agg(
        F.sum("was").alias("old_lines"), F.sum("now").alias("new_lines"), F.sum(F.abs(F.col("now") - F.col("was"))).alias("changed"),
        seen(removed & F.col("line").rlike(BOUNDED_SCAN)).alias("safe_scan"), seen(added & F.col("line").rlike(OPEN_SCAN)).alias("bad_scan"),
        F.collect_set(F.when(added & F.col("t").rlike(SUPPRESS), F.lower(F.regexp_extract("t", SUPPRESS, 0)))).alias("suppressions"),
        F.sum(F.when(removed & code_part.rlike(GUARD), F.col("was") - F.col("now")).otherwise(0)).alias("guards_removed"),
        F.sum(F.when(added & code_part.rlike(GUARD), F.col("now") - F.col("was")).otherwise(0)).alias("guards_added"),
        *[seen(added & code_part.rlike(p)).alias(f"door_{n}") for n, _, p in BACKDOORS],
        *[v.alias(k) for k, v in flags.items()])
    trimmed = c.groupBy(pid, "t").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    lost = trimmed.groupBy(pid).agg(F.coalesce(F.bool_or((F.col("was") > 0) & (F.col("now") == 0) & ~_is_comment(F.col("t")) & F.col("t").rlike(GUARD)),
                                               F.lit(False)).alias("guard_lost"))
    return per_line.join(lost, pid).join(_muted(c, pid), pid, "left")


def new_headers() -> Column:
    """Included headers of the patch that the original lacks and that are not standard."""
    def get(c: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(c), F.lit(INCLUDE), F.lit(1)), lambda x: F.trim(x))
    fresh = F.transform(F.array_except(get("patched"), get("original")), lambda x: F.lower(F.trim(F.replace(x, F.lit("\\"), F.lit("/")))))
    return F.filter(fresh, lambda x: ~(x.isin(*STANDARD_HEADERS) | F.regexp_extract(x, r"[^/]*$", 0).isin(*STANDARD_HEADERS)))


def _with_words(pairs: DataFrame, *sides: str) -> DataFrame:
    """Adds the normalised words of texts once, for all rules that read them."""
    return pairs.withColumns({f"__w_{c}": injection_form(F.coalesce(F.col(c), F.lit(""))) for c in sides})


def _rules_hit(side: str) -> dict[str, Column]:
    """Whether each injection rule fires on one side of `_with_words`."""
    out: dict[str, Column] = {}
    for c, rules in ((F.coalesce(F.col(side), F.lit("")), RAW_RULES), (F.col(f"__w_{side}"), NORMAL_RULES)):
        for name, _, p in rules:
            out[name] = out[name] | c.rlike(p) if name in out else c.rlike(p)
    return out


def _new_rules(come: Column, low: Column) -> Column:
    """Whether an injection rule fires on the patch and not on the original.

    Substrings are tried before patterns, and the original is only read for rules that the patch breaks. ``come`` are the differing lines of the
    patch: a payload lies within one line, so a new one is in one of these. ``low`` is `visible_lower` of the patch.
    """
    new, old = (F.coalesce(F.col(c), F.lit("")) for c in ("patched", "original"))
    by_name: dict[str, list[tuple[str, bool]]] = {}
    for rules, words in ((RAW_RULES, False), (NORMAL_RULES, True)):
        for name, _, p in rules:
            by_name.setdefault(name, []).append((p, words))

    def fires(c: Column, forms: list[tuple[str, bool]]) -> Column:
        hit = F.lit(False)
        for p, words in forms:
            hit = hit | (injection_form(c) if words else c).rlike(p)
        return hit

    cond = F.lit(False)
    for name, forms in by_name.items():
        hint = rule_hint(name, low) if name in RULE_HINTS else F.lit(True)
        if name == "hidden_prompt_unicode":
            hint = F.octet_length(new) > F.length(new)
        if name == "encoded_payload":
            hint = fires(come, forms)
        # CASE, as Spark would make texts that several AND and OR share for every row
        cond = cond | F.when(hint, F.when(fires(new, forms), ~fires(old, forms)).otherwise(False)).otherwise(False)
    return cond


def _new_secrets() -> Column:
    new, cond = F.col("patched"), F.lit(False)
    for _, p, _ in SECRET_KINDS:
        start = re.match("[A-Za-z_ -]*", p).group()  # of every match; the pattern of assignments starts with a flag
        hint = new.contains(start) if start else has_any(F.lower(new), SECRET_WORDS)
        cond = cond | (hint & new.rlike(p) & ~F.col("original").rlike(p))
    return cond


def _sides(pairs: DataFrame) -> DataFrame:
    """Adds the lines of both sides (``__o``, ``__p``) and those that differ from the line at the same place of the other side (``__a``, ``__b``; as
    texts ``__ta``, ``__tb``).

    Lines left out stand once on either side, so what remains has the line difference of the whole.
    """
    lines = pairs.withColumns({n: F.coalesce(split_lines(F.col(c)), F.array().cast("array<string>")) for n, c in (("__o", "original"), ("__p", "patched"))})

    def rest(one: str, other: str) -> Column:
        return F.filter(one, lambda x, i: ~x.eqNullSafe(F.get(F.col(other), i)))
    return lines.withColumns({"__a": rest("__o", "__p"), "__b": rest("__p", "__o")}).withColumns({"__ta": F.array_join("__a", "\n"), "__tb": F.array_join("__b", "\n")})


def _danger_lines() -> Column:
    """(raw, s) of `_sides`: lines new in the patch (1) and, where there are any, those of the original (0) that may break an execution rule too."""
    def hinted(x: Column) -> Column:
        return has_any(x, ('"', "'", "/*", *RAW_HINTS, *CODE_HINTS))  # what is stripped may join the rest of a line to a name

    def tagged(lines: Column, s: int) -> Column:
        return F.transform(lines, lambda x: F.struct(x.alias("raw"), F.lit(s).alias("s")))
    some = bound(F.array_except(F.filter("__b", hinted), F.col("__o")),
                 lambda new: F.when(F.size(new) > 0, F.concat(tagged(new, 1), tagged(F.filter("__o", hinted), 0))))
    return F.when(hinted(F.col("__tb")), some)


def _judged_dangers(lines: DataFrame, pid: str) -> DataFrame:
    """(pid, category) of High execution risks of (pid, raw, s) whose evidence no line of the original (s = 0) shows."""
    f = execution_findings(lines.withColumn("code", strip_code(F.col("raw"))), (pid, "s", "raw")).where("severity = 'High'")
    ev = F.lower(strip(F.regexp_replace("raw", r"\s+", " ")))
    g = f.groupBy(pid, "category", ev.alias("ev")).agg(F.min("s").alias("lo"))
    return g.where("lo = 1").select(pid, "category").distinct()


def new_dangers(pairs: DataFrame, pid: str) -> DataFrame:
    """(pid, category) of High execution risks whose evidence is new in the patch; one row per pid."""
    return _judged_dangers(_sides(pairs).select(pid, F.explode(_danger_lines()).alias("l")).select(pid, "l.*"), pid)


def patch_gate(pairs: DataFrame, pid: str) -> DataFrame:
    """(pid, category, severity) of every gate rule a patch breaks.

    pairs: (pid, original, patched, origin), one row per pid; origin 'ai' has the relative size limit. Rules on whole texts, lost guards and
    suppressed diagnostics are judged in the row. Rules that count lines become rows only for pairs whose differing lines could break one.
    """
    d = _sides(pairs)
    allowed = F.when(F.col("origin") == "ai", F.greatest(F.lit(AI_MIN_LINES), F.floor(F.size("__o") * AI_SHARE))).otherwise(F.lit(OFFLINE_LINES)).cast("bigint")
    gone, come = F.col("__ta"), F.col("__tb")
    down = gone.contains("scanf") & come.contains("scanf")
    for safe, bad in DOWNGRADES:
        down = down | (gone.contains(safe) & come.contains(bad))
    unsure = (F.size("__a") + F.size("__b") > allowed) | down | ((F.size("__a") > COMMENT_LIMIT) & come.contains("//") & F.exists("__b", lambda x: strip(x).startswith("//")))

    def guard(t: Column) -> Column:
        return ~_is_comment(t) & t.rlike(GUARD)

    # a guard is lost if no line of the patch is the same but for blanks at its ends
    lost = has_any(F.lower(gone), ("assert", "if")) & (F.size(F.array_except(F.filter(F.transform("__a", strip), guard), F.transform("__p", strip))) > 0)
    # what an added line suppresses is new if the original lacks its text; then the line is no line of the original
    quiet = has_any(F.lower(come), SUPPRESS_HINTS) & F.exists("__b", lambda x: x.rlike(SUPPRESS) & ~F.lower(F.col("original")).contains(F.lower(F.regexp_extract(x, SUPPRESS, 0))))

    def f(cat: str, sev: str) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"))

    heads = F.when(F.col("patched").contains("include"), new_headers())
    j = d.withColumns({"__heads": heads, "__low": visible_lower(F.coalesce(F.col("patched"), F.lit("")))})
    odd, watched = F.filter("__heads", lambda x: ~x.isin(*WATCHED_HEADERS)), F.filter("__heads", lambda x: x.isin(*WATCHED_HEADERS))
    judged = [
        (boundary_leak(F.col("patched")), f("patch_marker_leak", "High")), (F.size(odd) > 0, f("patch_new_include", "High")),
        (F.size(watched) > 0, f("patch_new_include", "Medium")), (lost, f("patch_removes_guard", "High")),
        (quiet, f("patch_suppresses_diagnostics", "High")), (_new_rules(come, F.col("__low")), f("patch_injection_text", "Medium")),
        (_new_secrets(), f("patch_secret", "High"))]
    broken = F.lit(0)  # a bit per rule: conditions inside of array functions would be interpreted
    for i, (cond, _) in enumerate(judged):
        broken = broken + F.when(cond, 1 << i).otherwise(0)
    j = share(j.select(pid, broken.alias("__broken"), _danger_lines().alias("__lines"), F.when(unsure, F.struct("__a", "__b", allowed.alias("allowed"))).alias("__unsure")))
    hits = all_matches([(F.col("__broken").bitwiseAND(F.lit(1 << i)) != 0, what) for i, (_, what) in enumerate(judged)])
    base = j.where("__broken <> 0").select(pid, F.explode(hits).alias("h")).select(pid, "h.category", "h.severity")
    danger = _judged_dangers(j.select(pid, F.explode("__lines").alias("l")).select(pid, "l.*"), pid)
    return base.unionByName(_broken_by_lines(j, pid)).unionByName(danger.select(pid, F.concat(F.lit("patch_introduces_"), "category").alias("category"), F.lit("High").alias("severity")))


def _broken_by_lines(j: DataFrame, pid: str) -> DataFrame:
    """(pid, category, severity) of the gate rules that count differing lines: size, downgrades, code turned into comments."""
    def side(c: str, was: int) -> Column:
        return F.transform(f"__unsure.{c}", lambda x: F.struct(x.alias("line"), F.lit(was).alias("was"), F.lit(1 - was).alias("now")))

    c = j.where("__unsure IS NOT NULL").select(pid, F.col("__unsure.allowed").alias("allowed"), F.explode(F.concat(side("__a", 1), side("__b", 0))).alias("l")) \
        .groupBy(pid, "l.line").agg(F.max("allowed").alias("allowed"), F.sum("l.was").alias("was"), F.sum("l.now").alias("now"))
    line, added, removed = F.col("line"), F.col("now") > F.col("was"), F.col("was") > F.col("now")

    def seen(cond: Column) -> Column:
        return F.bool_or(F.coalesce(cond, F.lit(False)))

    def names(word: str) -> Column:
        return line.contains(word) & line.rlike(rf"\b{word}\b")

    rules = [(removed & names(safe), added & names(bad)) for safe, bad in DOWNGRADES]
    rules.append((removed & line.contains("scanf") & line.rlike(BOUNDED_SCAN), added & line.contains("scanf") & line.rlike(OPEN_SCAN)))
    down = F.lit(False)
    for lost, got in rules:
        down = down | (seen(lost) & seen(got))
    per = c.groupBy(pid).agg((F.sum(F.abs(F.col("now") - F.col("was"))) > F.max("allowed")).alias("large"), down.alias("down"))

    def f(cat: str) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit("High").alias("severity"))

    counted = per.select(pid, F.explode(all_matches([(F.col("large"), f("patch_too_large")), (F.col("down"), f("patch_security_downgrade"))])).alias("h")) \
        .select(pid, "h.category", "h.severity")
    return counted.unionByName(_muted(c, pid).where(F.col("commented_out") > COMMENT_LIMIT)
                               .select(pid, F.lit("patch_comments_out_code").alias("category"), F.lit("Medium").alias("severity")))


def patch_audit(pairs: DataFrame, pid: str) -> DataFrame:
    """(pid, category, severity) of the five adversarial vectors."""
    pairs = share(pairs)
    code = {"__before": strip_code(F.col("original")), "__after": strip_code(F.col("patched"))}
    j = _with_words(pairs, "patched").withColumns(code).join(change_profile(pairs, pid), pid, "left")
    inj = F.lit(False)
    for c in _rules_hit("patched").values():
        inj = inj | c
    down = F.lit(False)
    for i, (safe, _) in enumerate(DOWNGRADES):
        if safe in ("strncpy", "fgets", "snprintf"):
            down = down | (F.col(f"had_{i}") & F.col(f"bad_{i}"))

    def f(cat: str, sev: str) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"))

    # weakness types that occur more often after the patch than before
    before, after = F.col("__before"), F.col("__after")
    grown = [(after.rlike(r.pattern) & (F.regexp_count(after, F.lit(r.pattern)) > F.regexp_count(before, F.lit(r.pattern))),
              f(r.name.lower().replace(" ", "_"), r.severity)) for r in LINE_RULES if r.severity in ("Critical", "High") and r.on == "code" and not r.pattern.startswith("^")]
    hits = all_matches([
        (boundary_leak(F.col("patched")), f("patch_marker_leak", "Critical")), (inj, f("agent_manipulation", "High")),
        *[(F.col(f"door_{n}"), f(n, s)) for n, s, _ in BACKDOORS],
        ((F.col("guards_removed") > F.col("guards_added")) & (F.col("guards_removed") > 0), f("guard_removal", "High")),
        (down, f("patch_security_downgrade", "High")), (F.size("suppressions") > 0, f("patch_suppresses_diagnostics", "High")), *grown])
    return j.select(pid, F.explode(hits).alias("h")).select(pid, "h.category", "h.severity")


# fixed values: what the undefended system refused, as (reason, pattern)
SANITISER: tuple[tuple[str, str], ...] = (
    ("sanitizer:system", r"system\s*\("), ("sanitizer:popen", r"popen\s*\("), ("sanitizer:exec", r"exec\s*\("), ("sanitizer:fork", r"fork\s*\("),
    ("sanitizer:asm", "__asm__|shellcode"), ("sanitizer:sys-include", r'#include\s*[<"]\s*sys/'))
MAIN = r"\b(?:int|void)?\s*main\s*\("


def baseline_reason(kind: Column, payload: Column, original: Column, old_lines: Column, changed: Column, host: Column, origin: Column,
                    method: Column, content_type: Column) -> Column:
    """Why the undefended baseline would refuse a case; 'no defence' when it would not."""
    out = None
    source = kind.isin("USER_SOURCE", "PATCH")
    for reason, p in SANITISER:
        cond = source & payload.rlike(p)
        out = F.when(cond, reason) if out is None else out.when(cond, reason)
    patch = (kind == "PATCH") & (original != "")
    http = kind == "HTTP_REQUEST"
    limit = F.greatest(F.floor(old_lines * 0.40), F.lit(10))
    return (out.when(patch & (F.length(payload) < F.lit(0.60) * F.length(original)), "patch:length")
            .when(patch & original.rlike(MAIN) & ~payload.rlike(MAIN), "patch:main-removed").when(patch & (changed > limit), "patch:line-count")
            .when(http & (host != "") & ~F.lower(F.trim(F.split_part(host, F.lit(":"), F.lit(1)))).isin("localhost", "127.0.0.1", "::1"), "http:foreign-host")
            .when(http & (origin != "") & (origin != "null") & ~(origin.contains("localhost") | origin.contains("127.0.0.1")), "http:foreign-origin")
            .when(http & (F.upper(method) == "POST") & ~F.coalesce(F.lower(content_type).contains("application/json"), F.lit(False)), "http:content-type")
            .otherwise("no defence"))
