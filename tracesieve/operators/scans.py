"""Text and record scanners. Each takes a table of inputs and returns finding rows:
(input keys, agent, origin, category, severity, line, evidence, action, blocks_on)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions import text as T

def empty_set() -> Column:
    return F.array().cast("array<string>")


def one_purpose(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def count_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


# ---------------------------------------------------------------------------------------------
# Injection rules. Fixed values.
RAW_RULES: tuple[tuple[str, str, str], ...] = (
    ("hidden_prompt_unicode", "High", r"[\x{E0000}-\x{E007F}]"),
    ("encoded_payload", "Medium", r"(?:[A-Za-z0-9+/=]{80,}|[0-9a-fA-F]{80,})"),
    ("role_marker", "Medium", r"(?mid)^\s*(?:system:|assistant:|user:|###)"),
    ("role_marker", "Medium", r"(?i)<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<<SYS>>|</s>"),
)
NORMAL_RULES: tuple[tuple[str, str, str], ...] = (
    ("override_instructions", "High",
     r"\b(?:ignore|disregard|forget|override)\b.{0,40}?\b(?:previous|prior|above|all|any|the|your)\b.{0,40}?"
     r"\b(?:instructions?|rules|policies|policy|guidelines|prompts?|restrictions|safety)\b"),
    ("disable_controls", "High",
     r"\b(?:disable|bypass|skip|turn off|remove|circumvent)\b.{0,40}?"
     r"\b(?:validation|security|sanitizers?|sanitisers?|guards?|filters?|checks?|safety|policy|scans?|scanners?|verifications?)\b"),
    ("mark_safe", "High",
     r"(?:\b(?:mark|label|report|declare|say|tell)\b.{0,60}?"
     r"\b(?:safe|secure|clean|verified|harmless|no issues|no vulnerabilities|no errors)\b"
     r"|\bdo not\b.{0,40}?\b(?:report|flag|mention|warn|log)\b)"),
    ("secret_request", "High",
     r"\b(?:reveal|print|show|output|leak|send|return|display)\b.{0,40}?"
     r"\b(?:api keys?|secrets?|passwords?|tokens?|credentials?|system prompts?|your instructions|environment variables)\b"),
    ("role_hijack", "Medium",
     r"\b(?:you are now|new instructions|system prompt|developer message"
     r"|act as (?:a|an|the) (?:system|admin|administrator|root|assistant|ai|developer)|pretend to be|jailbreak|do anything now)\b"),
)
#: Literals of the lower-cased text without zero-width characters: a rule needs one of each group, an entry of its list being one way to match.
RULE_HINTS: dict[str, tuple[tuple[tuple[str, ...], ...], ...]] = {
    "role_marker": ((("system:", "assistant:", "user:", "###", "<|im_", "inst]", "<<sys>>", "</s>"),),),
    "override_instructions": ((("ignore", "disregard", "forget", "override"),
                               ("instruction", "rules", "polic", "guideline", "prompt", "restriction", "safety")),),
    "disable_controls": ((("disable", "bypass", "skip", "turn", "remove", "circumvent"),
                          ("validation", "security", "saniti", "guard", "filter", "check", "safety", "policy", "scan", "verification")),),
    "mark_safe": ((("mark", "label", "report", "declare", "say", "tell"),
                   ("safe", "secure", "clean", "verified", "harmless", "issues", "vulnerabilities", "errors")),
                  (("not",), ("report", "flag", "mention", "warn", "log"))),
    "secret_request": ((("reveal", "print", "show", "output", "leak", "send", "return", "display"),
                        ("key", "secret", "password", "token", "credential", "prompt", "instructions", "environment")),),
    "role_hijack": ((("you", "instructions", "prompt", "message", "act", "pretend", "jailbreak", "anything"),),),
}
RULE_CATEGORY = {
    "override_instructions": "prompt_injection", "role_hijack": "prompt_injection",
    "disable_controls": "policy_bypass_request", "mark_safe": "policy_bypass_request",
    "secret_request": "secret_exfiltration_request", "hidden_prompt_unicode": "hidden_prompt_unicode",
    "encoded_payload": "encoded_payload", "role_marker": "role_marker",
}


def rule_hint(name: str, low: Column) -> Column:
    """Cheap superset of a rule of `RULE_HINTS`: plain substring tests of the lower-cased text."""
    ways = F.lit(False)
    for groups in RULE_HINTS[name]:
        way = F.lit(True)
        for literals in groups:
            way = way & T.has_any(low, literals)
        ways = ways | way
    return ways


def injection_counts(text: Column) -> dict[str, Column]:
    """Number of hits per rule."""
    norm = T.injection_form(text)
    out: dict[str, Column] = {}
    for name, _, p in RAW_RULES:
        n = F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
        out[name] = out[name] + n if name in out else n
    for name, _, p in NORMAL_RULES:
        out[name] = F.size(F.regexp_extract_all(norm, F.lit(p), F.lit(0)))
    return out


def has_injection(text: Column) -> Column:
    norm = T.injection_form(text)
    hit = F.lit(False)
    for _, _, p in RAW_RULES:
        hit = hit | text.rlike(p)
    for _, _, p in NORMAL_RULES:
        hit = hit | norm.rlike(p)
    return F.coalesce(hit, F.lit(False))


def _raw_lines(text: Column, p: str) -> Column:
    """Line of every match: breaks before it in the pieces and in the earlier matches."""
    m = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), count_breaks)
    parts = F.transform(F.split(text, p), count_breaks)
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + x)
    return F.transform(m, lambda _, i: F.lit(1) + total(F.slice(parts, F.lit(1), i + 1)) + total(F.slice(m, F.lit(1), i)))


def injection_hits(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per hit: (keep, rule, severity, line). Texts without any hit are dropped first."""
    t = F.col(text)
    cleaned = F.lower(F.regexp_replace(t, r"[\x{200B}-\x{200F}\x{FEFF}]", ""))
    norm = T.injection_form(t)

    def entry(name: str, sev: str, lines: Column) -> Column:
        return F.transform(lines, lambda l: F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"), l.cast("int").alias("line")))

    groups = [entry(n, s, _raw_lines(t, p)) for n, s, p in RAW_RULES]
    for n, s, p in NORMAL_RULES:
        words = F.transform(F.regexp_extract_all(norm, F.lit(p), F.lit(0)), lambda m: F.split_part(F.trim(m), F.lit(" "), F.lit(1)))
        at = F.transform(words, lambda w: F.lit(1) + count_breaks(t.substr(F.lit(1), F.greatest(F.instr(cleaned, w) - 1, F.lit(0)))))
        groups.append(entry(n, s, at))
    return (df.where(has_injection(t)).select(*keep, F.explode(F.concat(*groups)).alias("h"))
            .select(*keep, "h.rule", "h.severity", "h.line"))


def prompt_findings(df: DataFrame, text: str, kind: str, purpose: str, keep: list[str]) -> DataFrame:
    """Injection findings, only for text about to be sent out. A user hint makes every hit High
    and blocking; otherwise High hits block and Medium ones warn."""
    src = df.where((F.col(purpose) == "ai_send") & F.col(kind).isin("USER_SOURCE", "COMPILER_OUTPUT", "USER_HINT"))
    hits = injection_hits(src, text, [*keep, kind, text])
    table = F.create_map(*[F.lit(x) for kv in RULE_CATEGORY.items() for x in kv])
    strong = (F.col(kind) == "USER_HINT") | (F.col("severity") == "High")
    line = F.try_element_at(F.split(F.col(text), T.LINE_BREAK), F.col("line"))
    return hits.select(
        *keep, F.lit("prompt").alias("agent"), F.lit("attack").alias("origin"), table[F.col("rule")].alias("category"),
        F.when(strong, "High").otherwise("Medium").alias("severity"), "line",
        T.redact(F.coalesce(line, F.col(text)), None).alias("evidence"),
        F.when(strong, "block").otherwise("warn").alias("action"),
        F.when(strong, one_purpose("ai_send")).otherwise(empty_set()).alias("blocks_on"))


def line_contexts(text: Column) -> Column:
    """Array per line: 'comment', 'string literal' or 'code', by what the line contains."""
    tokens = F.regexp_extract_all(text, F.lit(T._CODE_TOKEN), F.lit(1))
    marked = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^/[/*]"), F.regexp_replace(t, "[^\n]", "\x01"))
                                      .when(t.rlike("^(?:[\x22']|(?:u8|[uUL])?R\x22)"), F.regexp_replace(t, "[^\n]", "\x02"))
                                      .otherwise(t)), "")
    return F.transform(F.split(marked, "\n"), lambda l: F.when(l.contains("\x01"), F.lit("comment"))
                       .when(l.contains("\x02"), F.lit("string literal")).otherwise(F.lit("code")))


# ---------------------------------------------------------------------------------------------
# Output rules. Fixed values.
TAG = r"<[A-Za-z/!][^>]*>?"
SCHEME = r"(?i)(?:javascript|vbscript|data:text/html|file):"
SPOOFED = (r"(?i)\b(?:compilation successful|compiled successfully|no errors|0 errors|security scan clean"
           r"|no issues detected|all checks passed)\b")
TERMINAL = r"\x1B|[\r\x08]"


def output_findings(df: DataFrame, text: str, kind: str, keep: list[str]) -> DataFrame:
    """At most one finding per category and shown text; never blocks, display is neutralised."""
    t = F.col(text)
    scheme, tag = t.rlike(SCHEME), t.rlike(TAG)

    def f(cat: str, sev: Column, ev: Column) -> Column:
        return F.struct(F.lit(cat).alias("category"), sev.alias("severity"), ev.alias("evidence"))

    hits = F.array_compact(F.array(
        F.when(scheme | tag, f("display_injection", F.when(scheme, F.lit("High")).otherwise(F.lit("Medium")),
                               T.redact(F.when(scheme, F.regexp_extract(t, SCHEME, 0)).otherwise(F.regexp_extract(t, TAG, 0)), None))),
        F.when(t.rlike(TERMINAL), f("terminal_escape", F.lit("Medium"), F.lit("terminal escape sequence"))),
        F.when(t.rlike(SPOOFED), f("spoofed_status", F.lit("Medium"), F.regexp_extract(t, SPOOFED, 0))),
        F.when(t.rlike(T.HIDDEN), f("hidden_unicode", F.lit("Medium"),
                                    F.format_string("U+%04X", F.ascii(F.regexp_extract(t, T.HIDDEN, 0)))))))
    shown = df.where(F.col(kind).isin("COMPILER_OUTPUT", "AI_RESPONSE")
                     & (scheme | t.rlike(f"{TAG}|{TERMINAL}|{T.HIDDEN}") | t.rlike(SPOOFED)))
    return shown.select(*keep, F.explode(hits).alias("h")).select(
        *keep, F.lit("output").alias("agent"), F.lit("attack").alias("origin"), "h.category", "h.severity",
        F.lit(1).alias("line"), "h.evidence", F.lit("warn").alias("action"), empty_set().alias("blocks_on"))


def hidden_characters(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every hidden character of a source text with line, column and code point."""
    lines = T.explode_lines(df.where(F.col(text).rlike(T.HIDDEN)), text, *keep).where(F.col("line").rlike(T.HIDDEN))
    chars = lines.select(*keep, "line_no", F.posexplode(F.split("line", "")).alias("p", "ch"))
    return chars.where(F.col("ch").rlike(T.HIDDEN)).select(
        *keep, F.col("line_no").alias("line"), (F.col("p") + 1).alias("column"),
        F.format_string("U+%04X", F.ascii("ch")).alias("code_point"))


# ---------------------------------------------------------------------------------------------
def secret_findings(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One finding per (line, secret kind)."""
    lines = T.explode_lines(df.where(T.secret_hint(F.col(text))), text, *keep).where(T.holds_secret(F.col("line")))
    hits = F.array_compact(F.array(*[
        F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity")))
        for k, p, s in T.SECRET_KINDS]))
    return lines.select(*keep, F.col("line_no").alias("line"), "line", F.explode(hits).alias("h")) \
        .toDF(*keep, "line", "__text", "h") \
        .select(*keep, F.lit("secret").alias("agent"), F.lit("attack").alias("origin"), F.lit("hardcoded_secret").alias("category"),
                "h.severity", "line", T.redact(F.col("__text"), None).alias("evidence"),
                F.when(F.col("h.severity") == "High", "block").otherwise("warn").alias("action"),
                F.lit(None).cast("array<string>").alias("blocks_on"), F.col("h.kind").alias("kind"))


# ---------------------------------------------------------------------------------------------
# Request screen. Fixed values.
MAX_BODY = 512_000
MAX_CODE_CHARS = 200_000
LOOPBACK = ("localhost", "127.0.0.1")


def header_problems(h, method: Column, port: int | None, token: str | None) -> Column:
    """Array of (category, status) of a request's headers; ``h(name)`` gives a header or NULL."""
    hosts = [*LOOPBACK, *([f"{x}:{port}" for x in LOOPBACK] if port is not None else [])]
    host, origin = F.lower(F.trim(h("host"))), F.trim(h("origin"))
    o_host = F.lower(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    o_port = F.nullif(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/:?#]*:(\d+)", 1), F.lit("")).cast("int")
    wrong_port = F.lit(False) if port is None else F.when(o_port.isNotNull(), o_port != port).otherwise(F.lit(port not in (80, 443)))
    post = F.upper(method) == "POST"
    length = h("content-length")
    n = F.regexp_extract(F.trim(length), r"^([+-]?\d+)$", 1)
    number = n.try_cast("bigint")

    def p(cat: str, status: int) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(status).alias("status"))

    base = F.split_part(F.coalesce(h("content-type"), F.lit("")), F.lit(";"), F.lit(1))
    bad_token = F.lit(True) if token is None else F.coalesce(h("x-guard-token") != token, F.lit(True))
    return F.array_compact(F.array(
        F.when((host != "") & ~host.isin(*hosts), p("bad_host", 403)),
        F.when(origin.isNotNull() & ((F.lower(origin) == "null") | ~o_host.isin(*LOOPBACK) | wrong_port), p("bad_origin", 403)),
        F.when((F.trim(h("sec-fetch-site")) != "") & ~F.lower(F.trim(h("sec-fetch-site"))).isin("same-origin", "none"), p("cross_site_request", 403)),
        F.when(F.lower(F.trim(h("sec-fetch-dest"))).isin("iframe", "frame", "embed", "object"), p("cross_site_request", 403)),
        F.when(post & h("transfer-encoding").isNotNull(), p("unsupported_encoding", 400)),
        F.when(post & (F.lower(F.trim(base)) != "application/json"), p("bad_content_type", 415)),
        F.when(post & length.isNull(), p("missing_length", 411)),
        F.when(post & length.isNotNull() & ((n == "") | (number < 0)), p("bad_length", 400)),
        F.when(post & ((number > MAX_BODY) | ((n != "") & number.isNull())), p("body_too_large", 413)),
        F.when(post & bad_token, p("bad_token", 403))))


def body_problem(body: Column) -> Column:
    """'bad_json', 'bad_body' or NULL: the body must be an object with a usable string 'code'."""
    v = F.try_parse_json(F.coalesce(body, F.lit("")))
    code_v = F.try_variant_get(v, "$.code", "variant")
    code = F.try_variant_get(v, "$.code", "string")
    is_text = F.coalesce(F.schema_of_variant(code_v) == "STRING", F.lit(False))
    return (F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "bad_json")
            .when(~is_text | (F.length(code) > MAX_CODE_CHARS) | code.contains("\x00"), "bad_body"))
