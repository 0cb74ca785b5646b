"""Parsing, normalising and labelling of log lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions import text as T
from tracesieve.operators import diagnostics as D
from tracesieve.operators import explain as X
from tracesieve.operators import labels as L
from tracesieve.plans.derived import CODE_LINES, FILES_SQL, LOG_LINES, LOGS_SQL, case_text, code_lines, line_chunk, log_lines
from tracesieve.plans.registry import Tables, query
from tracesieve.plans.sqltext import STRIP, any_sql, case_sql, in_sql, q

FULL_SQL = r"'^(.+?):(\d+)(?::(\d+))?:\s*(error|warning|note):\s*(.*)$'"
RAW = STRIP.format("line")

# Single-line diagnostics and linker blocks of every log.
PARSED_SQL = f"""
WITH {LOGS_SQL},
ev AS (SELECT *, contains(line, '{D.BLOCK_OPEN}') AS o,
         CASE WHEN contains(line, '{D.BLOCK_CLOSE}') THEN 'c' WHEN contains(line, '{D.BLOCK_OPEN}') THEN 'o' END AS e FROM logs),
st AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'o', false) AS inside FROM ev),
bl AS (SELECT *, CASE WHEN inside OR o THEN sum(CASE WHEN o AND NOT inside THEN 1 ELSE 0 END)
         OVER (PARTITION BY file ORDER BY line_no) END AS block FROM st),
parsed AS (
  SELECT file, line_no, regexp_extract(r, {FULL_SQL}, 1) AS file_name, CAST(regexp_extract(r, {FULL_SQL}, 2) AS INT) AS line,
    CAST(nullif(regexp_extract(r, {FULL_SQL}, 3), '') AS INT) AS "column", regexp_extract(r, {FULL_SQL}, 4) AS severity,
    {STRIP.format(f"regexp_extract(r, {FULL_SQL}, 5)")} AS message
  FROM (SELECT file, line_no, {RAW} AS r FROM bl WHERE block IS NULL) WHERE regexp_matches(r, {FULL_SQL})
  UNION ALL
  SELECT file, min(line_no), NULL, NULL, NULL, 'linker', string_agg({RAW}, chr(10) ORDER BY line_no)
  FROM bl WHERE block IS NOT NULL GROUP BY file, block)
"""


def parsed(t: Tables) -> DataFrame:
    return D.parse_log(log_lines(t.lineitem), ["file"], line_chunk())


@query("parsed_diagnostics", PARSED_SQL + "SELECT * FROM parsed")
def parsed_diagnostics(t: Tables) -> DataFrame:
    """Typed diagnostic rows and linker blocks."""
    return parsed(t).drop("raw")


@query("driver_diagnostics", f"""
WITH {LOGS_SQL}, r AS (SELECT file, line_no, {RAW} AS raw FROM logs),
p AS (SELECT '^(.+?):(\\d+):(\\d+):\\s*(fatal error|error|warning):\\s*(.*)$' AS re)
SELECT file, line_no, regexp_extract(raw, re, 1) AS file_name, CAST(regexp_extract(raw, re, 2) AS INT) AS line,
  CAST(regexp_extract(raw, re, 3) AS INT) AS "column",
  CASE regexp_extract(raw, re, 4) WHEN 'fatal error' THEN 'error' ELSE regexp_extract(raw, re, 4) END AS severity,
  {STRIP.format("regexp_extract(raw, re, 5)")} AS message
FROM r, p WHERE regexp_matches(raw, re)""".replace("regexp_extract(raw, re,", "regexp_extract(raw, '^(.+?):(\\d+):(\\d+):\\s*(fatal error|error|warning):\\s*(.*)$',"))
def driver_diagnostics(t: Tables) -> DataFrame:
    """Layout with mandatory column; fatal errors fold into errors."""
    return D.parse_driver(log_lines(t.lineitem), ["file"]).drop("raw")


CORPUS_RE = r"'^[^\s:][^:]*:\d+(?::\d+)?:\s*(error|warning|note|fatal error):\s*(.+)$'"
CORPUS_SQL = f"""
WITH {LOGS_SQL},
c AS (SELECT file, line_no, regexp_extract(r, {CORPUS_RE}, 1) AS severity, {STRIP.format(f"regexp_extract(r, {CORPUS_RE}, 2)")} AS m
      FROM (SELECT file, line_no, {RAW} AS r FROM logs) WHERE regexp_matches(r, {CORPUS_RE})),
corpus AS (SELECT file, line_no, severity, {STRIP.format("regexp_replace(m, '^\\s*(error|warning|fatal error):\\s*', '', 'i')")} AS message
      FROM c WHERE severity <> 'note' AND NOT regexp_matches(m, '^\\s*\\^') AND length({STRIP.format("regexp_replace(m, '^\\s*(error|warning|fatal error):\\s*', '', 'i')")}) >= 4)
"""


def corpus(t: Tables) -> DataFrame:
    return D.parse_corpus(log_lines(t.lineitem), ["file"]).drop("raw")


@query("corpus_messages", CORPUS_SQL + f""" SELECT severity, message,
  {case_sql([(f"regexp_matches(message, {q('(?i)' + '|'.join(p))})", c) for c, p in L.CORPUS_RULES], 'other')} AS category,
  CAST(count(*) AS BIGINT) AS n FROM corpus GROUP BY 1, 2, 3""")
def corpus_messages(t: Tables) -> DataFrame:
    """Training-corpus messages with their rule label and frequency."""
    return (corpus(t).groupBy("severity", "message").agg(F.count("*").alias("n"))
            .withColumn("category", L.corpus_label(F.col("message"))))


PORT_RE = r"'^(?:[A-Za-z]:)?[^:\r\n]+:\d+(?::\d+)?: (?:fatal )?(error|warning|note): (.*)$'"
REF_RE = r"""'undefined reference to [''`"]?([^''"\n]+)[''`"]?'"""


@query("first_diagnostic", f"""
WITH {LOGS_SQL}, r AS (SELECT file, line_no, {RAW} AS raw FROM logs),
c AS (SELECT file, line_no, raw,
   CASE WHEN contains(raw, 'undefined reference to') THEN 'undefined reference to ''' ||
     CASE WHEN regexp_extract(raw, {REF_RE}, 1) = '' THEN 'symbol' ELSE regexp_extract(raw, {REF_RE}, 1) END || ''''
   ELSE regexp_extract(raw, {PORT_RE}, 2) END AS message,
   row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn
  FROM r WHERE contains(raw, 'undefined reference to')
     OR (regexp_matches(raw, {PORT_RE}) AND regexp_extract(raw, {PORT_RE}, 1) <> 'note'))
SELECT file, line_no, raw, message FROM c WHERE rn = 1""")
def first_diagnostic(t: Tables) -> DataFrame:
    """First error, warning or undefined reference of each log."""
    return D.first_diagnostic(log_lines(t.lineitem), ["file"])


_PAIR = f"{case_text(LOG_LINES)} || chr(10) || {case_text(LOG_LINES, '(k + 3)')}"


@query("find_all_messages", f"""
WITH {FILES_SQL}, x AS (SELECT unnest(regexp_extract_all({_PAIR}, '(?m):\\s*(?:error|fatal error|warning):\\s*(.+)$', 1)) AS m FROM numbered),
y AS (SELECT {STRIP.format("regexp_replace(" + STRIP.format("m") + ", '\\[-W[^\\]]+\\]', '', 'g')")} AS message FROM x)
SELECT message, CAST(count(*) AS BIGINT) AS n FROM y WHERE length(message) > 4 GROUP BY 1""")
def find_all_messages(t: Tables) -> DataFrame:
    """Messages found anywhere in multi-line texts, flags removed."""
    texts = log_lines(t.lineitem).select("file", F.expr(_PAIR).alias("text"))
    return D.find_all(texts, "text", "file").groupBy("message").agg(F.count("*").alias("n"))


@query("source_context", PARSED_SQL + f""",
 codel AS (SELECT file, line_no, {case_text(CODE_LINES)} AS raw FROM numbered)
SELECT p.file, p.line_no, p.line, CAST(min(c.line_no) AS BIGINT) AS start_line, string_agg(c.raw, chr(10) ORDER BY c.line_no) AS context
FROM (SELECT * FROM parsed WHERE severity = 'error') p JOIN codel c ON c.file = p.file AND c.line_no BETWEEN p.line - 2 AND p.line + 2
GROUP BY 1, 2, 3""")
def source_context(t: Tables) -> DataFrame:
    """Two source lines on each side of every error."""
    errors = parsed(t).where("severity = 'error'").select("file", "line_no", "line")
    return D.source_context(errors, code_lines(t.lineitem), "file")


@query("log_status", PARSED_SQL + f"""
SELECT file, errors, warnings, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'success' END AS status
FROM (SELECT l.file, CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (severity = 'warning'
   AND NOT {any_sql('lower(message)', D.QUIET_WARNINGS)}) AS BIGINT) AS warnings
  FROM (SELECT DISTINCT file FROM logs) l LEFT JOIN parsed p ON p.file = l.file GROUP BY 1)""")
def log_status(t: Tables) -> DataFrame:
    """Visible error and warning counts and overall status per log."""
    logs = log_lines(t.lineitem).select("file").distinct()
    return D.log_status(parsed(t), logs, ["file"])


@query("diagnostic_order", PARSED_SQL + f"""
SELECT file, severity, message, line, CAST(row_number() OVER (PARTITION BY file ORDER BY pr, coalesce(line, 0), line_no) AS INT) AS place FROM (
 SELECT *, CASE WHEN {any_sql('lower(message)', ['no return statement', 'return-type'])} OR severity = 'error' THEN 0
   WHEN contains(lower(message), 'statement has no effect') THEN 2 ELSE 1 END AS pr FROM parsed
 WHERE NOT (severity = 'warning' AND {any_sql('lower(message)', D.QUIET_WARNINGS)}))""")
def diagnostic_order(t: Tables) -> DataFrame:
    """Visible diagnostics of each log in display order."""
    return D.display_order(parsed(t), ["file"]).select("file", "severity", "message", "line", "place")


# ---- normal forms and labels over the distinct messages -------------------------------------
MSG_SQL = PARSED_SQL.rstrip() + ", msgs AS (SELECT DISTINCT message FROM parsed)\n"


def messages(t: Tables) -> DataFrame:
    """Distinct messages: everything below is a function of the text, so dedupe comes first."""
    return parsed(t).select("message").distinct()


def _dataset_sql(c: str) -> str:
    for pattern, name in T.TOKEN_NAMES:
        c = f"regexp_replace({c}, {q(T._java(pattern))}, {q(name)}, 'gi')"
    return STRIP.format(f"regexp_replace({c}, ' {{2,}}', ' ', 'g')")


@query("message_normalised", MSG_SQL + f"SELECT message, {_dataset_sql('message')} AS normal FROM msgs")
def message_normalised(t: Tables) -> DataFrame:
    """Dataset normal form of each message."""
    return messages(t).withColumn("normal", T.dataset_form(F.col("message")))


_TOK = STRIP.format("tk")
_WORDS = rf"regexp_extract_all({_TOK}, '[a-zA-Z_]\w*|[*&]+')"
_KEPT = "[" + ", ".join(q(k) for k in T.KEPT_TOKENS) + "]"
_MASK = rf"""CASE WHEN starts_with({_TOK}, '-W') OR starts_with({_TOK}, 'std::') OR list_contains({_KEPT}, {_TOK})
   OR regexp_matches({_TOK}, '{"|".join(T.KEPT_FRAGMENTS)}')
   OR (len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda w: NOT list_contains({_KEPT}, w))) = 0) THEN '''' || {_TOK} || ''''
  WHEN len({_WORDS}) >= 2 AND len(list_filter({_WORDS}[1:len({_WORDS}) - 1], lambda w: NOT list_contains({_KEPT}, w))) = 0
    THEN '''' || array_to_string({_WORDS}[1:len({_WORDS}) - 1], ' ') || ' <ID>''' ELSE '''<ID>''' END"""
# The quoted tokens are masked one row per token, then joined back in order.
CLASSIFIER_SQL = MSG_SQL.rstrip() + rf""",
pre AS (SELECT message, regexp_replace({STRIP.format('message')}, '{T.LOCATION_PREFIX}', '') AS m0 FROM msgs),
hex AS (SELECT message, m0, regexp_replace(m0, '\b0x[0-9a-fA-F]+\b', '<ADDR>', 'g') AS m FROM pre),
cut AS (SELECT message, m0, string_split_regex(m, '[''`]([^''`\n]+)[''`]') AS between, regexp_extract_all(m, '[''`]([^''`\n]+)[''`]', 1) AS toks FROM hex),
pieces AS (SELECT message, m0, unnest(range(1, len(between) + 1)) AS i, unnest(between) AS b, unnest(list_concat(toks, [NULL])) AS tk FROM cut),
masked AS (SELECT message, m0, string_agg(b || CASE WHEN tk IS NULL THEN '' ELSE {_MASK} END, '' ORDER BY i) AS m FROM pieces GROUP BY 1, 2),
num AS (SELECT message, m0, regexp_replace(regexp_replace(m, '(^|[^A-Za-z0-9_-])\d+($|[^A-Za-z0-9_-])', '\1<NUM>\2', 'g'),
   '(^|[^A-Za-z0-9_-])\d+($|[^A-Za-z0-9_-])', '\1<NUM>\2', 'g') AS m FROM masked),
classified AS (SELECT message, CASE WHEN contains(m0, 'undefined reference to') THEN
   CASE WHEN {in_sql("regexp_extract(m0, 'undefined reference to [''`]?([^''`(]+)', 1)", T.KEPT_TOKENS)}
     THEN 'undefined reference to ''' || regexp_extract(m0, 'undefined reference to [''`]?([^''`(]+)', 1) || '''' ELSE 'undefined reference to ''<ID>''' END
   ELSE {STRIP.format(chr(39).join(["regexp_replace(m, ", "\\s+", ", ", " ", ", ", "g", ")"]))} END AS normal FROM num)
"""


@query("classifier_normalised", CLASSIFIER_SQL + "SELECT message, normal FROM classified")
def classifier_normalised(t: Tables) -> DataFrame:
    """Classifier normal form of each message."""
    return messages(t).withColumn("normal", T.classifier_form(F.col("message")))


def _rx(p: str, i: int | None = None) -> str:
    return f"regexp_matches(m, {q(p)}, 'i')" if i is None else f"regexp_extract(m, {q(p)}, {i}, 'i')"


_E = r"^expected\s+('.*?')\s*(after|before)?\s*(.*)"
_TK = f"regexp_replace({_rx(_E, 1)}, '^[''\"]+|[''\"]+$', '', 'g')"
_NAMED = f"(CASE WHEN regexp_matches({_TK}, '^[aeiouAEIOU]') THEN 'an ''' ELSE 'a ''' END || {_TK} || '''')"
_CTX = STRIP.format(_rx(_E, 3))


READABLE_SQL = f"""CASE WHEN m = '' THEN ''
 WHEN {_rx(_E)} AND {_rx(_E, 2)} <> '' AND {_CTX} <> '' THEN 'The compiler expected ' || {_NAMED} || ' ' || {_rx(_E, 2)} || ' ' || {_CTX} || '.'
 WHEN {_rx(_E)} AND {_CTX} <> '' THEN 'The compiler expected ' || {_NAMED} || ' (' || {_CTX} || ').'
 WHEN {_rx(_E)} THEN 'The compiler expected ' || {_NAMED} || '.'
 WHEN {_rx(r"^'(.+?)'\s+was not declared in this scope")} THEN '''' || {_rx(r"^'(.+?)'\s+was not declared in this scope", 1)} || ''' was used but has not been declared in this scope.'
 WHEN {_rx("^use of undeclared identifier '(.+?)'")} THEN 'The identifier ''' || {_rx("^use of undeclared identifier '(.+?)'", 1)} || ''' was used before it was declared.'
 WHEN {_rx(r"^(cannot convert|invalid conversion)\s+(?:from\s+)?'(.+?)'\s+to\s+'(.+?)'")} THEN 'A value of type ''' || {_rx(r"^(cannot convert|invalid conversion)\s+(?:from\s+)?'(.+?)'\s+to\s+'(.+?)'", 2)} || ''' cannot be used where ''' || {_rx(r"^(cannot convert|invalid conversion)\s+(?:from\s+)?'(.+?)'\s+to\s+'(.+?)'", 3)} || ''' is required.'
 WHEN {_rx("^no matching function for call to '(.+?)'")} THEN 'No overload of ''' || {_rx("^no matching function for call to '(.+?)'", 1)} || ''' matches the arguments you provided. Check the function signature and argument types.'
 WHEN {_rx("^(redeclaration|redefinition) of '(.+?)'")} THEN '''' || {_rx("^(redeclaration|redefinition) of '(.+?)'", 2)} || ''' has already been ' || CASE lower({_rx("^(redeclaration|redefinition) of '(.+?)'", 1)}) WHEN 'redeclaration' THEN 'declared again' ELSE 'defined again' END || ' in this scope.'
 WHEN {_rx("^'(.+?)' has not been declared")} THEN '''' || {_rx("^'(.+?)' has not been declared", 1)} || ''' is referenced but has not been declared.'
 WHEN {_rx("return.*type|cannot.*return")} THEN 'The return value does not match the function''s declared return type.'
 ELSE upper(m[1]) || m[2:] || CASE WHEN m LIKE '%.' THEN '' ELSE '.' END END"""


@query("readable_messages", MSG_SQL.rstrip() + f""", n AS (SELECT message, {STRIP.format('message')} AS m FROM msgs) SELECT message, {READABLE_SQL} AS sentence FROM n""")
def readable_messages(t: Tables) -> DataFrame:
    """Friendly sentence of each message."""
    return messages(t).withColumn("sentence", T.readable(F.col("message")))


M = "lower(message)"
PHRASE_SQL = case_sql([
    (any_sql(M, L.PHRASES_INCLUDE), "missing_include"), (any_sql(M, ["multiple definition of"]), "redefinition"),
    (any_sql(M, L.PHRASES_LINK), "linker_error"), (any_sql(M, L.PHRASES_ACCESS), "access_error"),
    (any_sql(M, L.PHRASES_RETURN) + " AND " + any_sql(M, ["return", "void"]), "return_type_error"),
    (any_sql(M, L.PHRASES_REDEFINE), "redefinition"), (any_sql(M, L.PHRASES_NAME), "name_resolution"),
    (any_sql(M, L.PHRASES_TYPE), "type_error"), (any_sql(M, L.PHRASES_SYNTAX), "syntax_error")], "other")
_SYM = (f"coalesce(nullif(regexp_extract(message, {q(L.SCOPE_SYMBOL)}, 1), ''), regexp_extract(message, {q(L.UNDECLARED_SYMBOL)}, 1))")
_HAS_SYM = f"(regexp_matches(message, {q(L.SCOPE_SYMBOL)}) OR regexp_matches(message, {q(L.UNDECLARED_SYMBOL)}))"
VERIFIED_SQL = case_sql([
    (any_sql("message", ["undefined reference to", "ld returned 1 exit status"]), "linker_error"),
    (any_sql(M, ["no such file or directory", "did you forget to '#include", 'expects "filename"']) + " OR "
     + any_sql("message", ["is not a member of 'std'", "is not a member of std"]), "missing_include"),
    (f"{_HAS_SYM} AND " + in_sql(f"list_last(string_split({_SYM}, '::'))", L.SYMBOL_HEADERS), "missing_include"),
    (_HAS_SYM, "name_resolution"), (any_sql(M, L.VERIFIED_ACCESS), "access_error"),
    (any_sql(M, L.VERIFIED_RETURN) + f" OR ({any_sql(M, ['in return'])} AND {any_sql(M, ['cannot convert', 'invalid conversion'])})", "return_type_error"),
    (any_sql(M, L.VERIFIED_REDEFINE), "redefinition"), (any_sql(M, L.VERIFIED_OTHER), "other"),
    (any_sql(M, L.VERIFIED_TYPE) + f" OR ({any_sql(M, ['request for member'])} AND {any_sql(M, ['in something not a structure'])})", "type_error"),
    (any_sql(M, L.VERIFIED_NAME), "name_resolution"), (any_sql(M, L.VERIFIED_SYNTAX), "syntax_error")], None)
ALIAS_SQL = "CASE lower(trim(x)) " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in L.CATEGORY_ALIASES.items()) + " ELSE 'other' END"


@query("phrase_labels", MSG_SQL + f"""SELECT message, {PHRASE_SQL} AS label,
  CASE WHEN length(message) >= 4 AND regexp_full_match(message, '[\\x00-\\x7F]*') THEN CASE WHEN {PHRASE_SQL} <> 'other' THEN {PHRASE_SQL} ELSE 'syntax_error' END END AS rechecked FROM msgs""")
def phrase_labels(t: Tables) -> DataFrame:
    """Balanced-set label and the recheck of an older label."""
    m = F.col("message")
    return messages(t).select("message", L.phrase_label(m).alias("label"),
                              L.recheck_label(m, F.lit("syntax_error")).alias("rechecked"))


@query("verified_labels", MSG_SQL + f"SELECT message, {VERIFIED_SQL} AS label FROM msgs")
def verified_labels(t: Tables) -> DataFrame:
    """Label where a rule is certain, NULL elsewhere."""
    return messages(t).withColumn("label", L.verified_label(F.col("message")))


@query("category_aliases", MSG_SQL.rstrip() + f""", v AS (SELECT DISTINCT ' ' || upper(coalesce({VERIFIED_SQL}, 'function_error')) AS x FROM msgs)
SELECT x AS given, {ALIAS_SQL} AS category FROM v""")
def category_aliases(t: Tables) -> DataFrame:
    """Spelling variants folded to canonical categories."""
    given = F.concat(F.lit(" "), F.upper(F.coalesce(L.verified_label(F.col("message")), F.lit("function_error"))))
    v = messages(t).select(given.alias("given")).distinct()
    return v.withColumn("category", L.canonical_category(F.col("given")))


_HITS = " UNION ALL ".join(
    f"SELECT message, {i} AS ord, {q(c)} AS category, " + " + ".join(f"CAST(contains(lower(message), {q(k.lower())}) AS INT)" for k in ks) + " AS hits FROM msgs"
    for i, (c, ks) in enumerate(L.KEYWORDS))
RANKED_SQL = MSG_SQL.rstrip() + f""", h AS ({_HITS}), f AS (SELECT * FROM h WHERE hits > 0),
g AS (SELECT * FROM f UNION ALL SELECT message, 8, 'other', 0 FROM msgs WHERE message NOT IN (SELECT message FROM f)),
ranked AS (SELECT message, category, hits, CASE WHEN max(hits) OVER (PARTITION BY message) = 0 THEN 0.45::DOUBLE
   ELSE round(0.5::DOUBLE + 0.45::DOUBLE * hits / max(hits) OVER (PARTITION BY message), 3) END AS score,
  CAST(row_number() OVER (PARTITION BY message ORDER BY hits DESC, ord) AS INT) AS rank FROM g)
"""


@query("keyword_rank", RANKED_SQL + "SELECT * FROM ranked WHERE rank <= 3")
def keyword_rank(t: Tables) -> DataFrame:
    """Top three keyword categories per message with scores."""
    return L.keyword_rank(messages(t), "message", "message", top=3)


@query("second_opinion", RANKED_SQL.rstrip() + f""",
model AS (SELECT message, category, max(score) AS score FROM (
   SELECT message, {PHRASE_SQL} AS category, 0.7::DOUBLE AS score FROM msgs
   UNION ALL SELECT message, coalesce({VERIFIED_SQL}, 'other'), 0.2::DOUBLE FROM msgs) GROUP BY 1, 2),
j AS (SELECT coalesce(a.message, b.message) AS message, coalesce(a.category, b.category) AS category, coalesce(a.score, 0.0::DOUBLE) AS r, coalesce(b.score, 0.0::DOUBLE) AS m
  FROM (SELECT * FROM ranked WHERE rank <= 3) a FULL JOIN model b ON a.message = b.message AND a.category = b.category),
s AS (SELECT message, category, CASE WHEN m > 0 THEN 0.35::DOUBLE * r + 0.65::DOUBLE * m ELSE 0.5::DOUBLE * r END AS blended FROM j)
SELECT message, category, round(blended, 6) AS blended, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY message ORDER BY blended DESC, category) AS INT) AS rank FROM s) WHERE rank <= 3""")
def second_opinion(t: Tables) -> DataFrame:
    """Keyword ranking blended with a second scored labeller."""
    msgs = messages(t)
    rules = L.keyword_rank(msgs, "message", "message", top=3)
    m = F.col("message")
    pairs = F.array(F.struct(L.phrase_label(m).alias("category"), F.lit(0.7).alias("score")),
                    F.struct(F.coalesce(L.verified_label(m), F.lit("other")).alias("category"), F.lit(0.2).alias("score")))
    model = (msgs.select("message", F.explode(pairs).alias("p")).groupBy("message", F.col("p.category").alias("category"))
             .agg(F.max("p.score").alias("score")))
    return L.blend(rules, model, "message").withColumn("blended", F.round("blended", 6))


def _override_sql() -> str:
    und = any_sql(M, ["was not declared in this scope", "undeclared identifier"])
    std = (in_sql("regexp_extract(message, '[''\\x{2018}]([a-zA-Z_]\\w*)[''\\x{2019}]', 1)", L.STANDARD_SYMBOLS) + " OR "
           + any_sql(M, [f"'{s}'" for s in L.QUOTED_STANDARD]))
    arms = [(any_sql(M, p), f"{c}|{k}") for c, k, p in L.OVERRIDE_PHRASES]
    arms += [(f"{und} AND ({std})", "missing_include|0.99"), (und, "name_resolution|0.99")]
    arms += [(any_sql(M, p), f"{c}|{k}") for c, k, p in L.OVERRIDE_TAIL]
    return case_sql(arms, None)


@query("override_labels", MSG_SQL.rstrip() + f""", o AS (SELECT message, {_override_sql()} AS v FROM msgs),
p AS (SELECT message, split_part(v, '|', 1) AS x, CAST(split_part(v, '|', 2) AS DOUBLE) AS confidence FROM o WHERE v IS NOT NULL)
SELECT message, x AS label, confidence, {ALIAS_SQL} AS folded FROM p""")
def override_labels(t: Tables) -> DataFrame:
    """Fixed-confidence labels ahead of the model, and how evaluation folds them."""
    d = messages(t).select("message", F.explode(F.array_compact(F.array(L.override(F.col("message"))))).alias("o"))  # made once, not per column
    return d.select("message", F.col("o.category").alias("label"), "o.confidence", L.folded(F.col("o.category")).alias("folded"))


def _risk_case(i: int, default: str | None) -> str:
    arms = [("message IS NULL OR message = ''", "None")] if i == 1 else []
    return case_sql(arms + [(f"regexp_matches(message, {q(r[0])}, 'i')", r[i]) for r in L.RISK_RULES], default)


@query("diagnostic_risk", MSG_SQL + f"SELECT message, {_risk_case(1, 'Low')} AS risk, {_risk_case(2, None)} AS cwe, {_risk_case(3, None)} AS cert FROM msgs")
def diagnostic_risk(t: Tables) -> DataFrame:
    """Risk class with CWE and CERT of each message."""
    risk, cwe, cert = L.diagnostic_risk(F.col("message"))
    return messages(t).select("message", risk.alias("risk"), cwe.alias("cwe"), cert.alias("cert"))


DIAG_FINDINGS_SQL = " UNION ALL ".join(
    f"SELECT file, line_no, file_name, line, {q(s)} AS severity, {q(k)} AS finding_type FROM parsed WHERE regexp_matches(lower(message), {q(p)})"
    for p, s, k in L.DIAGNOSTIC_FINDINGS)


@query("diagnostic_findings", PARSED_SQL + f"SELECT *, 'compiler_diagnostic' AS found_by FROM ({DIAG_FINDINGS_SQL})")
def diagnostic_findings(t: Tables) -> DataFrame:
    """Every finding that a diagnostic text implies."""
    return L.diagnostic_findings(parsed(t), "message", "file", "line_no", "file_name", "line")


@query("failure_reasons", MSG_SQL + "SELECT message, " + case_sql(
    [(any_sql(M, p), n) for n, p in L.FAILURE_REASONS]
    + [(any_sql(M, ["expected"]) + " AND " + any_sql(M, [";"]), "missing semicolon"),
       (any_sql(M, ["cannot convert", "invalid conversion"]), "wrong type"),
       (any_sql(M, ["no return statement", "control reaches end of non-void function"]), "missing return")], "other") + " AS reason FROM msgs")
def failure_reasons(t: Tables) -> DataFrame:
    """Why a fix is hard, from the message."""
    return messages(t).withColumn("reason", L.failure_reason(F.col("message")))


@query("explained_messages", MSG_SQL.rstrip() + f""", l AS (SELECT message, {VERIFIED_SQL} AS category, {READABLE_SQL} AS what FROM (SELECT message, {STRIP.format('message')} AS m FROM msgs)),
e(category, why, how, suggestion) AS (VALUES {", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in X.EXPLANATIONS)})
SELECT message, l.category, suggestion, 'What happened:' || chr(10) || ' ' || what || chr(10) || chr(10) || 'Why it happened:' || chr(10) || ' ' || why
  || chr(10) || chr(10) || 'How to fix it:' || chr(10) || ' ' || how AS explanation
FROM l LEFT JOIN e ON e.category = l.category""")
def explained_messages(t: Tables) -> DataFrame:
    """Messages with their What / Why / How text."""
    m = messages(t).withColumn("category", L.verified_label(F.col("message")))
    return X.explain(m, "category", T.readable(F.col("message")))


@query("glossary_lookup", MSG_SQL + f"""SELECT message, {case_sql([(any_sql(M, [s.lower().strip(chr(39) + chr(34))]), s) for s, _ in X.GLOSSARY], None)} AS template,
  {case_sql([(any_sql(M, [s.lower().strip(chr(39) + chr(34))]), c) for s, c in X.GLOSSARY], None)} AS category FROM msgs""")
def glossary_lookup(t: Tables) -> DataFrame:
    """First glossary template contained in each message."""
    g = messages(t).withColumn("g", X.glossary_entry(F.col("message")))
    return g.select("message", "g.template", "g.category")


@query("diagnostics_with_findings", PARSED_SQL.rstrip() + f""", f AS ({DIAG_FINDINGS_SQL})
SELECT p.file, p.line_no, p.severity, count(DISTINCT f.finding_type) AS findings, string_agg(DISTINCT f.finding_type, ';' ORDER BY f.finding_type) AS kinds
FROM parsed p LEFT JOIN f ON f.file = p.file AND coalesce(f.file_name, '') = coalesce(p.file_name, '') AND f.line = p.line
GROUP BY 1, 2, 3""")
def diagnostics_with_findings(t: Tables) -> DataFrame:
    """Findings attached to diagnostics of the same file and line; both sides are reduced to one
    row per place before the join, so a hot place cannot multiply."""
    d = parsed(t)
    places = (L.diagnostic_findings(d, "message", "file", "file_name", "line")
              .groupBy("file", F.coalesce("file_name", F.lit("")).alias("fn"), "line")
              .agg(F.array_sort(F.collect_set("finding_type")).alias("kinds")))
    return (d.withColumn("fn", F.coalesce("file_name", F.lit(""))).join(places, ["file", "fn", "line"], "left")
            .select("file", "line_no", "severity", F.coalesce(F.size("kinds"), F.lit(0)).cast("bigint").alias("findings"),
                    F.nullif(F.array_join(F.coalesce("kinds", F.array().cast("array<string>")), ";"), F.lit("")).alias("kinds")))
