"""Structure, weakness, execution-risk and quality queries over source lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.operators import execution as EX
from tracesieve.operators import findings as V
from tracesieve.operators import quality as Q
from tracesieve.operators import structure as ST
from tracesieve.operators import weakness as W
from tracesieve.functions.text import strip_code
from tracesieve.plans.derived import CODE_SQL, code_lines
from tracesieve.plans.registry import ORACLES, Tables, query
from tracesieve.plans.sqltext import in_sql, q
from tracesieve.session import share

#: A single line without literals and comments.
STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '"[^"]*"', '', 'g'), '''[^'']*''', '', 'g'), '/\*.*?\*/', '', 'g'), '//.*$', '')"""
CODE = CODE_SQL.join(["WITH ", ""]) + f""", src AS MATERIALIZED (SELECT file, line_no, k, raw, {STRIPPED} AS code FROM code)
"""
DEPTH = CODE.rstrip() + r""",
br AS (SELECT file, line_no, i AS idx, CASE WHEN b[i] = '{' THEN 1 ELSE -1 END AS delta FROM (SELECT file, line_no, b, unnest(range(1, length(b) + 1)) AS i FROM (SELECT file, line_no, regexp_replace(code, '[^{}]', '', 'g') AS b FROM src))),
bs AS (SELECT *, sum(delta) OVER (PARTITION BY file ORDER BY line_no, idx) AS s FROM br),
bd AS (SELECT file, line_no, idx, delta, s - least(0, min(s) OVER (PARTITION BY file ORDER BY line_no, idx)) AS d FROM bs),
ld AS (SELECT DISTINCT file, line_no, last_value(d) OVER (PARTITION BY file, line_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d FROM bd),
dep AS (SELECT s.*, coalesce(last_value(ld.d IGNORE NULLS) OVER (PARTITION BY s.file ORDER BY s.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
  coalesce(last_value(ld.d IGNORE NULLS) OVER (PARTITION BY s.file ORDER BY s.line_no), 0) AS depth_after FROM src s LEFT JOIN ld ON ld.file = s.file AND ld.line_no = s.line_no),
scp AS (SELECT o.file, o.line_no AS ol, o.idx AS oi, o.d AS depth, min(c.line_no * 1000 + c.idx) AS cl FROM bd o LEFT JOIN bd c ON c.file = o.file AND (c.line_no, c.idx) > (o.line_no, o.idx) AND c.d < o.d WHERE o.delta = 1 GROUP BY 1, 2, 3, 4)
"""


def src(t: Tables) -> DataFrame:
    return share(ST.strip_lines(code_lines(t.lineitem)))


# raw strings aside, which no document holds: comments shrink to their line breaks, literals vanish
_TOKEN_SQL = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"(?:[^"\\\n]|\\[^\n])*["\\]?|'(?:[^'\\\n]|\\[^\n])*['\\]?|[^/"']+|/"""


@query("stripped_code", f"""SELECT doc_id, md5(c) AS code_md5, length(c) AS chars, len(string_split(c, chr(10))) AS lines FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, {q(_TOKEN_SQL)}),
  lambda x: CASE WHEN starts_with(x, '//') OR x[1] IN ('"', '''') THEN '' WHEN starts_with(x, '/*') THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), '') AS c FROM documents)""")
def stripped_code(t: Tables) -> DataFrame:
    """Whole document texts without comments and literals; line count is preserved."""
    c = strip_code(F.col("text"))
    return t.documents.select("doc_id", F.md5(c).alias("code_md5"), F.length(c).alias("chars"), F.size(F.split(c, "\n")).alias("lines"))


@query("brace_depth", DEPTH + "SELECT file, line_no, CAST(depth AS BIGINT) AS depth, CAST(depth_after AS BIGINT) AS depth_after FROM dep")
def brace_depth(t: Tables) -> DataFrame:
    """Brace depth before and after every line."""
    return ST.with_depth(src(t)).select("file", "line_no", "depth", "depth_after")


@query("enclosing_scopes", DEPTH + "SELECT s.file, s.line_no, c.depth, c.ol AS open_line FROM src s JOIN scp c ON c.file = s.file AND c.ol < s.line_no AND (c.cl IS NULL OR s.line_no <= c.cl // 1000)")
def enclosing_scopes(t: Tables) -> DataFrame:
    """Every scope open at the start of every line."""
    s = src(t)
    return ST.enclosing_scopes(s, s).select("file", "line_no", "depth", "open_line")


_FN = W.__dict__ and ST.FUNCTION
FUNCS = DEPTH.rstrip() + f""",
hd AS (SELECT file, line_no AS fl, regexp_extract(code, {q(_FN)}, 1) AS fn, trim(regexp_extract(code, {q(_FN)}, 2)) AS params, depth AS d0 FROM dep WHERE regexp_matches(code, {q(_FN)}) AND NOT {in_sql(f"regexp_extract(code, {q(_FN)}, 1)", ST.NOT_FUNCTIONS)}),
cand AS (SELECT dep.*, hd.fl, hd.fn, hd.params, hd.d0 FROM dep ASOF LEFT JOIN hd ON hd.file = dep.file AND dep.line_no >= hd.fl),
inn AS (SELECT *, CASE WHEN line_no = fl THEN regexp_replace(code, {q(_FN)}, '') ELSE code END AS body FROM (
  SELECT *, min(CASE WHEN line_no > fl THEN depth ELSE 1000000 END) OVER (PARTITION BY file, fl ORDER BY line_no) AS low FROM cand) WHERE fn IS NOT NULL AND (line_no = fl OR low > d0))
"""


@query("call_graph", FUNCS.rstrip() + f""", ca AS (SELECT DISTINCT file, fn, unnest(regexp_extract_all(body, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee FROM inn), df AS (SELECT DISTINCT file, fn FROM inn)
SELECT ca.file, ca.fn, callee, df.fn IS NOT NULL AS internal FROM ca LEFT JOIN df ON df.file = ca.file AND df.fn = callee WHERE callee <> ca.fn AND NOT {in_sql('callee', ST.NOT_FUNCTIONS)}""")
def call_graph(t: Tables) -> DataFrame:
    """Calls between functions of a file and to the outside."""
    return ST.call_graph(src(t))


@query("source_modules", CODE + """SELECT DISTINCT file, regexp_extract(raw, '^\\s*#include\\s+[<"]([^>"]+)[>"]', 1) AS module FROM src WHERE regexp_matches(raw, '^\\s*#include\\s+[<"]([^>"]+)[>"]')""")
def source_modules(t: Tables) -> DataFrame:
    """Included headers per file."""
    return ST.modules(src(t))


# Patterns with look-around have a plain equivalent on the derived lines.
_PLAIN = {"Unbounded Input": r'scanf\s*\(\s*"[^"]*%\s*s', "Unsafe Memory Copy": r"\b(?:memcpy|memmove)\s*\([^,]+,[^,]+,\s*\d+\s*\)\s*;?\s*$",
          "Integer Overflow": r"\w\s*[+\-*/]\s*\w.*\b(?:malloc|realloc|calloc)\s*\([^)]*[*+]"}


@query("line_weaknesses", CODE + " UNION ALL ".join(
    f"SELECT file, line_no, {q(r.name)} AS finding_type, {q(r.severity)} AS severity FROM src WHERE regexp_matches({r.on}, {q(_PLAIN.get(r.name, r.pattern))})" for r in W.LINE_RULES))
def line_weaknesses(t: Tables) -> DataFrame:
    """Stateless weakness rules."""
    return W.line_findings(src(t))


@query("assert_weaknesses", CODE + r"""SELECT file, line_no, 'Disabled Safety Check' AS finding_type, 'Low' AS severity FROM src
WHERE regexp_matches(code, '\bassert\s*\(') AND file IN (SELECT file FROM src GROUP BY file HAVING NOT bool_or(contains(raw, 'NDEBUG')))""")
def assert_weaknesses(t: Tables) -> DataFrame:
    """assert() as a safety boundary."""
    return W.assert_findings(src(t))


@query("proximity_weaknesses", CODE.rstrip() + f""", n AS (SELECT *, bool_or(regexp_matches(code, {q(W.SENSITIVE_CALL)})) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM src)
SELECT file, line_no, 'Weak Randomness' AS finding_type, 'High' AS severity FROM n WHERE regexp_matches(code, '\\brand\\s*\\(') AND (near OR regexp_matches(raw, {q(W.SENSITIVE_WORD)}))
UNION ALL SELECT file, line_no, 'Unresolved Security Debt', 'Low' FROM n WHERE regexp_matches(raw, '(?i)\\b(?:TODO|FIXME)\\b') AND near""")
def proximity_weaknesses(t: Tables) -> DataFrame:
    """rand() and TODO notes next to sensitive calls."""
    return W.proximity_findings(src(t))


def _first_touch_sql(sets: str, touches: str) -> str:
    """First touch after a setting: the previous event of the variable is a setting."""
    return f"""st AS ({sets}), tc AS ({touches}), evt AS (SELECT file, var, line_no, 1 AS kd FROM st UNION SELECT file, var, line_no, 0 FROM tc WHERE (file, var) IN (SELECT (file, var) FROM st) AND (file, var, line_no) NOT IN (SELECT (file, var, line_no) FROM st)),
ft AS (SELECT * FROM (SELECT *, lag(kd) OVER (PARTITION BY file, var ORDER BY line_no) AS pk FROM evt) WHERE kd = 0 AND pk = 1)"""


@query("uninitialised_uses", CODE.rstrip() + ", " + _first_touch_sql(
    r"SELECT file, line_no, regexp_extract(code, '^\s*(?:int|float|double|char|long)\s+([A-Za-z_]\w*)\s*;\s*$', 1) AS var FROM src WHERE regexp_matches(code, '^\s*(?:int|float|double|char|long)\s+([A-Za-z_]\w*)\s*;\s*$')",
    r"SELECT DISTINCT file, line_no, unnest(regexp_extract_all(code, '(?:^|[^.\->:\w])([A-Za-z_]\w*)', 1)) AS var FROM src") + r"""
SELECT ft.file, ft.line_no, 'Uninitialized Variable' AS finding_type, 'High' AS severity FROM ft JOIN src s ON s.file = ft.file AND s.line_no = ft.line_no
WHERE NOT regexp_matches(s.code, '^\s*' || var || '\s*=') AND NOT regexp_matches(s.code, '^\s*(?:int|float|double|char|long|unsigned|short|size_t|auto)\s+' || var || '\s*=')""")
def uninitialised_uses(t: Tables) -> DataFrame:
    """Reads of variables that were declared without a value."""
    return W.uninitialised_uses(src(t))


@query("null_uses", CODE.rstrip() + ", " + _first_touch_sql(
    r"SELECT file, line_no, regexp_extract(code, '\b(?:int|char|void|double|float)\s*\*\s*([A-Za-z_]\w*)\s*=\s*(?:nullptr|NULL|0)\s*;', 1) AS var FROM src WHERE regexp_matches(code, '\b(?:int|char|void|double|float)\s*\*\s*([A-Za-z_]\w*)\s*=\s*(?:nullptr|NULL|0)\s*;')",
    r"SELECT file, line_no, unnest(regexp_extract_all(code, '\*\s*([A-Za-z_]\w*)', 1)) AS var FROM src") + r"""
SELECT DISTINCT file, line_no, 'Null Pointer Dereference' AS finding_type, 'Critical' AS severity FROM ft WHERE NOT EXISTS (SELECT 1 FROM src g WHERE g.file = ft.file AND g.line_no BETWEEN ft.line_no - 3 AND ft.line_no
  AND regexp_matches(g.raw, '\bif\s*\(\s*' || ft.var || '\s*(?:!=\s*(?:nullptr|NULL|0)\s*)?\)'))""")
def null_uses(t: Tables) -> DataFrame:
    """Unguarded dereference of a null pointer."""
    return W.null_uses(src(t))


@query("arithmetic_uses", CODE.rstrip() + r""", z AS (SELECT file, line_no, regexp_extract(code, '\b(?:int|double|float)\s+([A-Za-z_]\w*)\s*=\s*0\b', 1) AS var FROM src WHERE regexp_matches(code, '\b(?:int|double|float)\s+([A-Za-z_]\w*)\s*=\s*0\b')),
u AS (SELECT file, line_no, regexp_extract(code, '\bunsigned\s+(?:int\s+)?([A-Za-z_]\w*)\s*=\s*0\b', 1) AS var FROM src WHERE regexp_matches(code, '\bunsigned\s+(?:int\s+)?([A-Za-z_]\w*)\s*=\s*0\b'))
SELECT s.file, s.line_no, 'Division by Zero' AS finding_type, 'High' AS severity FROM src s JOIN (SELECT file, var, min(line_no) AS f FROM z GROUP BY 1, 2) z2 ON z2.file = s.file AND s.line_no > f AND regexp_matches(s.code, '/\s*' || var || '\b')
UNION ALL SELECT s.file, s.line_no, 'Integer Underflow', 'High' FROM src s JOIN (SELECT file, var, min(line_no) AS f FROM u GROUP BY 1, 2) u2 ON u2.file = s.file AND s.line_no > f AND regexp_matches(s.code, '\b' || var || '\s*(?:--|-=|-)')""")
def arithmetic_uses(t: Tables) -> DataFrame:
    """Division by zero, overflow and underflow of known values."""
    return W.arithmetic_uses(src(t))


@query("vector_bounds", CODE.rstrip() + r""", st AS (SELECT file, line_no, regexp_extract(code, 'vector<int> (vv\d) = \{([^}]+)\}', 1) AS var, len(string_split(regexp_extract(code, 'vector<int> (vv\d) = \{([^}]+)\}', 2), ',')) AS n FROM src WHERE regexp_matches(code, 'vector<int> (vv\d) = \{([^}]+)\}')),
us AS (SELECT file, line_no, regexp_extract(code, '^(vv\d)\[(\d+)\]', 1) AS var, CAST(regexp_extract(code, '^(vv\d)\[(\d+)\]', 2) AS INT) AS i FROM src WHERE regexp_matches(code, '^(vv\d)\[(\d+)\]'))
SELECT us.file, us.line_no, 'Vector Out of Bounds' AS finding_type, 'High' AS severity FROM us ASOF JOIN st ON st.file = us.file AND st.var = us.var AND us.line_no > st.line_no WHERE i >= n""")
def vector_bounds(t: Tables) -> DataFrame:
    """Constant index past the initialiser of a vector."""
    return W.vector_bounds(src(t))


@query("array_bounds", CODE.rstrip() + rf""", dc AS (SELECT file, line_no, regexp_extract(raw, {q(W.ARRAY_DECL)}, 1) AS var, CAST(regexp_extract(raw, {q(W.ARRAY_DECL)}, 2) AS BIGINT) AS size FROM src WHERE regexp_matches(raw, {q(W.ARRAY_DECL)}) AND NOT starts_with(raw, '//')),
us AS (SELECT file, line_no, unnest(regexp_extract_all(raw, {q(W.ARRAY_USE)}, 1)) AS var, CAST(unnest(regexp_extract_all(raw, {q(W.ARRAY_USE)}, 2)) AS BIGINT) AS i FROM src WHERE NOT starts_with(raw, '//'))
SELECT us.file, us.line_no, us.var, us.i AS "index", size, dc.line_no AS decl_line FROM us ASOF JOIN dc ON dc.file = us.file AND dc.var = us.var AND us.line_no >= dc.line_no WHERE dc.line_no < us.line_no AND i >= size""")
def array_bounds(t: Tables) -> DataFrame:
    """Subscripts past the latest earlier declaration of the array."""
    return W.array_bounds(src(t))


_DK = "CASE target " + " ".join(f"WHEN {q(k)} THEN {q(n)}" for k, (n, _) in W.DANGEROUS.items()) + " END"
_DS = "CASE target " + " ".join(f"WHEN {q(k)} THEN {q(s)}" for k, (_, s) in W.DANGEROUS.items()) + " END"


@query("dangerous_calls", CODE.rstrip() + rf""", c AS (SELECT DISTINCT file, line_no, unnest(regexp_extract_all(raw, '\b([A-Za-z_]\w*)\s*\(', 1)) AS token FROM src WHERE NOT starts_with(raw, '//')),
al AS (SELECT file, regexp_extract(raw, {q(EX.ALIAS)}, 1) AS token, arg_max(regexp_extract(raw, {q(EX.ALIAS)}, 2), line_no) AS target FROM src WHERE {in_sql(f"regexp_extract(raw, {q(EX.ALIAS)}, 2)", W.DANGEROUS)} GROUP BY 1, 2),
r AS (SELECT file, line_no, token, token AS target, false AS aliased FROM c WHERE {in_sql('token', W.DANGEROUS)} UNION ALL SELECT c.file, line_no, c.token, target, true FROM c JOIN al ON al.file = c.file AND al.token = c.token)
SELECT *, {_DK} AS finding_type, {_DS} AS severity FROM r""")
def dangerous_calls(t: Tables) -> DataFrame:
    """Dangerous calls by name or macro alias."""
    return W.dangerous_calls(src(t))


@query("free_misuse", CODE.rstrip() + rf""", sc AS (SELECT *, count(*) FILTER (raw = '}}') OVER (PARTITION BY file ORDER BY line_no) AS sid FROM src WHERE NOT starts_with(raw, '//')),
fr AS (SELECT file, sid, line_no, coalesce(nullif(regexp_extract(raw, {q(W.FREE)}, 1), ''), regexp_extract(raw, {q(W.FREE)}, 2)) AS var FROM sc WHERE regexp_matches(raw, {q(W.FREE)})),
f1 AS (SELECT file, sid, var, min(line_no) AS first_line FROM fr GROUP BY 1, 2, 3),
dr AS (SELECT file, sid, line_no, unnest(list_concat(regexp_extract_all(raw, {q(W.DEREF)}, 1), regexp_extract_all(raw, {q(W.DEREF)}, 2))) AS var FROM sc WHERE NOT regexp_matches(raw, {q(W.FREE)}))
SELECT fr.file, line_no, fr.var, first_line, 'Double Free' AS finding_type FROM fr JOIN f1 USING (file, sid, var) WHERE line_no > first_line
UNION ALL SELECT dr.file, line_no, dr.var, first_line, 'Use After Free' FROM dr JOIN f1 USING (file, sid, var) WHERE line_no > first_line AND dr.var <> ''""")
def free_misuse(t: Tables) -> DataFrame:
    """Second frees and uses after free in a scope."""
    return W.free_misuse(src(t))


def _res_sql() -> str:
    acq = " UNION ALL ".join(f"SELECT file, line_no, '{k}' AS kind FROM src WHERE regexp_matches(code, {q(a)})" + (f" AND NOT regexp_matches(code, {q(W.NEW_EXEMPT)})" if k == "new" else "") for k, a, _, _ in W.RESOURCES)
    rel = " UNION ALL ".join(f"SELECT file, line_no, '{k}' AS kind FROM src WHERE regexp_matches(code, {q(r)})" for k, _, r, _ in W.RESOURCES)
    return f"""acq AS ({acq}), rel AS ({rel}),
ain AS (SELECT a.file, a.line_no, kind, arg_max((c.ol, c.oi), c.depth) AS sc FROM acq a JOIN scp c ON c.file = a.file AND c.ol < a.line_no AND (c.cl IS NULL OR a.line_no <= c.cl // 1000) GROUP BY 1, 2, 3),
rin AS (SELECT DISTINCT r.file, kind, (c.ol, c.oi) AS sc FROM rel r JOIN scp c ON c.file = r.file AND c.ol < r.line_no AND (c.cl IS NULL OR r.line_no <= c.cl // 1000))
SELECT file, line_no, CASE kind WHEN 'fopen' THEN 'File Descriptor Leak' ELSE 'Potential Memory Leak' END AS finding_type, 'Medium' AS severity FROM ain WHERE NOT EXISTS (SELECT 1 FROM rin WHERE rin.file = ain.file AND rin.kind = ain.kind AND rin.sc = ain.sc)"""


@query("resource_leaks", DEPTH.rstrip() + ", " + _res_sql())
def resource_leaks(t: Tables) -> DataFrame:
    """Acquisitions no release closes while their scope is open."""
    return W.resource_leaks(src(t))


# RE2 has no look-behind: the character before a call is matched instead
_BEFORE = r"(?:^|[^A-Za-z0-9_:.>-])"
_COUNT_SQL = "CASE WHEN trim({0}) IN ('', 'void') THEN 0 ELSE len(string_split(regexp_replace({0}, '\\([^()]*\\)', '', 'g'), ',')) END"
_OWN_SQL = f"'{_BEFORE}' || fn || '\\s*\\(([^;{{}}]*)\\)'"
_FUNCTION_SQL = FUNCS.rstrip() + f""", mk AS (SELECT *, regexp_matches(body, {_OWN_SQL}) AND {_COUNT_SQL.format(f"regexp_extract(body, {_OWN_SQL}, 1)")} = {_COUNT_SQL.format("params")} AS rec,
  regexp_matches(code, '\\b(?:if|switch|while)\\s*\\(|\\?') OR (regexp_matches(code, '\\breturn\\b') AND NOT regexp_matches(code, '{_BEFORE}' || fn || '\\s*\\(')) AS base FROM inn),
rt AS (SELECT DISTINCT file, line_no, fl, unnest(regexp_extract_all(code, '\\breturn\\s+&\\s*([A-Za-z_]\\w*)\\s*;', 1)) AS var FROM inn),
lv AS (SELECT file, fl, var, min(line_no) AS l FROM (SELECT file, line_no, fl, unnest(regexp_extract_all(code, {q(W.LOCAL_DECL)}, 1)) AS var FROM inn WHERE NOT regexp_matches(code, '\\bstatic\\b'))
  WHERE var NOT IN ('return', 'if', 'for', 'while', 'switch', 'case', 'struct', 'class', 'namespace') GROUP BY 1, 2, 3)
SELECT file, line_no, 'Infinite Recursion' AS finding_type, 'Critical' AS severity FROM mk WHERE rec AND (file, fl) NOT IN (SELECT (file, fl) FROM mk WHERE base)
UNION ALL SELECT rt.file, line_no, 'Dangling Pointer', 'Critical' FROM rt JOIN lv ON lv.file = rt.file AND lv.fl = rt.fl AND lv.var = rt.var WHERE l <= line_no"""


@query("function_weaknesses", _FUNCTION_SQL)
def function_weaknesses(t: Tables) -> DataFrame:
    """Endless recursion and addresses of locals."""
    return W.function_findings(src(t))


_COMPARED = r"\b([A-Za-z_]\w*)\s*(?:<|<=|>|>=)\s*([A-Za-z_]\w*)\b"
_SIGN_SQL = FUNCS.rstrip() + f""", fl AS (SELECT s.file, s.line_no, s.code, coalesce(inn.fl, 0) AS fl FROM src s LEFT JOIN inn ON inn.file = s.file AND inn.line_no = s.line_no),
sg AS (SELECT file, fl, var, min(CASE WHEN t = 'u' THEN line_no END) AS ul, min(CASE WHEN t = 's' THEN line_no END) AS sl FROM (
  SELECT file, fl, line_no, 'u' AS t, unnest(regexp_extract_all(code, '\\b(?:unsigned(?:\\s+(?:int|char|long|short))?|uint\\w*|size_t)\\s+([A-Za-z_]\\w*)', 1)) AS var FROM fl
  UNION ALL SELECT file, fl, line_no, 's', unnest(regexp_extract_all(code, '\\b(?:int|long|short)\\s+([A-Za-z_]\\w*)', 1)) FROM fl) GROUP BY 1, 2, 3),
cm AS (SELECT file, fl, line_no, regexp_extract(code, {q(_COMPARED)}, 1) AS a, regexp_extract(code, {q(_COMPARED)}, 2) AS b FROM fl WHERE regexp_matches(code, {q(_COMPARED)}) AND NOT contains(code, 'static_cast')),
kd AS (SELECT cm.*, x.ul <= line_no AS au, x.sl <= line_no AS as_, y.ul <= line_no AS bu, y.sl <= line_no AS bs FROM cm
  JOIN sg x ON x.file = cm.file AND x.fl = cm.fl AND x.var = a JOIN sg y ON y.file = cm.file AND y.fl = cm.fl AND y.var = b)
SELECT file, line_no, 'Signed/Unsigned Mismatch' AS finding_type, 'Medium' AS severity FROM kd
WHERE (coalesce(au, false) AND NOT coalesce(as_, false) AND coalesce(bs, false) AND NOT coalesce(bu, false)) OR (coalesce(as_, false) AND NOT coalesce(au, false) AND coalesce(bu, false) AND NOT coalesce(bs, false))"""


@query("sign_mismatch", _SIGN_SQL)
def sign_mismatch(t: Tables) -> DataFrame:
    """Signed and unsigned variables compared."""
    return W.sign_mismatch(src(t))


_ALL_WEAKNESSES = ("line_weaknesses", "assert_weaknesses", "proximity_weaknesses", "uninitialised_uses", "null_uses", "arithmetic_uses", "vector_bounds",
                   "resource_leaks", "function_weaknesses", "sign_mismatch", "free_misuse")
_CWE_SQL = "CASE finding_type " + " ".join(f"WHEN {q(name)} THEN {q(cwe)}" for name, cwe, _ in V.TAXONOMY) + " END"


@query("weakness_codes", "SELECT file, string_agg(DISTINCT cwe, ';' ORDER BY cwe) AS codes FROM (SELECT file, " + _CWE_SQL + " AS cwe FROM ("
       + " UNION ALL ".join(f"SELECT file, finding_type FROM ({ORACLES[name]})" for name in _ALL_WEAKNESSES) + ")) WHERE cwe IS NOT NULL GROUP BY file")
def weakness_codes(t: Tables) -> DataFrame:
    """Sorted CWE set of every file over all static rules."""
    from tracesieve.operators.evaluation import codes_per_file
    return codes_per_file(V.add_taxonomy(W.weakness_counts(src(t)), "finding_type"), "file", "cwe_id")


_ABS = "regexp_matches(x, '^(?:[/\\\\]|[a-zA-Z]:[/\\\\])') OR contains(x, '..')"
_LITS = r"""regexp_extract_all(raw, '"((?:\\.|[^"\\])*)"', 1)"""
_OUT = f"len(list_filter({_LITS}, lambda x: {_ABS})) > 0"
_SECRET = f"len(list_filter({_LITS}, lambda x: regexp_matches(lower(x), '\\.env|id_rsa|passwd|shadow|\\.ssh|\\.aws|credentials'))) > 0"
_NC = "NOT starts_with(trim(raw), '//')"
EXEC_RULES = [
    ("obfuscation", "'High'", f"{_NC} AND {in_sql(f'regexp_extract(raw, {q(EX.ALIAS)}, 2)', EX.DANGEROUS_NAMES)}"),
    ("process_execution", "'High'", f"regexp_matches(code, {q(EX.PROCESS)})"),
    ("inline_assembly", "'High'", f"regexp_matches(code, {q(EX.ASM)})"),
    ("dynamic_loading", "'High'", f"regexp_matches(code, {q(EX.DYNAMIC)})"),
    ("network_access", "'High'", f"regexp_matches(code, {q(EX.NETWORK_CALL)}) OR ({_NC} AND regexp_matches(raw, {q(EX.NETWORK_INCLUDE)}))"),
    ("sensitive_file_access", "'High'", f"regexp_matches(code, {q(EX.FILE_OPEN)}) AND ({_OUT} OR {_SECRET})"),
    ("destructive_file_op", f"CASE WHEN {_OUT} THEN 'High' ELSE 'Medium' END", f"regexp_matches(code, {q(EX.DESTRUCTIVE)})"),
    ("secret_env_access", "'High'", f"regexp_matches(code, {q(EX.ENVIRONMENT)}) AND len(list_filter({_LITS}, lambda x: regexp_matches(x, '(?i)KEY|TOKEN|SECRET|PASSWORD|API'))) > 0"),
    ("startup_code", "'Medium'", f"{_NC} AND regexp_matches(raw, {q(EX.STARTUP)})"),
    ("unsafe_include", "'High'", f"{_NC} AND lower(regexp_extract(raw, '#\\s*include\\s*<sys/([^>]+)>', 1)) NOT IN ('', 'socket.h')"),
    ("unsafe_include", "'Low'", f"{_NC} AND regexp_matches(raw, '#\\s*include\\s*<unistd\\.h>')"),
]


_EXEC_SQL = " UNION ALL ".join(f"SELECT file, line_no, '{c}' AS category, {s} AS severity FROM src WHERE {w}" for c, s, w in EXEC_RULES)


@query("policy_toggles", CODE + f"""SELECT permitted, category, CASE WHEN permitted AND {in_sql('category', list(V.TOGGLES.values()))} THEN 'Low' ELSE severity END AS severity,
  CASE WHEN permitted AND {in_sql('category', list(V.TOGGLES.values()))} THEN 'warn' ELSE 'block' END AS action, count(*) AS n
FROM ({_EXEC_SQL}), (VALUES (true), (false)) p(permitted) GROUP BY ALL""")
def policy_toggles(t: Tables) -> DataFrame:
    """Execution findings under a site policy that permits system calls, assembly and system headers, and under one that doesn't."""
    f = EX.execution_findings(src(t)).withColumn("action", F.lit("block"))
    both = (V.apply_toggles(f, **dict.fromkeys(V.TOGGLES, True)).withColumn("permitted", F.lit(True))
            .unionByName(V.apply_toggles(f).withColumn("permitted", F.lit(False))))
    return both.groupBy("permitted", "category", "severity", "action").agg(F.count("*").alias("n"))


@query("execution_risks", CODE + _EXEC_SQL)
def execution_risks(t: Tables) -> DataFrame:
    """Process, network, file, environment and include risks per line."""
    return EX.execution_findings(src(t))


@query("alias_calls", CODE.rstrip() + rf""", d AS (SELECT file, regexp_extract(raw, {q(EX.ALIAS)}, 1) AS token, min(line_no) AS d FROM src WHERE {in_sql(f"replace(regexp_extract(raw, {q(EX.ALIAS)}, 2), 'gets', 'popen')", EX.DANGEROUS_NAMES)} GROUP BY 1, 2),
c AS (SELECT file, line_no, unnest(regexp_extract_all(code, '\b([A-Za-z_]\w*)\s*\(', 1)) AS token FROM src WHERE NOT regexp_matches(code, {q(EX.PROCESS)}))
SELECT DISTINCT c.file, line_no, 'process_execution' AS category, 'High' AS severity FROM c JOIN d ON d.file = c.file AND d.token = c.token AND line_no >= d""")
def alias_calls(t: Tables) -> DataFrame:
    """Calls through an alias defined on the same line or before."""
    aliased = src(t).withColumns({c: F.replace(c, F.lit(" gets"), F.lit(" popen")) for c in ("raw", "code")})
    return EX.alias_calls(aliased)


@query("special_includes", CODE + """SELECT file, line_no, 'special_file_include' AS category, 'High' AS severity FROM src WHERE raw = '#include "CON.h"'""")
def special_includes(t: Tables) -> DataFrame:
    """Includes of devices and shares."""
    return EX.special_includes(src(t))


@query("huge_allocations", CODE.rstrip() + r""", a AS (SELECT file, line_no, 'array' AS form, CAST(regexp_extract(code, '^int (?:big|arr)\d\[(\d+)\]', 1) AS BIGINT) AS elements, 4 AS u FROM src WHERE regexp_matches(code, '^int (?:big|arr)\d\[(\d+)\]')
 UNION ALL SELECT file, line_no, 'malloc', CAST(regexp_extract(code, 'malloc\((\d+)\)', 1) AS BIGINT), 1 FROM src WHERE regexp_matches(code, 'malloc\((\d+)\)'))
SELECT file, line_no, form, elements, 'huge_allocation' AS category, 'High' AS severity FROM a WHERE elements >= 268435456 OR elements * u >= 1073741824""")
def huge_allocations(t: Tables) -> DataFrame:
    """Constant allocations over the limits."""
    return EX.huge_allocations(src(t))


@query("endless_loops", DEPTH.rstrip() + r""", h AS (SELECT * FROM dep WHERE regexp_matches(code, '\bwhile\s*\(\s*(?:true|1)\s*\)')), e AS (SELECT file, line_no FROM src WHERE regexp_matches(code, '\b(?:break|return|exit|abort|terminate|throw|goto)\b'))
SELECT file, line_no, 'possible_infinite_loop' AS category, 'Medium' AS severity FROM h WHERE depth_after <= depth
UNION ALL SELECT file, line_no, 'possible_infinite_loop', 'Medium' FROM h WHERE depth_after > depth AND NOT EXISTS (SELECT 1 FROM e JOIN scp c ON c.file = e.file AND c.ol < e.line_no AND (c.cl IS NULL OR e.line_no <= c.cl // 1000) WHERE e.file = h.file AND c.ol = h.line_no)""")
def endless_loops(t: Tables) -> DataFrame:
    """Endless loops without an escape."""
    return EX.endless_loops(src(t))


@query("oversized_texts", "SELECT doc_id, 'oversized_input' AS category, 'High' AS severity FROM documents WHERE strlen(text) > 2097152 UNION ALL SELECT doc_id, 'oversized_input', 'Medium' FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 100000)) > 0")
def oversized_texts(t: Tables) -> DataFrame:
    """Documents or lines over the scan limits."""
    return EX.size_findings(t.documents, "doc_id", "text")


_W = r"'\b([A-Za-z_]\w*)\b'"
_NESTED = r"'\b([A-Za-z_]\w*)\s*\(\s*([A-Za-z_]\w*)'"  # pairs; the name repeated is the case of equal ones
_MACROS_SQL = CODE.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", md AS (SELECT file, regexp_extract(raw, {q(EX.DEFINE)}, 1) AS name, arg_max({{'p': regexp_extract(raw, {q(EX.DEFINE)}, 2), 'b': regexp_extract(raw, {q(EX.DEFINE)}, 3)}}, line_no) AS d
  FROM src WHERE regexp_matches(raw, {q(EX.DEFINE)}) GROUP BY 1, 2),
mc AS (SELECT file, name, w, ln(greatest(1, coalesce(list_max(list_transform(list_filter(list_transform(string_split(d.p, ','), lambda p: trim(p)), lambda p: p <> ''), lambda p: len(list_filter(w, lambda x: x = p)))), 1))::DOUBLE) AS lm
  FROM (SELECT *, regexp_extract_all(d.b, {_W}, 1) AS w FROM md)),
eg AS (SELECT e.file, e.name, e.ref, count(*)::DOUBLE AS w, any_value(mc.lm) AS lm FROM (SELECT file, name, unnest(w) AS ref FROM mc) e JOIN mc ON mc.file = e.file AND mc.name = e.ref WHERE ref <> e.name GROUP BY 1, 2, 3),
sz AS (SELECT file, count(*) AS n FROM mc GROUP BY 1),
wk AS (SELECT file, name AS start, name AS at, 1.0::DOUBLE AS paths, lm, 1 AS step FROM mc UNION ALL
  SELECT wk.file, start, ref, paths * w, eg.lm, step + 1 FROM wk JOIN eg ON eg.file = wk.file AND eg.name = wk.at JOIN sz ON sz.file = wk.file WHERE ref <> start AND step < n),
per AS (SELECT file, max(lg) AS lg, max(d) AS depth FROM (SELECT file, start, sum(paths * lm) AS lg, max(step) AS d FROM wk GROUP BY 1, 2) GROUP BY 1),
fn AS (SELECT file, max(f) AS fanout FROM (SELECT file, name, sum(w) AS f FROM eg GROUP BY 1, 2) GROUP BY 1),
ns AS (SELECT file, count(*) AS nested FROM (SELECT DISTINCT file, a AS name FROM (SELECT file, unnest(regexp_extract_all(raw, {_NESTED}, 1)) AS a, unnest(regexp_extract_all(raw, {_NESTED}, 2)) AS b FROM src) WHERE a = b) x JOIN mc USING (file, name) GROUP BY 1),
g AS (SELECT file, lg + coalesce(nested, 0) * ln(2.0::DOUBLE) AS growth, depth, coalesce(fanout, 0) AS fanout FROM per LEFT JOIN fn USING (file) LEFT JOIN ns USING (file))
SELECT file, round(growth / ln(10.0::DOUBLE), 4) AS log10_growth, depth, CAST(fanout AS BIGINT) AS fanout, growth >= ln(1000000.0::DOUBLE) - 1e-9 OR (depth >= {EX.DEEP} AND fanout >= {EX.WIDE}) AS bomb FROM g"""


@query("macro_bombs", _MACROS_SQL)
def macro_bombs(t: Tables) -> DataFrame:
    """Expansion estimate of the macro definitions of every file."""
    return EX.macro_bombs(src(t))


_HEADERS_SQL = CODE.rstrip() + f""", inc AS (SELECT file, line_no, file + 10 AS header FROM src WHERE starts_with(raw, '#include <')),
exf AS ({_EXEC_SQL}), ed AS (SELECT DISTINCT file, header FROM inc WHERE header IN (SELECT file FROM src)),
rch AS (SELECT first_file, min(first_line) AS first_line, header FROM (WITH RECURSIVE r AS (
    SELECT file AS first_file, min(line_no) AS first_line, header FROM inc WHERE header IN (SELECT file FROM src) GROUP BY file, header
    UNION SELECT r.first_file, r.first_line, ed.header FROM r JOIN ed ON ed.file = r.header) SELECT * FROM r) AS x WHERE first_file <> header GROUP BY first_file, header)
SELECT first_file AS file, first_line AS line_no, rch.header, category, severity FROM rch JOIN exf ON exf.file = rch.header"""


@query("header_findings", _HEADERS_SQL)
def header_findings(t: Tables) -> DataFrame:
    """Execution risks of all files that a file includes, directly or through others, reported at its including line."""
    s = src(t)
    # every file includes the file ten suppliers on at each of its include lines
    inc = s.where(F.col("raw").startswith("#include <")).select("file", "line_no", (F.col("file") + 10).alias("header"))
    return EX.header_findings(inc, EX.execution_findings(s), s.groupBy("file").agg(F.sum(F.length("raw")).alias("bytes")))


LOOPS_SQL = DEPTH.rstrip() + f""",
heads AS (SELECT * FROM dep WHERE regexp_matches(code, {q(Q.LOOP)}) AND NOT regexp_matches(code, '\\}}\\s*while\\s*\\(')),
around AS (SELECT s.file, s.line_no, c.ol FROM src s JOIN scp c ON c.file = s.file AND c.ol < s.line_no AND (c.cl IS NULL OR s.line_no <= c.cl // 1000)
  WHERE (c.file, c.ol) IN (SELECT (file, line_no) FROM heads WHERE depth_after > depth) UNION SELECT file, line_no, line_no FROM heads),
loops AS (SELECT file, line_no, count(*) AS depth, min(ol) AS root FROM around GROUP BY 1, 2)
"""


@query("loop_nesting", LOOPS_SQL + "SELECT file, line_no, depth, root FROM loops")
def loop_nesting(t: Tables) -> DataFrame:
    """How many loops surround each line, and where the outermost starts."""
    return Q.loop_lines(src(t))


def _each_sql(pattern: str, hint: str, weight: int, code: str = "code", where: str = "true") -> str:
    return f"SELECT file, line_no, '{hint}' AS hint, {weight} AS weight FROM (SELECT file, line_no, unnest(regexp_extract_all({code}, {q(pattern)})) FROM src WHERE {where})"


# RE2 has neither look-around nor back-references: commas are doubled so that a parameter may end in the comma before the next,
# words that only look like calls are blanked first, and a repeated name is looked up in the text behind its "="
_HEAVY_SQL = Q.HEAVY.replace("(?=[,)])", "[,)]")
_CALL_SQL = r"regexp_matches(regexp_replace(code, '\b(?:if|for|while|switch|catch|return|sizeof|decltype)\b', '#', 'g'), '\b[a-zA-Z_]\w*\s*\([^)]*\)')"
_SET_SQL = r"'\b([a-zA-Z_]\w*)\s*=([^;=]*);'"
HINTS_SQL = LOOPS_SQL.rstrip() + f""", inner_lines AS (SELECT s.* FROM src s JOIN loops l ON l.file = s.file AND l.line_no = s.line_no),
vecs AS (SELECT DISTINCT file, unnest(regexp_extract_all(code, {q(Q.VECTOR_DECL)}, 1)) AS var FROM src), reserved AS (SELECT DISTINCT file, unnest(regexp_extract_all(code, {q(Q.RESERVE)}, 1)) AS var FROM src),
pushes AS (SELECT file, line_no, unnest(regexp_extract_all(code, '\\b([a-zA-Z_]\\w*)\\.push_back\\s*\\(', 1)) AS var FROM inner_lines),
sets AS (SELECT file, line_no, unnest(regexp_extract_all(code, {_SET_SQL}, 1)) AS name, unnest(regexp_extract_all(code, {_SET_SQL}, 2)) AS rest FROM inner_lines WHERE contains(code, '+')),
hints AS (SELECT file, line_no, 'strlen_in_loop_condition' AS hint, 2 AS weight FROM src WHERE regexp_matches(code, {q(Q.STRLEN_LOOP)})
 UNION ALL {_each_sql(Q.RANGE_COPY, 'copy_in_range_for', 1)}
 UNION ALL {_each_sql(_HEAVY_SQL, 'pass_by_value', 1, "replace(code, ',', ',,')", _CALL_SQL)}
 UNION ALL SELECT l.file, min(l.line_no), 'nested_loops', CASE WHEN max(l.depth) >= 3 THEN 3 ELSE 2 END FROM loops l JOIN src s ON s.file = l.file AND s.line_no = l.line_no WHERE l.depth >= 2 AND regexp_matches(s.code, {q(Q.LOOP)}) GROUP BY l.file, l.root
 UNION ALL SELECT file, line_no, 'endl_in_loop', 1 FROM inner_lines WHERE regexp_matches(code, '\\b(?:std::)?endl\\b')
 UNION ALL SELECT DISTINCT file, line_no, 'string_concat_in_loop', 1 FROM sets WHERE regexp_matches(rest, '\\b' || name || '\\b')
 UNION ALL SELECT file, min(line_no), 'push_back_without_reserve', 1 FROM pushes WHERE (file, var) IN (SELECT (file, var) FROM vecs) AND (file, var) NOT IN (SELECT (file, var) FROM reserved) GROUP BY file, var)
"""


@query("quality_hints", HINTS_SQL + "SELECT file, line_no, hint, weight FROM hints")
def quality_hints(t: Tables) -> DataFrame:
    """Performance hints with their weight."""
    return Q.quality_hints(src(t))


@query("quality_levels", HINTS_SQL + """SELECT file, CAST(coalesce(s, 0) AS BIGINT) AS score, CASE WHEN coalesce(s, 0) <= 1 THEN 'Good' WHEN s <= 4 THEN 'Fair' ELSE 'Needs work' END AS level
FROM (SELECT DISTINCT file FROM src) LEFT JOIN (SELECT file, sum(weight) AS s FROM hints GROUP BY file) USING (file)""")
def quality_levels(t: Tables) -> DataFrame:
    """Quality level of every file."""
    s = src(t)
    return Q.quality_level(s.select("file").distinct(), Q.quality_hints(s))


_FUNCS_ON_LOOPS = LOOPS_SQL.rstrip() + ", " + FUNCS[FUNCS.index("hd AS ("):].rstrip()
_COMPLEX_SQL = _FUNCS_ON_LOOPS + f""", rec AS (SELECT file, fl, sum(len(regexp_extract_all(body, '\\b' || fn || '\\s*\\('))) AS calls, bool_or(regexp_matches(body, {q(Q.HALVES)})) AS halves,
  bool_or(regexp_matches(body, {q(Q.TREE)})) AS tree, bool_or(regexp_matches(body, {q(Q.SMALLER)})) AS less FROM inn WHERE fn <> 'main' GROUP BY 1, 2 HAVING calls > 0),
r AS (SELECT file, bool_or(halves) AS ha, bool_or(NOT halves AND tree) AS wa, bool_or(NOT halves AND NOT tree AND calls >= 2 AND less) AS br FROM rec GROUP BY 1),
f AS (SELECT file, bool_or(regexp_matches(code, {q(Q.SORT)})) AS so, bool_or(regexp_matches(code, {q(Q.ORDERED)})) AS ma, bool_or(regexp_matches(code, {q(Q.VECTOR_DECL)})) AS ve,
  bool_or(coalesce(TRY_CAST(regexp_extract(code, {q(Q.SIZED_ARRAY)}, 1) AS BIGINT) >= 1000, false) OR regexp_matches(code, {q(Q.BULKY)})) AS bu FROM src GROUP BY 1),
j AS (SELECT f.file, coalesce(l.d, 0) AS d, coalesce(ha, false) AS ha, coalesce(wa, false) AS wa, coalesce(br, false) AS br, so, ma, ve, bu
  FROM f LEFT JOIN (SELECT file, max(depth) AS d FROM loops GROUP BY 1) l ON l.file = f.file LEFT JOIN r ON r.file = f.file)
SELECT file, d AS loop_depth, CASE WHEN br THEN 'O(2^n)' WHEN ha AND d >= 2 THEN 'O(n²)' WHEN ha THEN 'O(n log n)' WHEN wa AND d >= 2 THEN 'O(n²)' WHEN wa AND so THEN 'O(n log n)' WHEN wa THEN 'O(n)'
  WHEN d >= 3 THEN 'O(n³)' WHEN d = 2 THEN 'O(n²)' WHEN d = 1 AND so THEN 'O(n log n)' WHEN d = 1 THEN 'O(n)' WHEN so THEN 'O(n log n)' WHEN ma THEN 'O(log n)' WHEN ve THEN 'O(n)' ELSE 'O(1)' END AS time_class,
  CASE WHEN br OR ha OR wa OR bu OR ve OR ma THEN 'O(n)' ELSE 'O(1)' END AS space_class FROM j"""


@query("complexity_classes", _COMPLEX_SQL)
def complexity_classes(t: Tables) -> DataFrame:
    """Estimated time and space class of every file."""
    s = src(t)
    return Q.complexity(s.select("file").distinct(), s)
