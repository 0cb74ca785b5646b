"""Small builders for the SQL twins."""
from __future__ import annotations

from collections.abc import Iterable


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(col: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in phrases) + ")"


def case_sql(arms: Iterable[tuple[str, str | None]], default: str | None) -> str:
    body = " ".join(f"WHEN {c} THEN {'NULL' if v is None else q(v)}" for c, v in arms)
    return f"CASE {body} ELSE {'NULL' if default is None else q(default)} END"


def in_sql(col: str, values: Iterable[str]) -> str:
    return f"{col} IN (" + ", ".join(q(v) for v in values) + ")"


SEV_RANK = "CASE {0} WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 99 END"
SEV_WEIGHT = "CASE {0} WHEN 'Critical' THEN 10 WHEN 'High' THEN 5 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
RISK = ("CASE WHEN {0} = 0 THEN 'Clean' WHEN {0} <= 10 THEN 'Low Risk' "
        "WHEN {0} <= 30 THEN 'Moderate' ELSE 'High Risk' END")
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = r"""string_split_regex({0}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"""


def doc_lines_sql(table: str, key: str, text: str) -> str:
    """(key, line_no, line) rows of a text column."""
    return f"""
      SELECT {key}, line_no, line FROM (
        SELECT {key}, len(parts) AS n, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no
        FROM (SELECT {key}, {LINES.format(text)} AS parts FROM {table}))
      WHERE NOT (line_no = n AND line = '')"""
