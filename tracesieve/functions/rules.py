"""Rule tables compiled to expressions: first match, all matches, keyword ranking."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineRule:
    """A pattern that yields a finding on the line (or text) it matches."""
    name: str
    pattern: str
    severity: str
    category: str = ""
    on: str = "code"          # which text column the pattern reads
    origin: str = "attack"
    holds: tuple[str, ...] = ()   # literals of which every match holds one; plain substring tests run before the pattern

    def hit(self) -> Column:
        found = F.col(self.on).rlike(self.pattern)
        return any_of(F.col(self.on), self.holds) & found if self.holds else found


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` made once a row, however often ``use`` names it; branches of CASE chains share no expressions otherwise."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def any_of(c: Column, phrases: Iterable[str]) -> Column:
    """True when the text holds one of the literal phrases."""
    cond = F.lit(False)
    for p in phrases:
        cond = cond | c.contains(p)
    return cond


def first_match(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """Lazy CASE chain over (condition, label)."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def all_matches(hits: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in table order."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in hits]))


def scan_lines(df: DataFrame, rules: Sequence[LineRule], keep: Sequence[str]) -> DataFrame:
    """One row per (line, matching rule). A single combined filter runs before the explode."""
    hits = all_matches([
        (r.hit(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category or r.name).alias("category"),
                           F.lit(r.severity).alias("severity"), F.lit(r.origin).alias("origin")))
        for r in rules])
    by_col: dict[str, list[str]] = {}
    pre = F.lit(False)
    for r in rules:
        if r.holds:
            pre = pre | r.hit()
        else:
            by_col.setdefault(r.on, []).append(r.pattern if not r.pattern.startswith("(?i)") else "(?i:" + r.pattern[4:] + ")")
    for col, pats in by_col.items():
        pre = pre | F.col(col).rlike("|".join(f"(?:{p})" for p in pats))
    return (df.where(pre).select(*keep, F.explode(hits).alias("__h"))
            .select(*keep, "__h.rule", "__h.category", "__h.severity", "__h.origin"))


def severity_rank(c: Column) -> Column:
    return (F.when(c == "Critical", 0).when(c == "High", 1).when(c == "Medium", 2).when(c == "Low", 3).otherwise(99))


def severity_weight(c: Column) -> Column:
    return (F.when(c == "Critical", 10).when(c == "High", 5).when(c == "Medium", 2).when(c == "Low", 1).otherwise(0))


def risk_label(score: Column) -> Column:
    return (F.when(score == 0, "Clean").when(score <= 10, "Low Risk").when(score <= 30, "Moderate").otherwise("High Risk"))


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the lower-cased text holds."""
    low = F.lower(c)
    total = F.lit(0)
    for k in keywords:
        total = total + low.contains(k.lower()).cast("int")
    return total
