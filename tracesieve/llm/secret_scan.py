"""Secrets in whole texts: fixed patterns, and runs of characters whose entropy is too high for words.

Fixed kinds: ``assign`` (a password-like name, ":" or "=", a value of 6 or more characters), ``access`` (``AKIA`` keys of 20 or more) and ``hex`` (24 or
more lower-case hex digits). On top of them, candidate strings get a sliding window of Shannon entropy: per character class (hex digits,
base32, base64) a window of fixed width moves along, counts of the entering and the leaving character are
updated, and with them the sum of c log2 c, so a step costs the same wherever it is. A candidate whose
highest window reaches its class's bound is a span of kind ``entropy``, unless an allow-list rule says that it is something harmless.

Positions are in code points, ends exclusive. Spark has no function for the positions of matches, but splitting a
text at a pattern and extracting the pattern walk the same matches, so positions are running sums of the lengths of both.
Everything is DataFrame expressions; nothing is exploded or shuffled.
"""
from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Matches of ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` run as far as they can, so asking for the length in the pattern finds those that are long enough.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: A run long enough to be judged by its entropy; a maximal run of the characters of base64 in either alphabet.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
#: Matches whose positions are summed up in one go: bounds the copying for texts with very many matches.
CHUNK = 256
#: Character class: its characters, the width of its window and the entropy in bits that random strings of it reach and words don't.
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 20, 3.0),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20, 3.7),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 20, 3.8),
}
#: Candidates that are no secrets, whatever their entropy.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    "^[0-9_/+=-]*$",  # numbers, dates, rules
    "^[a-zA-Z]*$",  # one word or several run together
    "^/|^[A-Za-z0-9_-]*(/[A-Za-z0-9_-]{1,12}){2,}$",  # paths
    "^[a-z]+([_-][a-z0-9]{1,12})+$|^[A-Z]+(_[A-Z0-9]{1,12})+$|^[A-Z]?[a-z]+([A-Z][a-z]+)+[0-9]{0,4}$",  # names in code
    "(?i)abcdefghij|0123456789|qwerty|example|placeholder|changeme|xxxxx|your[_-]?(key|token|secret)",  # alphabets and samples
)


_NONE = "array<struct<start:int,kind:int,end:int,match:string>>"


def _spans(steps: Column, kind: str) -> Column:
    """Spans (start, kind number, end, match) from (gap, match) steps: running sums, chunk by chunk.

    ``steps`` must be a column, not an expression: lambdas evaluate what they name for every element.
    """
    def length(x: Column) -> Column:
        return F.char_length(x["gap"]) + F.char_length(x["match"])

    def append(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["gap"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                        (start + F.char_length(x["match"])).alias("end"), x["match"].alias("match"))
        return F.struct((s["at"] + length(x)).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def chunk(k: Column) -> Column:
        before = F.aggregate(F.slice(steps, F.lit(1), k * CHUNK), F.lit(0), lambda n, x: n + length(x))
        return F.aggregate(F.slice(steps, k * CHUNK + 1, F.lit(CHUNK)), F.struct(before.alias("at"), F.array().cast(_NONE).alias("out")),
                           append, lambda s: s["out"])
    chunks = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), chunk))
    return F.when(F.size(steps) > 0, chunks).otherwise(F.array().cast(_NONE))


def max_entropy(s: Column, alphabet: str, width: int) -> Column:
    """The highest entropy, in bits, of a window of ``width`` characters of ``s``, kept up by counts of what enters and leaves."""
    n = len(alphabet)

    def clogc(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def index(ch: Column) -> Column:
        return F.instr(F.lit(alphabet), ch) - 1

    def step(a: Column, ch: Column) -> Column:
        full = F.char_length(a["window"]) >= width
        into = index(ch)
        out = F.when(full, index(F.substring(a["window"], 1, 1))).otherwise(F.lit(-1))
        more = F.when(into >= 0, F.get(a["counts"], into)).otherwise(F.lit(0))
        less = F.when(out >= 0, F.get(a["counts"], out)).otherwise(F.lit(0))
        total = F.when(into == out, a["sum"]).otherwise(
            a["sum"] + F.when(into >= 0, clogc(more + 1) - clogc(more)).otherwise(F.lit(0.0))
            - F.when(out >= 0, clogc(less) - clogc(less - 1)).otherwise(F.lit(0.0)))
        return F.struct(
            F.transform(a["counts"], lambda c, k: c + (k == into).cast("int") - (k == out).cast("int")).alias("counts"), total.alias("sum"),
            F.concat(F.when(full, F.substring(a["window"], 2, width)).otherwise(a["window"]), ch).alias("window"),
            F.when(F.char_length(a["window"]) >= width - 1, F.greatest(a["best"], F.lit(math.log2(width)) - total / width)).otherwise(a["best"]).alias("best"))
    start = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0.0).alias("sum"), F.lit("").alias("window"), F.lit(0.0).alias("best"))
    # the window's characters ride along in the state: looking them up in the string would walk it from its start each time
    return F.aggregate(F.filter(F.split(s, ""), lambda ch: ch != ""), start, step, lambda a: a["best"])


def is_random(match: Column) -> Column:
    """Whether a candidate's entropy says secret: judged by the narrowest class that holds all of its characters."""
    body = F.rtrim(match, F.lit("="))
    verdict = F.lit(False)
    for _, (alphabet, width, bound) in reversed(CLASSES.items()):  # the narrowest comes last and so is asked first
        verdict = F.when(F.translate(body, alphabet, "") == "", max_entropy(body, alphabet, width) >= bound).otherwise(verdict)
    return ~reduce(or_, (match.rlike(p) for p in ALLOWED)) & verdict


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): all secrets of every whole text as an array of (start, kind number, end, match), in order; see `KINDS`.

    Spans of the fixed kinds all stay; an entropy span is added where it overlaps none of them. Null and empty texts have no spans; null and
    repeated keys stay rows of their own; other columns are left out.
    """
    found = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__t")).withColumns(
        {f"__{k}": F.regexp_extract_all("__t", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    steps = found.withColumns({f"__{k}": F.when(F.size(f"__{k}") > 0, F.arrays_zip(
        F.slice(F.split("__t", p, -1), F.lit(1), F.size(f"__{k}")).alias("gap"), F.col(f"__{k}").alias("match")))
        .otherwise(F.array().cast("array<struct<gap:string,match:string>>")) for k, p in PATTERNS.items()})
    spans = {k: _spans(F.col(f"__{k}"), k) for k in KINDS}
    assign = F.filter(spans["assign"], lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_VALUE)
    base = steps.select("__key", F.concat(assign, spans["access"], spans["hex"]).alias("__base"), spans["entropy"].alias("__more"))
    added = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & is_random(m["match"]))
    return base.select(F.col("__key").alias(key), F.sort_array(F.concat("__base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row, spans as text; the digest is over the fixed kinds alone."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < KINDS.index("entropy"))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS[:3]]
    return scan(docs, text, key).select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans as one."""
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
        .otherwise(s["out"]).alias("out")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
