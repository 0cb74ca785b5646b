"""Personal data in whole texts: fixed patterns, and candidates that boosted trees accept.

Fixed kinds (email, ip, card, phone) come from patterns with a check of digits. On top of them, generous generators propose overlapping spans:
spelled-out addresses, card numbers inside longer digit runs, phone numbers without "+", social security numbers, bank accounts, IPv6. Gradient boosted
trees score each by its format (digits, groups, check sums) and context (cue words, neighbours); a threshold per kind, calibrated on
examples held out from the fit for a set precision, selects. The trees are fitted in numpy on examples that a seeded
generator writes and labels, so no text of the corpus is needed and every run has the same model.

Positions are in code points, ends exclusive.
"""
from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import BATCH_ROWS, map_rows, whole_text

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE = 4
#: Kind, start, end.
Span = tuple[int, int, int]

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_NAME, _EMAIL_HOST = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, and its groups take whole runs; said so, long runs cost linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"@|\(at\)|\[at\]|(?<=\s)at(?=\s)", re.I)
_NAME_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_SPELLED_HOST = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]{2,}+)+", re.I)
_GENERATORS = {
    "ip": [re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
           re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])"),
           re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?=\.?(?:[^0-9.]|\Z))")],
    "card": [re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
             re.compile(r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")],
    "phone": [re.compile(r"(?<![0-9A-Za-z+(.-])(?:\+|00)?[ (]{0,2}[0-9]{1,4}\)?(?:[ .-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9A-Za-z])"),
              re.compile(r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"), re.compile(r"(?<![0-9A-Za-z.])0[0-9]{8,11}(?![0-9A-Za-z])"),
              re.compile(r"(?<![0-9A-Za-z+.-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9A-Za-z])")],
    "ssn": [re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")],
    "iban": [re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")],
}
_ANY = re.compile(r"[0-9@]")

#: Words before a candidate that speak for a kind, and those that speak against personal data.
CUES = {
    "email": ("mail", "e-mail", "email", "write", "contact", "reach", "schreiben", "kontakt", "courriel", "correo", "escribe", "contacto"),
    "ip": ("ip", "host", "server", "client", "address", "from", "adresse", "serveur", "servidor", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "kreditkarte", "carte", "tarjeta", "zahlung"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "contact", "dial", "telefon", "handy", "mobil", "anrufen", "rufnummer",
              "téléphone", "appelez", "portable", "teléfono", "móvil", "llame"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "cuenta", "banco"),
}
AGAINST = ("order", "invoice", "version", "isbn", "id", "ref", "serial", "tracking", "item", "date", "page", "total", "price", "part", "build",
           "release", "chapter", "section", "score", "range", "table", "between", "bestellung", "rechnung", "seite", "datum", "preis", "commande",
           "facture", "prix", "pedido", "factura", "página", "fecha", "precio")
#: Precision that the thresholds reach on held-out examples.
PRECISION = 0.99
TREES, DEPTH, RATE, EXAMPLES, SEED = 60, 3, 0.2, 6_000, 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from their "@": the pattern itself would try every word of a text again and again."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        host = _EMAIL_HOST.match(text, sign)
        begin = sign
        while begin > at and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if host and begin < sign:
            yield begin, host.end()
            at = host.end()
        else:
            at = sign + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed kinds by kind, then start: leftmost matches that don't overlap within a kind; matches that fail their check are dropped."""
    if not _ANY.search(text):
        return []
    out: list[Span] = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with "@" or "at" in any form and case, spaced or not, found from these like `_emails`; they may overlap.

    The name before a sign is the whole run of name characters that ends there, however long.
    """
    ends = None
    for sign in _AT.finditer(text):
        # the host first: few words "at" are followed by one
        if host := _SPELLED_HOST.match(text, sign.end()):
            if ends is None:
                ends = {m.end(): m.start() for m in _NAME_RUN.finditer(text)}
            at = sign.start()
            begin = ends.get(at, ends.get(at - 1) if text[at - 1:at].isspace() else None)
            if begin is not None:
                yield begin, host.end()


def candidates(text: str) -> list[Span]:
    """Generous proposals; they overlap each other and the fixed kinds."""
    out: set[Span] = set()
    out.update((0, *s) for s in _spelled(text))
    if _ANY.search(text):
        for kind, patterns in _GENERATORS.items():
            for p in patterns:
                out.update((KINDS.index(kind), *m.span()) for m in p.finditer(text))
    return sorted(out)


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s, d = text[a:b], _digits(text[a:b])
    before, after = text[max(0, a - 40):a].lower(), text[b:b + 20].lower()
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", before)[-5:]
    groups = re.findall(r"[0-9]+", s)
    name = KINDS[kind]
    ok = {"card": lambda: luhn(d), "iban": lambda: _mod97(s), "ip": lambda: (_is_ip(s) if ":" not in s else s.count(":") <= 7 and any(c.isdigit() for c in s)),
          "ssn": lambda: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"}.get(name, lambda: True)()
    return [kind, len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), ok,
            s.startswith(("+", "00")), "(" in s, s.count("-") + s.count("."), s.count(" "), len(set(d)),
            any(w in CUES[name] for w in words), any(w in AGAINST for w in words), before[-1:] in "#$€£=/_", before[-1:].isalnum(),
            after[:1].isalnum() or after[:1] in "%°/_", d[:1] in "3456", len(re.findall(r"\.", s)), bool(re.match(r"(19|20)[0-9]{2}", d)),
            any(x in s.lower() for x in ("dot", "(at)", "[at]")), len(groups[-1]) if groups else 0,
            "@" in s, bool(re.search(r"\w\.\s", s)), (len(d) if words and words[-1] in CUES[name] else 0)]


class Tree(NamedTuple):
    """A full binary tree of ``DEPTH`` levels: feature and cut of the inner nodes, value of the leaves."""

    feature: list[int]
    cut: list[float]
    value: list[float]

    def of(self, x: list[float]) -> float:
        node = 0
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[self.feature[node]] > self.cut[node])
        return self.value[node - (1 << DEPTH) + 1]


class Model(NamedTuple):
    start: float
    trees: list[Tree]
    thresholds: list[float]

    def score(self, x: list[float]) -> float:
        return 1 / (1 + np.exp(-(self.start + sum(t.of(x) for t in self.trees))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[Tree, np.ndarray]:
    """The tree of most gain level by level, and its value for each row. g, h: first and second derivatives of the loss."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, cut, node = [0] * inner, [float("inf")] * inner, np.zeros(len(x), int)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best, total_g, total_h = 1e-6, g[rows].sum(), h[rows].sum()
        for f, values in enumerate(cuts):
            for c in values if len(rows) > 20 else ():
                right = x[rows, f] > c
                gr, hr = g[rows][right].sum(), h[rows][right].sum()
                gain = gr ** 2 / (hr + 1) + (total_g - gr) ** 2 / (total_h - hr + 1) - total_g ** 2 / (total_h + 1)
                if gain > best:
                    best, feature[n], cut[n] = gain, f, float(c)
        node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
    leaf = node - inner
    value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
    return Tree(feature, cut, value.tolist()), value[leaf]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    f, grown = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, 17))[:-1]) for v in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree, step = _grow(x, p - y, p * (1 - p), cuts)
        grown.append(tree)
        f += step
    return start, grown


_FILLER = ("the of and to in is it was for on are with as at be this have from or an they which one had by word but not what all were we when your can "
           "said there use each she how their if will up other about out many then them these so some her would make like him into time has look der die und das ist mit von nicht ein auf le la les et est une dans pour que pas el los por con para como más").split()


def _with_check(rng: random.Random, length: int, prefix: str) -> str:
    body = prefix + "".join(rng.choice("0123456789") for _ in range(length - len(prefix) - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _iban(rng: random.Random) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 18, 20])))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def _grouped(s: str, sep: str, n: int = 4) -> str:
    return sep.join(s[i:i + n] for i in range(0, len(s), n))


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A text of filler with personal data of one kind, or with something that looks like it, and the spans that are right."""
    def num(n: int) -> str:
        return rng.choice("123456789") + "".join(rng.choice("0123456789") for _ in range(n - 1))

    def words(n: int) -> str:
        return " ".join(rng.choice(_FILLER) for _ in range(n))
    sep = rng.choice([" ", "-", ".", " "])
    area = num(3)
    name, host = rng.choice(_FILLER) + rng.choice(["", ".", "_"]) + rng.choice(_FILLER), rng.choice(["mail", "post", "example", "site"])
    card = _with_check(rng, 16, rng.choice("456"))
    wrong = card[:-1] + str((int(card[-1]) + rng.randint(1, 9)) % 10)
    good = {
        "email": [f"{name} at {host} dot com", f"{name}(at){host}.org", f"{name} [at] {host} [dot] net", f"{name} @ {host} . com", f"{name} (at) {host} (dot) com"],
        "ip": [":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), f"fe80::{rng.randint(1, 65535):x}", f"2001:db8:{rng.randint(0, 65535):x}::{rng.randint(1, 9)}", ".".join(str(rng.randint(1, 255)) for _ in range(4))],
        "card": [card, _grouped(card, " "), _grouped(card, "-"), _with_check(rng, 15, rng.choice(["34", "37"]))],
        "phone": [f"({area}) {num(3)}-{num(4)}", f"{area}-{num(3)}-{num(4)}", f"{area}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}",
                  f"0{num(9)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)} {num(7)}", f"0{num(3)}/{num(6)}", f"1-{area}-{num(3)}-{num(4)}"],
        "ssn": [f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{num(4)}"],
        "iban": [(lambda i: rng.choice([i, _grouped(i, " ")]))(_iban(rng))],
    }
    bad = [wrong, _grouped(wrong, " "), num(rng.randint(7, 19)), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
           f"{rng.randint(1990, 2030)}-{rng.randint(2000, 2040)}", f"{num(1)}.{num(2)}.{num(1)}.{num(4)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)} {num(2)}",
           f"{num(4)}{sep}{num(4)}", f"{num(2)}-{num(3)}-{num(5)}-{num(1)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(1)}-{num(2)}",
           f"{rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}.{rng.randint(0, 59):02d}", f"{rng.choice(['AB', 'XK'])}{num(2)}{num(16)}", f"000-{num(2)}-{num(4)}",
           f"{rng.choice(_FILLER)} at {rng.choice(_FILLER)}. {rng.choice(_FILLER)}", f"{rng.choice(_FILLER)} at {rng.choice(_FILLER)} . {rng.choice(_FILLER)}",
           f"{rng.choice(_FILLER)} at {host}.com", f"{num(1)} @ {num(2)}. {rng.choice(_FILLER)}", f"look at it dot by dot", f"{rng.choice(_FILLER)} at the dot matrix", f"0.{num(9)}", f"{num(1)} {num(3)} {num(3)} {num(3)}", f"{num(3)} {num(3)} {num(3)}",
           f"{rng.choice('abcdef')}::{rng.choice(['be', 'add', 'dead', 'fa'])}"]
    kind = rng.choice([*good, *good, "none", "none", "none", "none", "none", "none"])
    lead = words(rng.randint(0, 8))
    if kind == "none":
        cue = rng.choice(AGAINST) if rng.random() < 0.5 else rng.choice(rng.choice(list(CUES.values()))) if rng.random() < 0.1 else ""
        mid, spans = rng.choice(bad), []
    else:
        cue = rng.choice(CUES[kind]) if rng.random() < 0.5 else ""
        mid = rng.choice(good[kind])
        if kind == "phone" and rng.random() < 0.3:  # a form that only its cue makes a number to call
            cue, mid = rng.choice(CUES[kind]), f"{num(3)} {num(3)} {num(3)}"
    left = " ".join(x for x in (lead, cue) if x) + rng.choice([" ", ": ", " ", " is ", ".: "]) * bool(lead or cue)
    if kind != "none":
        spans = [(KINDS.index(kind), len(left), len(left) + len(mid))]
        if kind == "card" and rng.random() < 0.2:
            spans.append((2, spans[0][2] + 1, spans[0][2] + 1 + len(mid)))
            mid = f"{mid} {mid}"
    return left + mid + rng.choice([" ", ". ", ", ", "\n"]) + words(rng.randint(0, 6)), spans


@cache
def model(examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> Model:
    """The fitted trees and calibrated thresholds; the same for the same arguments."""
    rng, rows, right = random.Random(seed), [], []
    for _ in range(examples):
        text, spans = example(rng)
        for c in candidates(text):
            rows.append(features(text, c))
            right.append(any(c[0] == k and c[1] == a and c[2] == b for k, a, b in spans))
    x, y = np.array(rows, float), np.array(right, float)
    taught = np.arange(len(y)) < 2 * len(y) // 3
    start, trees = boost(x[taught], y[taught])
    fitted = Model(start, trees, [])
    held = np.array([fitted.score(r) for r in x[~taught].tolist()])
    thresholds = []
    for k in range(len(KINDS)):
        of = x[~taught][:, 0] == k
        order = np.argsort(-held[of], kind="stable")
        hits, s = np.cumsum(y[~taught][of][order]), held[of][order]
        good = np.flatnonzero((hits / np.arange(1, len(s) + 1) >= precision) & np.append(s[1:] < s[:-1], True)) if len(s) else []
        thresholds.append(float(max(0.5, s[good[-1]])) if len(good) else 2.0)
    return fitted._replace(thresholds=thresholds)


def find(text: str, trees: Model) -> list[Span]:
    """All spans by kind, then start: the fixed ones, and accepted candidates that overlap no better span."""
    out = base_spans(text)
    scored = []
    for c in candidates(text):
        s = trees.score(features(text, c))
        if s >= trees.thresholds[c[0]]:
            scored.append((-s, c))
    if scored:
        taken = _union(out)
        for _, c in sorted(scored):
            if _free(taken, c[1], c[2]):
                out.append(c)
    return sorted(out)


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps none of the disjoint, ordered stretches; if so it is put in its place."""
    at = bisect_left(taken, (a, a))
    if at < len(taken) and taken[at][0] < b or at and taken[at - 1][1] > a:
        return False
    taken.insert(at, (a, b))
    return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; what overlaps is replaced as one."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row; all but the last two are over the fixed kinds alone.

    Null and empty texts have no spans; null and repeated keys stay rows of their own. One narrow pass over whole texts.
    """
    trees = model()

    def make():
        def row(k, t):
            base = base_spans(t)
            counts = [sum(s[0] == i for s in base) for i in range(BASE)]
            return k, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every := find(t, trees)), len(every)
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make,
                    f"{key} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the column of its length set anew where there is one. Null texts stay null."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    trees = model()

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact(t, find(t, trees)) for t in texts], dtype=object)
    out = docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(text)))
    if length and length in docs.columns:
        out = out.withColumn(length, F.coalesce(F.char_length(text).cast(docs.schema[length].dataType), F.col(length)))
    return out
