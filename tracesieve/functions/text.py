"""Text cleaning, masking and normalising as column expressions (no Python per row)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.rules import bound

# Line terminators of Python's splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Whitespace trim on both ends, Unicode aware (``trim`` only removes blanks). Texts that begin and end in visible ASCII stay as they are."""
    def trimmed(x: Column) -> Column:
        visible = [F.substring(x, at, 1).between("!", "~") for at in (1, -1)]
        return F.when(visible[0] & visible[1], x).otherwise(F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    return bound(c, trimmed)


def split_lines(c: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line with a 1-based ``line_no``."""
    out = df.select(*keep, F.posexplode(split_lines(F.col(text))).alias("__p", "line"))
    return out.select(*keep, (F.col("__p") + 1).alias("line_no"), "line")


# ---------------------------------------------------------------------------------------------
# Dataset normal form. Quoted-token replacements, applied in this order.
TOKEN_NAMES: tuple[tuple[str, str], ...] = (
    (r"';'", "statement terminator"),
    (r"'}'", "closing brace"),
    (r"'{'", "opening brace"),
    (r"'\)'", "closing parenthesis"),
    (r"'\('", "opening parenthesis"),
    (r"'\]'", "closing bracket"),
    (r"'\['", "opening bracket"),
    (r"':'", "colon"),
    (r"','", "comma"),
    (r"'>>'", "right shift / closing template bracket"),
    (r"'(int|float|double|char|bool|long|short|unsigned|signed|void|auto)'", "type"),
    (r"'[a-zA-Z_][a-zA-Z0-9_]*'", "identifier"),
    (r"'[+\-\*/%=<>!&|^~]+='?", "operator"),
)


def _java(p: str) -> str:
    return p.replace("'}'", r"'\}'").replace("'{'", r"'\{'")


def dataset_form(c: Column) -> Column:
    """Message with quoted tokens replaced by what they are, blanks collapsed."""
    for pattern, name in TOKEN_NAMES:
        literal = re.sub(r"\\(.)", r"\1", pattern)
        plain = not re.search(r"[a-zA-Z]", literal) and re.fullmatch(pattern, literal)
        c = F.replace(c, F.lit(literal), F.lit(name)) if plain else F.regexp_replace(c, "(?i)" + _java(pattern), name)
    return strip(F.regexp_replace(c, " {2,}", " "))


# Classifier normal form. Tokens that stay visible between quotes.
KEPT_TOKENS: tuple[str, ...] = (
    "int", "float", "double", "char", "bool", "void", "auto", "long", "short", "unsigned", "signed", "const", "static", "return", "class", "struct",
    "private", "protected", "public", "virtual", "namespace", "template", "new", "delete", "nullptr", "true", "false", "if", "else", "for", "while",
    "do", "switch", "case", "default", "break", "continue", "goto", "operator", "sizeof", "typedef", "typename", "using", "constexpr", "enum", "union",
    "friend", "inline", "explicit", "mutable", "this", "throw", "try", "catch", "main", "argc", "argv", "std",
    "cout", "cin", "cerr", "endl", "ostream", "istream", "printf", "scanf", "fprintf", "string", "getline", "vector", "map", "set", "unordered_map",
    "unordered_set", "list", "queue", "stack", "deque", "array", "pair", "tuple", "optional", "sort", "find", "max", "min", "reverse", "count",
    "fill", "copy", "abs", "sqrt", "pow", "ceil", "floor", "unique_ptr", "shared_ptr", "make_unique", "make_shared", "assert", "INT_MAX", "INT_MIN",
    "size_t", "NULL",
    ";", "}", "{", ")", "(", "]", "[", ":", ",", ">>", "<<", "=", "+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "&", "|", "^", "~", "++", "--", "+=", "-=", "*=", "/=", "->", ".", "::",
)
KEPT_FRAGMENTS = ("vector", "string", "map", "set", "pair", "tuple", "ostream", "istream")
LOCATION_PREFIX = r"^(?:[A-Za-z]:)?[^:\r\n]+:\d+(?::\d+)?: (?:fatal )?(?:error|warning|note):\s*"
QUOTED = r"['`]([^'`\n]+)['`]"
UNDEFINED_REF = r"undefined reference to ['`\x22]?([^'\x22\n]+)['`\x22]?"


def _known(c: Column) -> Column:
    return c.isin(*KEPT_TOKENS)


def _mask_token(raw: Column) -> Column:
    t = strip(raw)
    words = F.regexp_extract_all(t, F.lit(r"([a-zA-Z_]\w*|[*&]+)"), F.lit(1))
    head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    keep = (t.startswith("-W") | t.startswith("std::") | _known(t)
            | t.rlike("|".join(KEPT_FRAGMENTS))
            | ((F.size(words) > 0) & F.forall(words, _known)))
    typed = (F.size(words) >= 2) & F.forall(head, _known)
    return (F.when(keep, F.concat(F.lit("'"), t, F.lit("'")))
            .when(typed, F.concat(F.lit("'"), F.array_join(head, " "), F.lit(" <ID>'")))
            .otherwise(F.lit("'<ID>'")))


def classifier_form(c: Column) -> Column:
    """Diagnostic text with locations, addresses, numbers and user names masked."""
    msg = F.regexp_replace(strip(c), LOCATION_PREFIX, "")
    symbol = F.regexp_extract(F.regexp_extract(msg, UNDEFINED_REF, 1), r"^[^(]*", 0)
    linker = F.when((symbol != "") & _known(symbol), F.concat(F.lit("undefined reference to '"), symbol, F.lit("'"))) \
        .otherwise(F.lit("undefined reference to '<ID>'"))
    m = F.regexp_replace(msg, r"\b0x[0-9a-fA-F]+\b", "<ADDR>")
    between = F.split(m, QUOTED)
    masked = F.transform(F.regexp_extract_all(m, F.lit(QUOTED), F.lit(1)), _mask_token)
    # text, token, text, token, ..., text: the token list is one shorter than the text list
    m = F.array_join(F.zip_with(between, masked, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
    m = F.regexp_replace(m, r"(?<![A-Za-z0-9_-])\d+(?![A-Za-z0-9_-])", "<NUM>")
    m = strip(F.regexp_replace(m, r"(?U)\s+", " "))
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(msg.contains("undefined reference to"), linker).otherwise(m))


# ---------------------------------------------------------------------------------------------
# Readable sentences.
def readable(c: Column) -> Column:
    """Friendly sentence for a raw message; the first fitting form wins."""
    msg = strip(c)
    f = "(?id)"

    def has(p: str) -> Column:
        return msg.rlike(f + p)

    def grp(p: str, i: int) -> Column:
        return F.regexp_extract(msg, f + p, i)

    exp = r"^expected\s+('.*?')\s*(after|before)?\s*(.*)"
    token = F.regexp_replace(grp(exp, 1), r"^['\x22]+|['\x22]+$", "")
    article = F.when(token.rlike("^[aeiouAEIOU]"), F.lit("an '")).otherwise(F.lit("a '"))
    named = F.concat(article, token, F.lit("'"))
    prep, ctx = grp(exp, 2), strip(grp(exp, 3))
    scope = r"^'(.+?)'\s+was not declared in this scope"
    undecl = r"^use of undeclared identifier '(.+?)'"
    conv = r"^(cannot convert|invalid conversion)\s+(?:from\s+)?'(.+?)'\s+to\s+'(.+?)'"
    call = r"^no matching function for call to '(.+?)'"
    again = r"^(redeclaration|redefinition) of '(.+?)'"
    undecl2 = r"^'(.+?)' has not been declared"
    sentence = F.concat(F.upper(F.substring(msg, 1, 1)), msg.substr(F.lit(2), F.length(msg)))
    return (
        F.when(msg == "", F.lit(""))
        .when(has(exp) & (prep != "") & (ctx != ""), F.concat(F.lit("The compiler expected "), named, F.lit(" "), prep, F.lit(" "), ctx, F.lit(".")))
        .when(has(exp) & (ctx != ""), F.concat(F.lit("The compiler expected "), named, F.lit(" ("), ctx, F.lit(").")))
        .when(has(exp), F.concat(F.lit("The compiler expected "), named, F.lit(".")))
        .when(has(scope), F.concat(F.lit("'"), grp(scope, 1), F.lit("' was used but has not been declared in this scope.")))
        .when(has(undecl), F.concat(F.lit("The identifier '"), grp(undecl, 1), F.lit("' was used before it was declared.")))
        .when(has(conv), F.concat(F.lit("A value of type '"), grp(conv, 2), F.lit("' cannot be used where '"), grp(conv, 3), F.lit("' is required.")))
        .when(has(call), F.concat(F.lit("No overload of '"), grp(call, 1), F.lit(
            "' matches the arguments you provided. Check the function signature and argument types.")))
        .when(has(again), F.concat(F.lit("'"), grp(again, 2), F.lit("' has already been "),
                                   F.when(F.lower(grp(again, 1)) == "redeclaration", "declared again").otherwise("defined again"),
                                   F.lit(" in this scope.")))
        .when(has(undecl2), F.concat(F.lit("'"), grp(undecl2, 1), F.lit("' is referenced but has not been declared.")))
        .when(has(r"return.*type|cannot.*return"), F.lit("The return value does not match the function's declared return type."))
        .when(sentence.endswith("."), sentence).otherwise(F.concat(sentence, F.lit("."))))


# ---------------------------------------------------------------------------------------------
# Secrets. Kind, pattern, severity; order is the order of masking.
SECRET_KINDS: tuple[tuple[str, str, str], ...] = (
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{20,}", "High"),
    ("groq_api_key", r"gsk_[0-9A-Za-z_\-]{20,}", "High"),
    ("openai_api_key", r"sk-[0-9A-Za-z_\-]{20,}", "High"),
    ("github_token", r"gh[pousr]_[0-9A-Za-z]{20,}", "High"),
    ("github_pat", r"github_pat_[0-9A-Za-z_]{20,}", "High"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", "High"),
    ("slack_token", r"xox[abprs]-[0-9A-Za-z\-]{10,}", "High"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "High"),
    ("jwt_token", r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", "High"),
    ("credential_assignment",
     r"(?i)(?:api_?key|secret|token|passwd|password|credential)[A-Za-z0-9_]*\s*[:=]\s*[\x22'][^\x22'\s]{8,}[\x22']",
     "Medium"),
)
ANY_SECRET = "(?:" + "|".join(p.replace("(?i)", "(?i:", 1) + ")" if p.startswith("(?i)") else p
                              for _, p, _ in SECRET_KINDS) + ")"


# Literals without which no secret pattern can match, as written and lower-cased.
SECRET_LITERALS = ("AIza", "gsk_", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "AKIA", "xox", "PRIVATE KEY", "eyJ")
SECRET_WORDS = ("api_key", "apikey", "secret", "token", "passwd", "password", "credential")


def has_any(c: Column, literals: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for x in literals:
        cond = cond | c.contains(x)
    return cond


def secret_hint(c: Column) -> Column:
    """Cheap superset of the secret patterns: plain substring tests, run before any regex."""
    return has_any(c, SECRET_LITERALS) | has_any(F.lower(c), SECRET_WORDS)


def holds_secret(c: Column) -> Column:
    return secret_hint(c) & c.rlike(ANY_SECRET)


def mask_secrets(c: Column) -> Column:
    for kind, pattern, _ in SECRET_KINDS:
        c = F.regexp_replace(c, pattern, f"[REDACTED:{kind}]")
    return c


# ---------------------------------------------------------------------------------------------
# Display safety. Control sequences and hidden characters.
CSI = r"\x1B\[[0-?]*[ -/]*[@-~]"
OSC = r"\x1B\](?:[^\x07\x1b]++|\x1b(?!\x5c))*+(?:\x07|\x1b\x5c)"
ESC_OTHER = r"\x1B[@-Z\\\-_]"
CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
HIDDEN = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


def safe_text(c: Column, limit: int | None = 2000) -> Column:
    """Text fit for a terminal: secrets masked, escapes and hidden characters removed.

    ``limit`` is the display cap of this function (None keeps the whole text)."""
    t = mask_secrets(F.coalesce(c, F.lit("")))
    for p in (CSI, OSC, ESC_OTHER, CONTROLS, BIDI, ZERO_WIDTH):
        t = F.regexp_replace(t, p, "")
    if limit is None:
        return t
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def html_text(c: Column, limit: int | None = 2000) -> Column:
    t = safe_text(c, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def neutralised(c: Column, limit: int | None = 2000) -> Column:
    """True when the escaped text holds no tag, escape, hidden character or secret."""
    t = html_text(c, limit)
    return ~(t.rlike("<[A-Za-z/!]") | t.contains("\x1b") | t.rlike(HIDDEN) | t.rlike(ANY_SECRET))


# key=value form and key formats of evidence redaction.
KEY_VALUE = (r"(?i)\b([A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)[A-Za-z0-9_]*\s*=\s*)"
             r"([\x22']?)(?:(?!\2)[^\s,;])+\2")
KEY_FORMATS = (r"AIza[0-9A-Za-z_\-]{20,}", r"gsk_[0-9A-Za-z_\-]{20,}", r"sk-[0-9A-Za-z_\-]{20,}", r"ghp_[0-9A-Za-z]{20,}")


def redact(c: Column, limit: int | None = 80) -> Column:
    """Evidence text: secrets masked, control characters blanked. ``limit`` is the display cap; findings carry the whole (None)."""
    t = mask_secrets(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, KEY_VALUE, "$1$2[REDACTED]$2")
    for p in KEY_FORMATS:
        t = F.regexp_replace(t, p, "[REDACTED_KEY]")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x1f\x7f-\x{9f}]", " "), r"(?U)\s+", " "))
    return t if limit is None else F.substring(t, 1, limit)


# ---------------------------------------------------------------------------------------------
def visible_lower(c: Column) -> Column:
    """Lower-cased text; zero-width characters dropped."""
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, r"[\x{200B}-\x{200F}\x{FEFF}]", "")))


def injection_form(c: Column) -> Column:
    """Lower-case words separated by single blanks, padded; zero-width characters dropped."""
    return F.concat(F.lit(" "), F.regexp_replace(visible_lower(c), "[^a-z0-9]+", " "), F.lit(" "))


def wrap_untrusted(c: Column, label: str, nonce: Column) -> Column:
    """Text between boundary markers; inner marker openings are defused."""
    body = F.replace(F.coalesce(c, F.lit("")), F.lit("<<<"), F.lit("< < <"))
    return F.concat(F.lit("<<<DATA:"), nonce, F.lit(f":{label}>>>\n"), body, F.lit("\n<<<END:"), nonce, F.lit(">>>"))


def boundary_leak(c: Column) -> Column:
    return F.coalesce(c.contains("<<<DATA") | c.contains("<<<END"), F.lit(False))


def finding_slug(c: Column) -> Column:
    """snake_case name of a finding type; both shell findings share one name."""
    t = F.regexp_replace(F.regexp_replace(c, "/+", " "), r"(?U)[^\w\s-]", "")
    s = F.lower(F.regexp_replace(F.regexp_replace(t, r"(?U)[\s\-_]+", "_"), "^_+|_+$", ""))
    return F.when(s.isin("command_injection", "process_execution"), F.lit("process_execution")).otherwise(s)


# ---------------------------------------------------------------------------------------------
# Comment and literal stripping for C-family source.
_CODE_TOKEN = (r"(?s)(//[^\n]*+"
               r"|/\*.*?(?:\*/|\z)"
               r'|(?:u8|[uUL])?R"([^\s()\\]{0,16})\(.*?(?:\)\2"|\z)'
               r'|"(?:[^"\\\n]|\\[^\n])*+(?:"|\\(?=\n|\z)|(?=\n|\z))'
               r"|'(?:[^'\\\n]|\\[^\n])*+(?:'|\\(?=\n|\z)|(?=\n|\z))"
               r"|[^/\x22'RuUL]++|.)")


def strip_code(c: Column) -> Column:
    """Source without comments, string and character literals; every line break survives.

    The text is cut into tokens by one alternation (comment, raw string, literal, plain run);
    comments and raw strings shrink to the line breaks inside them.
    """
    tokens = F.regexp_extract_all(c, F.lit(_CODE_TOKEN), F.lit(1))

    def keep(t: Column) -> Column:
        return (F.when(t.startswith("//"), F.lit(""))
                .when(t.startswith("/*") | t.rlike('^(?:u8|[uUL])?R"'), F.regexp_replace(t, "[^\n]", ""))
                .when(t.rlike("^[\x22']"), F.lit(""))
                .otherwise(t))

    cut = F.array_join(F.transform(tokens, keep), "")
    return F.when(has_any(c, ('"', "'", "//", "/*")), cut).otherwise(c)  # else every token is plain
