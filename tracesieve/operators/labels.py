"""Rule labelling of diagnostic messages.

Each rule set is a table of fixed values compiled to one CASE chain; messages never leave the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.rules import any_of, bound, first_match

# fixed values: the nine canonical categories, in report order
CATEGORIES = ("syntax_error", "name_resolution", "missing_include", "type_error", "return_type_error",
              "redefinition", "access_error", "linker_error", "other")

# fixed values: spelling variants of category names
CATEGORY_ALIASES = {
    "name_resolution": "name_resolution", "function_error": "type_error", "linker_error": "linker_error",
    "warning": "other", "syntax_error": "syntax_error", "type_error": "type_error",
    "missing_include": "missing_include", "redefinition": "redefinition", "access_error": "access_error",
    "return_type_error": "return_type_error", "unused_variable": "unused_variable", "other": "other",
}


def canonical_category(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit("other"))


# ---------------------------------------------------------------------------------------------
# Corpus labelling: ordered case-insensitive patterns, first match wins. Fixed values.
CORPUS_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("missing_include", ("No such file or directory", r"fatal error:.*\.h[>']?", "cannot open (source|include) file",
                         "file not found", "compilation terminated")),
    ("redefinition", ("redefinition of", "already defined", "previous definition", "multiple definition")),
    ("access_error", ("read-only", "cannot assign to", "is private", "is protected", "member is inaccessible",
                      "assignment of read-only", "discards qualifiers", "cannot modify", r"const\b.*\bqualified")),
    ("return_type_error", ("cannot convert.* in return", "return.* incompatible type", "return type.*mismatch",
                           "void.*return.*value", "non-void.* returns", "return-type", "return statement.*void",
                           "returning.* from.*incompatible", "must return 'int'", "main.*must return",
                           "function.*should return")),
    ("linker_error", ("undefined reference", "undefined symbol", "unresolved external", "linker command failed",
                      "ld returned")),
    ("name_resolution", ("was not declared in this scope", "undeclared", "use of undeclared identifier",
                         "unknown type name", "identifier.*not found", "is not (a member|defined)", "did you mean",
                         "implicit declaration of function")),
    ("type_error", ("cannot convert", "invalid conversion", "incompatible type", "no matching function", "no viable",
                    "invalid operands", "ambiguous", "does not match", "overload.*not viable", "wrong number of",
                    "cannot be used", "invalid use of", "operand.*type", "narrowing conversion",
                    "implicit conversion", "cannot initialize", "array subscript is not",
                    "indirection requires pointer", "invalid application of 'sizeof'", "pointer operand",
                    "subscript.*not.*integer", "invalid type argument", "is not a pointer", "cannot take address",
                    "initializing.*incompatible", "assigning.*incompatible", "rvalue of type", "lvalue of type",
                    r"error:.*\btype\b")),
    ("syntax_error", ("expected", "parse error", "syntax error", "unexpected", "unterminated", "stray", "unmatched",
                      "missing terminating", "at end of input", "before.*token", "illegal start",
                      "not a statement", "extraneous")),
)


def corpus_label(c: Column) -> Column:
    return first_match([(c.rlike("(?i)" + "|".join(p)), cat) for cat, p in CORPUS_RULES], "other")


# ---------------------------------------------------------------------------------------------
# Balanced-set labelling: lower-cased phrases with two conditioned rules. Fixed values.
PHRASES_INCLUDE = ("file not found", "no such file or directory", "cannot open include file", "#include expects",
                   "did you forget to '#include")
PHRASES_LINK = ("undefined reference to", "ld returned", "linker error", "unresolved external symbol",
                "symbol(s) not found", "cannot find -l", "multiple definition of", "relocation truncated")
PHRASES_ACCESS = ("is private", "is protected", "inaccessible", "cannot access", "assignment of read-only",
                  "read-only variable", "read-only location", "passing 'const' as 'this' argument discards qualifiers")
PHRASES_RETURN = ("control reaches end of non-void function", "no return statement", "return-type defaults to",
                  "return with a value, in function returning void", "return with no value, in function returning",
                  "void function should not return a value", "non-void function should return a value",
                  "incompatible return type", "cannot convert", "in return")
PHRASES_REDEFINE = ("redefinition of", "conflicting types for", "already defined", "previous definition of",
                    "redeclaration of")
PHRASES_NAME = ("undeclared", "not declared", "unknown type name", "cannot be used as a type",
                "has not been declared", "is not a member of", "did you mean")
PHRASES_TYPE = ("cannot convert", "invalid conversion", "incompatible type", "incompatible pointer",
                "invalid operands", "no matching function for call", "too many arguments to function",
                "too few arguments to function", "subscripted value is not an array", "called object",
                "is not a function", "indirection requires pointer", "array subscript is not",
                "format specifies type", "invalid cast", "cannot be applied to", "assigning to", "initializing")
PHRASES_SYNTAX = ("expected ';'", "expected ')'", "expected '}'", "expected '{'", "expected ']' ",
                  "expected expression", "expected identifier", "expected declaration", "expected unqualified-id",
                  "missing terminating", "stray '", "parse error", "extraneous closing brace", "expected before",
                  "expected after", "before numeric constant", "before string constant", "expected initializer",
                  "expected primary-expression")


def phrase_label(c: Column) -> Column:
    return bound(F.lower(c), lambda m: first_match([
        (any_of(m, PHRASES_INCLUDE), "missing_include"),
        (m.contains("multiple definition of"), "redefinition"),
        (any_of(m, PHRASES_LINK), "linker_error"),
        (any_of(m, PHRASES_ACCESS), "access_error"),
        (any_of(m, PHRASES_RETURN) & any_of(m, ("return", "void")), "return_type_error"),
        (any_of(m, PHRASES_REDEFINE), "redefinition"),
        (any_of(m, PHRASES_NAME), "name_resolution"),
        (any_of(m, PHRASES_TYPE), "type_error"),
        (any_of(m, PHRASES_SYNTAX), "syntax_error"),
    ], "other"))


def recheck_label(c: Column, given: Column) -> Column:
    """Rule label where a rule speaks; else the given one. Non-ASCII and short rows give NULL."""
    def checked(msg: Column) -> Column:
        final = bound(phrase_label(msg), lambda rule: F.when(rule != "other", rule).otherwise(given))
        usable = (F.length(msg) >= 4) & ~msg.rlike(r"[^\x00-\x7F]")
        return F.when(usable, bound(final, lambda f: F.when(f.isin(*CATEGORIES), f)))

    return bound(F.regexp_replace(c, r"^\s+|\s+$", ""), checked)


# ---------------------------------------------------------------------------------------------
# Verified labelling: NULL when no rule is certain. Symbols with a standard header.
SYMBOL_HEADERS = {
    "cout": "iostream", "cin": "iostream", "cerr": "iostream", "endl": "iostream", "ostream": "iostream",
    "istream": "iostream", "printf": "cstdio", "scanf": "cstdio", "fprintf": "cstdio", "string": "string",
    "getline": "string", "vector": "vector", "map": "map", "set": "set", "unordered_map": "unordered_map",
    "unordered_set": "unordered_set", "list": "list", "queue": "queue", "stack": "stack", "deque": "deque",
    "array": "array", "pair": "utility", "tuple": "tuple", "optional": "optional", "sort": "algorithm",
    "find": "algorithm", "max": "algorithm", "min": "algorithm", "reverse": "algorithm", "count": "algorithm",
    "fill": "algorithm", "copy": "algorithm", "abs": "cmath", "sqrt": "cmath", "pow": "cmath", "ceil": "cmath",
    "floor": "cmath", "unique_ptr": "memory", "shared_ptr": "memory", "make_unique": "memory",
    "make_shared": "memory", "assert": "cassert", "INT_MAX": "climits", "INT_MIN": "climits", "size_t": "cstddef",
    "nullptr": "", "NULL": "cstdlib",
}
SCOPE_SYMBOL = r"['`]([a-zA-Z_0-9:]+)['`] was not declared in this scope"
UNDECLARED_SYMBOL = r"use of undeclared identifier ['`]([a-zA-Z_0-9:]+)['`]"
VERIFIED_ACCESS = ("is private within this context", "is protected within this context", "assignment of read-only",
                   "discards qualifiers")
VERIFIED_RETURN = ("[-wreturn-type]", "control reaches end of non-void function",
                   "no return statement in function returning non-void",
                   "return with a value, in function returning void", "return with no value, in function returning",
                   "return-statement with no value", "'main' must return 'int'")
VERIFIED_REDEFINE = ("redefinition of", "redeclaration of", "conflicting declaration", "multiple definition of")
VERIFIED_OTHER = ("[-wunused-variable]", "[-wunused-but-set-variable]", "[-wunused-parameter]", "[-wsign-compare]",
                  "[-wparentheses]", "[-wdiv-by-zero]", "[-wempty-body]", "division by zero")
VERIFIED_TYPE = ("cannot convert", "invalid conversion", "invalid operands of types", "no matching function for call",
                 "too few arguments to function", "too many arguments to function",
                 "subscripted value is neither array nor pointer", "subscripted value is not an array",
                 "cannot be used as a function", "invalid use of void", "no match for 'operator", "could not convert")
VERIFIED_NAME = ("does not name a type", "is not a member of", "has no member named", "has not been declared")
VERIFIED_SYNTAX = ("expected", "stray", "missing terminating", "unterminated",
                   "two or more data types in declaration specifiers")


def undeclared_symbol(c: Column) -> Column:
    """Last ``::`` part of the undeclared name a message reports; '' where it reports none."""
    full = F.coalesce(F.nullif(F.regexp_extract(c, SCOPE_SYMBOL, 1), F.lit("")),
                      F.regexp_extract(c, UNDECLARED_SYMBOL, 1))
    return F.element_at(F.split(full, "::"), -1)


def verified_label(c: Column) -> Column:
    return bound(c, lambda t: bound(F.lower(t), lambda m: _verified(t, m)))


def _verified(c: Column, m: Column) -> Column:
    has_symbol = c.rlike(SCOPE_SYMBOL) | c.rlike(UNDECLARED_SYMBOL)
    return first_match([
        (any_of(c, ("undefined reference to", "ld returned 1 exit status")), "linker_error"),
        (any_of(m, ("no such file or directory", "did you forget to '#include", 'expects "filename"'))
         | any_of(c, ("is not a member of 'std'", "is not a member of std")), "missing_include"),
        (has_symbol & undeclared_symbol(c).isin(*SYMBOL_HEADERS), "missing_include"),
        (has_symbol, "name_resolution"),
        (any_of(m, VERIFIED_ACCESS), "access_error"),
        (any_of(m, VERIFIED_RETURN) | (m.contains("in return") & any_of(m, ("cannot convert", "invalid conversion"))),
         "return_type_error"),
        (any_of(m, VERIFIED_REDEFINE), "redefinition"),
        (any_of(m, VERIFIED_OTHER), "other"),
        (any_of(m, VERIFIED_TYPE) | (m.contains("request for member") & m.contains("in something not a structure")),
         "type_error"),
        (any_of(m, VERIFIED_NAME), "name_resolution"),
        (any_of(m, VERIFIED_SYNTAX), "syntax_error"),
    ], None)


# ---------------------------------------------------------------------------------------------
# Keyword ranking. Fixed values, in rule order.
KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("missing_include", ("'std::", "was not declared", "no member named", "#include")),
    ("syntax_error", ("expected ';'", "expected ')'", "expected '{'", "parse error", "stray", "expected '}'")),
    ("name_resolution", ("undeclared", "not declared", "undefined", "cannot find", "was not declared in this scope")),
    ("type_error", ("cannot convert", "invalid conversion", "no matching function", "incompatible",
                    "invalid operands", "cannot be used as a function")),
    ("return_type_error", ("return type", "no return", "control reaches end", "missing return")),
    ("redefinition", ("redefinition", "already defined", "multiple definition")),
    ("linker_error", ("undefined reference", "linker", "ld returned")),
    ("access_error", ("is private", "is protected", "inaccessible", "read-only", "assignment of read-only")),
)


def keyword_candidates(c: Column) -> Column:
    """Array of (neg, ord, category, best) of the categories with at least one hit, most hits (-neg) first, then in rule order;
    one ('other', 0) entry when none. The text is lower-cased once and each keyword is looked for once."""
    def found(low: Column) -> Column:
        hits = [sum((low.contains(k.lower()).cast("int") for k in kws), F.lit(0)) for _, kws in KEYWORDS]
        entries = F.array(*[F.struct((-h).alias("neg"), F.lit(i).alias("ord"), F.lit(cat).alias("category"))
                            for i, (h, (cat, _)) in enumerate(zip(hits, KEYWORDS))])
        return F.array_sort(F.filter(entries, lambda e: e["neg"] < 0))

    none = F.array(F.struct(F.lit(0).alias("neg"), F.lit(len(KEYWORDS)).alias("ord"), F.lit("other").alias("category")))
    some = bound(bound(F.lower(c), found), lambda f: F.when(F.size(f) > 0, f).otherwise(none))
    return bound(some, lambda f: F.transform(f, lambda e: F.struct(e["neg"].alias("neg"), e["ord"].alias("ord"), e["category"].alias("category"),
                                                                   (-f[0]["neg"]).alias("best"))))


def keyword_rank(df: DataFrame, id_col: str, text: str, top: int | None = None) -> DataFrame:
    """Ranked categories per message: (id, category, hits, score, rank); ties in rule order.

    Ranking happens inside the row's candidate array, so no shuffle is needed.
    """
    ranked = keyword_candidates(F.col(text))
    hits, best = -F.col("__e.neg"), F.col("__e.best")
    return (df.select(id_col, F.posexplode(F.slice(ranked, 1, top) if top else ranked).alias("__p", "__e"))
            .select(id_col, F.col("__e.category").alias("category"), hits.alias("hits"),
                    F.when(best == 0, F.lit(0.45)).otherwise(F.round(F.lit(0.5) + F.lit(0.45) * hits / best, 3)).alias("score"),
                    (F.col("__p") + 1).alias("rank")))


# ---------------------------------------------------------------------------------------------
# Fixed-confidence overrides ahead of the model. Fixed values.
OVERRIDE_PHRASES: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    ("missing_closing_brace", 1.0, ("a function-definition is not allowed here",)),
    ("uninitialized_memory", 0.98, ("used uninitialized", "is uninitialized when used here",
                                    "uninitialized when used here", "wuninitialized", "uninitialized variable")),
    ("unused_variable", 0.98, ("set but not used", "unused variable", "unused but set variable",
                               "declared but never used", "-wunused-but-set-variable", "-wunused-variable")),
    ("missing_include", 0.99, ("no such file or directory",)),
)
OVERRIDE_TAIL: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    ("name_resolution", 0.95, ("has not been declared", "does not name a type")),
    ("syntax_error", 0.99, ("expected ';'", "expected ')'", "expected '}'", "expected '{'", "expected ']'",
                            "expected primary-expression", "expected unqualified-id", "expected initializer", "stray ",
                            "missing terminating", "break statement not within", "continue statement not within",
                            "assignment used as truth value", "suggest parentheses around assignment",
                            "parentheses around assignment")),
    ("unused_variable", 0.99, ("unused parameter", "unused but set")),
    ("type_error", 0.99, ("array subscript is not an integer", "subscripted value is not an array",
                          "invalid operands of types", "invalid cast from type", "cannot convert",
                          "invalid conversion", "incompatible types", "static_cast", "reinterpret_cast",
                          "invalid use of void", "sizeof' to a function", "no matching function for call",
                          "no matching constructor", "template deduction", "cannot bind non-const lvalue")),
    ("access_error", 0.99, ("assignment of read-only", "is private within this context", "is protected")),
    ("redefinition", 0.99, ("redefinition of", "multiple definition of", "previous definition of",
                            "conflicting declaration")),
    ("return_type_error", 0.99, ("return-statement with a value, in function returning 'void'",
                                 "return-statement with no value, in function returning",
                                 "no return statement in function returning non-void",
                                 "control reaches end of non-void function")),
)
STANDARD_SYMBOLS = (
    "cout", "cin", "cerr", "endl", "string", "vector", "map", "set", "unordered_map", "unordered_set", "list", "queue", "stack",
    "deque", "array", "pair", "tuple", "sort", "find", "max", "min", "reverse", "count", "fill", "copy", "abs", "sqrt", "pow",
    "ceil", "floor", "unique_ptr", "shared_ptr", "make_unique", "make_shared", "strlen", "strcpy", "strcmp", "strcat", "memset",
    "memcpy", "memmove", "printf", "scanf", "fprintf", "puts", "fopen", "fclose", "sprintf", "snprintf", "INT_MAX", "INT_MIN",
    "size_t")
QUOTED_STANDARD = ("cout", "cin", "vector", "string", "endl", "sort", "printf", "strlen")
FIRST_SYMBOL = r"['\x{2018}]([a-zA-Z_]\w*)['\x{2019}]"


def override(c: Column) -> Column:
    """struct(category, confidence) fixed by rule, or NULL when the model must decide."""
    return bound(c, lambda t: bound(F.lower(t), lambda low: _override(t, low)))


def _override(c: Column, low: Column) -> Column:
    def pair(cat: str, conf: float) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(conf).alias("confidence"))

    undeclared = any_of(low, ("was not declared in this scope", "undeclared identifier"))
    standard = F.regexp_extract(c, FIRST_SYMBOL, 1).isin(*STANDARD_SYMBOLS) \
        | any_of(low, [f"'{s}'" for s in QUOTED_STANDARD])
    out = None
    for cat, conf, phrases in OVERRIDE_PHRASES:
        cond = any_of(low, phrases)
        out = F.when(cond, pair(cat, conf)) if out is None else out.when(cond, pair(cat, conf))
    out = out.when(undeclared & standard, pair("missing_include", 0.99)).when(undeclared, pair("name_resolution", 0.99))
    for cat, conf, phrases in OVERRIDE_TAIL:
        out = out.when(any_of(low, phrases), pair(cat, conf))
    return F.when(F.length(c) > 0, out)


def folded(c: Column) -> Column:
    """Override labels as evaluation sees them: unknown names fold to 'other'."""
    return canonical_category(c)


# ---------------------------------------------------------------------------------------------
# Diagnostic risk. Pattern, risk, CWE, CERT rule.
RISK_RULES: tuple[tuple[str, str, str | None, str | None], ...] = (
    (r"unused variable|variable .+ set but not used", "Low", "CWE-563", "MSC13-C"),
    (r"may be used uninitialized", "High", "CWE-457", "EXP33-C"),
    (r"division by zero", "High", "CWE-369", "INT33-C"),
    (r"invalid conversion", "Medium", "CWE-195", "INT31-C"),
    (r"assignment of read-only location", "Medium", "CWE-670", "MSC11-C"),
    (r"undefined reference", "Low", None, None),
)


def diagnostic_risk(c: Column) -> tuple[Column, Column, Column]:
    """(risk, cwe, cert): first rule wins; 'Low' by default, 'None' for an empty message."""
    conds = [c.rlike("(?i)" + p) for p, *_ in RISK_RULES]
    risk = first_match([(c.isNull() | (c == ""), "None")] + [(k, r[1]) for k, r in zip(conds, RISK_RULES)], "Low")
    cwe = first_match([(k, r[2]) for k, r in zip(conds, RISK_RULES)], None)
    cert = first_match([(k, r[3]) for k, r in zip(conds, RISK_RULES)], None)
    return risk, cwe, cert


# Diagnostic findings: every matching rule gives one. Fixed values.
DIAGNOSTIC_FINDINGS: tuple[tuple[str, str, str], ...] = (
    (r"unused variable|variable .+ set but not used", "Low", "Unused Variable / Dead Code"),
    (r"may be used uninitialized", "High", "Uninitialized Memory"),
    (r"format not a string literal|format string is not a string literal", "High", "Format String Vulnerability"),
    (r"ignoring return value", "Medium", "Unchecked Return Value"),
    (r"comparison is always (?:true|false)", "Medium", "Logic Error / Integer Overflow Risk"),
    (r"integer overflow|overflow in expression|wraps around", "High", "Integer Overflow"),
    (r"deprecated", "Low", "Use of Deprecated API"),
    (r"conversion from .* may change sign", "Medium", "Signed/Unsigned Mismatch"),
    (r"array subscript is above array bounds|array subscript is below array bounds", "Critical", "Buffer Overflow"),
    (r"null pointer dereference", "High", "Null Pointer Dereference"),
)


def diagnostic_findings(df: DataFrame, text: str, *keep: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.array_compact(F.array(*[
        F.when(low.rlike(p), F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("finding_type")))
        for p, sev, kind in DIAGNOSTIC_FINDINGS]))
    return (df.where(low.rlike("|".join(p for p, *_ in DIAGNOSTIC_FINDINGS)))
            .select(*keep, F.explode(hits).alias("__f"))
            .select(*keep, "__f.severity", "__f.finding_type", F.lit("compiler_diagnostic").alias("found_by")))


# ---------------------------------------------------------------------------------------------
# Failure reasons. Fixed values; the last label of the table can never be reached and is left out.
FAILURE_REASONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("undeclared variable", ("was not declared in this scope", "use of undeclared identifier", "undeclared identifier",
                             "identifier not found", "is undefined")),
    ("integer overflow", ("integer overflow", "overflow in expression", "result is undefined")),
    ("division by zero", ("division by zero", "divide by zero")),
    ("stream operator", ("no match for 'operator<<'", "no match for 'operator>>'", "operand types are 'std::istream'",
                         "operand types are 'std::ostream'", "invalid operands to binary expression")),
    ("unused variable", ("set but not used", "unused variable", "unused but set variable", "declared but never used",
                         "-wunused-but-set-variable", "-wunused-variable")),
)


def failure_reason(c: Column) -> Column:
    return bound(F.lower(c), lambda low: first_match(
        [(any_of(low, p), n) for n, p in FAILURE_REASONS]
        + [(low.contains("expected") & low.contains(";"), "missing semicolon"),
           (any_of(low, ("cannot convert", "invalid conversion")), "wrong type"),
           (any_of(low, ("no return statement", "control reaches end of non-void function")), "missing return")],
        "other"))


# ---------------------------------------------------------------------------------------------
def blend(rules: DataFrame, model: DataFrame, id_col: str, top: int = 3) -> DataFrame:
    """Full outer join of two candidate lists; 0.35 r + 0.65 m, or 0.5 r where the model is silent."""
    j = rules.select(id_col, "category", F.col("score").alias("r")).join(
        model.select(id_col, "category", F.col("score").alias("m")), [id_col, "category"], "full_outer")
    r, m = F.coalesce("r", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    scored = j.select(id_col, "category", F.when(m > 0, F.lit(0.35) * r + F.lit(0.65) * m).otherwise(F.lit(0.5) * r).alias("blended"))
    w = Window.partitionBy(id_col).orderBy(F.col("blended").desc(), "category")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
