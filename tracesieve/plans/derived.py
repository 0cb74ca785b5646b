"""Log and source lines derived from the order lines, so that code operators have input that
grows with the tables. The CASE texts are plain SQL and are shared with the SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import numbered
from tracesieve.session import share

# One file (and one log) per supplier and line number; its lines are ordered by order key.
_V = "CAST(k % 5 AS STRING)"


def _at(sep: str = ":") -> str:
    return ("'src/m' || CAST(file AS STRING) || '.cpp:' || CAST(k % 90 + 1 AS STRING) || ':' "
            "|| CAST(k % 17 + 1 AS STRING) || ': ")


LOG_LINES: tuple[str, ...] = (
    _at() + "error: expected '';'' before ''return'''",
    _at() + "warning: unused variable ''tmp_' || CAST(k % 50 AS STRING) || ''' [-Wunused-variable]'",
    _at() + "error: ''cout'' was not declared in this scope'",
    _at() + "error: ''item_' || CAST(k % 40 AS STRING) || ''' was not declared in this scope'",
    _at() + "note: candidate: void foo(int)'",
    _at() + "fatal error: part_' || CAST(k % 9 AS STRING) || '.h: No such file or directory'",
    "'Undefined symbols for architecture x86_64:'",
    "'  \"_fn_' || CAST(k % 60 AS STRING) || '\", referenced from:'",
    "'ld: symbol(s) not found for architecture x86_64'",
    "'main.o: undefined reference to `calc_' || CAST(k % 30 AS STRING) || ''''",
    _at() + "error: cannot convert ''std::string'' to ''int'' in return'",
    _at() + "error: redefinition of ''int counter'''",
    _at() + "error: ''int Box::w'' is private within this context'",
    _at() + "warning: control reaches end of non-void function [-Wreturn-type]'",
    _at() + "error: invalid conversion from ''const char*'' to ''char*'' [-fpermissive]'",
    _at() + "error: no matching function for call to ''print(int, double)'''",
    "'   ' || CAST(k AS STRING) || ' |     return x;'",
    "'      |     ^~~~~~'",
    "'src/m' || CAST(file AS STRING) || '.cpp: In function ''int main()'':'",
    "'lib/u.hpp:' || CAST(k % 33 AS STRING) || ': warning: comparison is always true at ' || CAST(k % 12 AS STRING) || ' of 0x7ff' || CAST(k % 10 AS STRING)",
    _at() + "warning: division by zero [-Wdiv-by-zero]'",
    _at() + "warning: ''x'' may be used uninitialized in this function [-Wmaybe-uninitialized]'",
    "'collect2: error: ld returned 1 exit status'",
    _at() + "warning: statement has no effect [-Wunused-value]'",
    _at() + "error: use of undeclared identifier ''vector'''",
    "'make: *** [all] Error ' || CAST(k % 3 AS STRING)",
)

CODE_LINES: tuple[str, ...] = (
    "'int main() {'",
    "'}'",
    f"'for (int i = 0; i < n; i++) {{'",
    "'}'",
    f"'int arr' || {_V} || '[' || CAST(k % 20 + 2 AS STRING) || '];'",
    f"'arr' || {_V} || '[' || CAST(k % 23 AS STRING) || '] = 1;'",
    f"'free(p' || {_V} || ');'",
    f"'*p' || {_V} || ' = 3;'",
    f"'#define CALL' || {_V} || ' gets'",
    f"'CALL' || {_V} || '(buf);'",
    "'gets(buf);'",
    "'strcpy(dst, src); // copy the name'",
    "'system(\"ls -l\"); // shell'",
    f"'#include <' || CASE CAST(k % 4 AS INT) WHEN 0 THEN 'vector' WHEN 1 THEN 'sys/types.h' WHEN 2 THEN 'unistd.h' ELSE 'curl/curl.h' END || '>'",
    f"'int v' || {_V} || ';'",
    f"'v' || {_V} || ' = 4;'",
    f"'total += v' || {_V} || ';'",
    f"'int* q' || {_V} || ' = nullptr;'",
    f"'*q' || {_V} || ' = 1;'",
    f"'if (q' || {_V} || ' != nullptr) {{'",
    "'}'",
    "'int token_seed = rand();'",
    "'// TODO: check the password before login'",
    f"'char* d' || {_V} || ' = (char*)malloc(' || CAST(k AS STRING) || ');'",
    f"'helper' || {_V} || '(x);'",
    f"'void helper' || {_V} || '(int a) {{'",
    "'}'",
    "'printf(msg);'",
    f"'int big' || {_V} || '[' || CAST(k * 1000000 AS STRING) || '];'",
    "'FILE* f = fopen(\"/etc/passwd\", \"r\");'",
    "'while (true) { spin(); }'",
    f"'items' || {_V} || '.push_back(v1);'",
    f"'std::vector<int> items' || {_V} || ';'",
    "'cout << x << endl;'",
    "'/* system(\"rm\") gets(buf); */ int y = 2;'",
    "'char* t = getenv(\"API_TOKEN\");'",
    "'int z = 10 / 0;'",
    "'memcpy(a, b, 64);'",
    "'assert(x > 0);'",
    "'x = atoi(s);'",
    "'#error expected '';'' before ''return'''",
    "'int w' || CAST(k % 3 AS STRING) || ' = 0;'",
    "'r = a / w' || CAST(k % 3 AS STRING) || ';'",
    f"'delete d' || {_V} || ';'",
    f"'free(d' || {_V} || ');'",
    f"'Node* nd' || {_V} || ' = new Node();'",
    "'fclose(f);'",
    f"'int helper' || {_V} || '(int a) {{ return helper' || {_V} || '(a - 1); }}'",
    f"'unsigned u' || {_V} || ' = 0;'",
    f"'u' || {_V} || '--;'",
    f"'if (i < u' || {_V} || ') {{'",
    "'}'",
    f"'vector<int> vv' || {_V} || ' = {{1, 2, 3}};'",
    f"'vv' || {_V} || '[' || CAST(k % 6 AS STRING) || '] = 1;'",
    f"'return &v' || {_V} || ';'",
    "'#include \"CON.h\"'",
    "'while (1) {'",
    "'}'",
    "'break;'",
    "'void show(std::string name) {'",
    "'}'",
    "'name = name + suffix;'",
    "'label = prefix + name;'",
    "'for (size_t j = 0; j < strlen(name); ++j) {'",
    "'}'",
    "'for (std::string part : parts) {'",
    "'}'",
    f"'items' || {_V} || '.reserve(64);'",
    "'int merged(std::vector<int> left, std::map<int, int> seen, int n) { return merged(left, seen, n / 2); }'",
    "'int fib(int n) { return fib(n - 1) + fib(n - 2); }'",
    "'void walk(Node* node) { walk(node->left); }'",
    "'std::sort(items0.begin(), items0.end());'",
    "'std::map<int, int> seen;'",
    f"'#define STEP CALL' || {_V} || ' CALL' || {_V}",
    "'#define TWICE(x) STEP x x'",
    "'#define DEEP(x) TWICE(x) TWICE(x) x x x'",
    "'#define BLAST(x) DEEP(x) DEEP(x) DEEP(x) DEEP(x) DEEP(x) x'",
    "'#define ROUND TURN TURN'",
    "'#define TURN(y) ROUND TWICE(y) y'",
    "'TWICE(TWICE(b));'",
    f"'double grid' || {_V} || '[' || CAST(k % 3000 AS STRING) || '];'",
)


def case_text(lines: tuple[str, ...], key: str = "k") -> str:
    arms = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(lines))
    return f"CASE CAST({key} % {len(lines)} AS INT) {arms} END"


def line_text(lines: tuple[str, ...], key: str = "k") -> str:
    """The text `case_text` gives for a key, with ``k`` in its texts: halves of the table are tried instead of one line after the other.

    To be used inside a lambda: as part of a generated stage the whole table would be one method, too long for the JVM to compile.
    """
    def half(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return lines[lo]
        mid = (lo + hi) // 2
        return f"CASE WHEN CAST({key} % {len(lines)} AS INT) < {mid} THEN {half(lo, mid)} ELSE {half(mid, hi)} END"
    return f"CASE WHEN {key} >= 0 THEN {half(0, len(lines))} WHEN {key} % {len(lines)} = 0 THEN {lines[0]} END"


FILES_SQL = """
files AS (
  SELECT l_suppkey * 10 + l_linenumber AS file, l_orderkey AS ord, min(l_partkey) AS k
  FROM lineitem GROUP BY 1, 2),
numbered AS (
  SELECT file, k, row_number() OVER (PARTITION BY file ORDER BY ord) AS line_no FROM files)
"""
LOGS_SQL = f"{FILES_SQL}, logs AS (SELECT file, line_no, k, {case_text(LOG_LINES)} AS line FROM numbered)"
CODE_SQL = f"{FILES_SQL}, code AS (SELECT file, line_no, k, {case_text(CODE_LINES)} AS raw FROM numbered)"

# Lines per chunk of the ordered helpers.
LINE_CHUNK = 4096


def line_chunk(col: str = "line_no"):
    return F.floor(F.col(col) / F.lit(LINE_CHUNK))


def _numbered(lineitem: DataFrame) -> DataFrame:
    """(file, line_no, k). Callers that read it more than once share it, or what they make of it: as columns in memory it is a fraction of a checkpoint's cost."""
    rows = lineitem.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("file"), F.col("l_orderkey").alias("ord"), "l_partkey")
    return numbered(rows, "file", "ord", [F.min("l_partkey").alias("k")], "line_no").select("file", "line_no", "k")


def log_lines(lineitem: DataFrame) -> DataFrame:
    """(file, line_no, k, line) of compiler logs."""
    return share(_numbered(lineitem)).withColumn("line", F.expr(f"transform(array(k), k -> {line_text(LOG_LINES)})[0]"))


def code_lines(lineitem: DataFrame) -> DataFrame:
    """(file, line_no, k, raw) of C-like source."""
    return _numbered(lineitem).withColumn("raw", F.expr(f"transform(array(k), k -> {line_text(CODE_LINES)})[0]"))
