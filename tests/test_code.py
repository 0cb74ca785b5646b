import random

from pyspark.sql import functions as F

from tracesieve import session
from tracesieve.operators import execution as EX
from tracesieve.operators import findings as V
from tracesieve.operators import patches as P
from tracesieve.operators import quality as Q
from tracesieve.operators import structure as ST
from tracesieve.operators import weakness as W


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scopes_and_calls(spark, lines_of):
    src = lines_of(a="void g(int a) { use(a); }\nint f(int n) {\n  if (n) {\n    g(n);\n  }\n  ext(n); f(1);\n}\n}\nint x;")
    depth = {r.line_no: (r.depth, r.depth_after) for r in ST.with_depth(src).collect()}
    assert depth == {1: (0, 0), 2: (0, 1), 3: (1, 2), 4: (2, 2), 5: (2, 1), 6: (1, 1), 7: (1, 0), 8: (0, 0), 9: (0, 0)}
    assert found(ST.enclosing_scopes(src, src.where("line_no = 4")), "line_no", "depth", "open_line") == [(4, 1, 2), (4, 2, 3)]
    assert found(ST.call_graph(src), "fn", "callee", "internal") == [("f", "ext", False), ("f", "g", True), ("g", "use", False)]


def test_weaknesses(spark, lines_of):
    src = lines_of(
        rec="int f(int n) {\n  return f(n - 1);\n}\nint g(int n) {\n  if (n < 1) return 0;\n  return g(n - 1);\n}",
        dangle="int* f() {\n  int x = 1;\n  return &x;\n}",
        sign="void f() {\n  int a = 0;\n  unsigned b = 1;\n  if (a < b) { }\n}",
        leak="void f() {\n  char* p = (char*)malloc(8);\n}\nvoid g() {\n  char* p = (char*)malloc(8);\n  if (p) {\n    free(p);\n  }\n}\nFILE* top = fopen(a, b);",
        uninit="int x;\nint y;\ny = 2;\ncout << x;\ncout << x + y;",
        null="int* p = nullptr;\nif (p != nullptr) {\n  *p = 1;\n}\nint* q = NULL;\n*q = 1;",
        over="int m = INT_MAX;\nm += 1;\nunsigned u = 0;\nu--;\nint z = 0;\nr = a / z;\nif (k != 0) r = a / k;",
        vec="std::vector<int> v = {1, 2};\nv[1] = 0;\nv[2] = 0;",
        todo="gets(b);\n// FIXME later\nint a;\n// TODO nothing here\n// gets(x)\nchar* s = \"gets(b)\";")
    got = {}
    for f, l, k in found(W.all_weaknesses(src), "file", "line_no", "finding_type"):
        got.setdefault(f, set()).add((l, k))
    assert got["rec"] == {(2, "Infinite Recursion")} and got["dangle"] == {(3, "Dangling Pointer")}
    assert got["sign"] == {(4, "Signed/Unsigned Mismatch")} and got["leak"] == {(2, "Potential Memory Leak")}
    assert got["uninit"] == {(4, "Uninitialized Variable")} and got["null"] == {(6, "Null Pointer Dereference")}
    assert got["over"] == {(2, "Integer Overflow"), (4, "Integer Underflow"), (6, "Division by Zero")}
    assert got["vec"] == {(3, "Vector Out of Bounds")}
    assert got["todo"] == {(1, "Buffer Overflow"), (2, "Unresolved Security Debt")}


def test_structural_rules(spark, lines_of):
    src = lines_of(a="int a[4];\na[4] = 1;\na[3] = 1;\nint a[9];\na[8] = 2;", m="#define G gets\nint main() {\nG(buf);\n}",
                   d="free(p);\nfree(p);\n*p = 1;\n}\nfree(p);")
    assert found(W.array_bounds(src), "file", "line_no", "size") == [("a", 2, 4)]
    assert ("m", 3, "G", "gets", True) in found(W.dangerous_calls(src), "file", "line_no", "token", "target", "aliased")
    assert found(W.free_misuse(src), "file", "line_no", "finding_type") == [("d", 2, "Double Free"), ("d", 3, "Use After Free")]


def test_execution_and_resources(spark, lines_of):
    src = lines_of(a='system("ls");\n// system("no")\nfopen("/etc/passwd", "r");\nremove("x.txt");\nremove("../x");\n#include <sys/types.h>\n#define S system\nS("x");',
                   loop="while (true) { work(); }\nfor (;;) {\n  if (x) {\n    break;\n  }\n}\nwhile (1) {\n  spin();\n}",
                   big="char b[1 << 30];\nint c[1000 * 1000];\nmalloc(268435456);\nv.resize(300000000);")
    ex = found(EX.execution_findings(src).where("file = 'a'"), "line_no", "category", "severity")
    assert ex == [(1, "process_execution", "High"), (3, "sensitive_file_access", "High"), (4, "destructive_file_op", "Medium"),
                  (5, "destructive_file_op", "High"), (6, "unsafe_include", "High"), (7, "obfuscation", "High")]
    assert found(EX.alias_calls(src), "file", "line_no") == [("a", 8)]
    assert found(EX.endless_loops(src), "file", "line_no") == [("loop", 1), ("loop", 7)]
    assert found(EX.huge_allocations(src), "line_no", "form") == [(1, "array"), (3, "malloc"), (4, "resize")]


def test_macro_bomb(spark, lines_of):
    chain = "#define A0 x\n" + "\n".join(f"#define A{i} A{i-1} A{i-1} A{i-1} A{i-1}" for i in range(1, 9))
    twice = "\n".join([f"#define D{i}(a) D{i-1}(a a) D{i-1}(a)" if i else "#define D0(a) a a" for i in range(0, 7)])
    rows = {r.file: r for r in EX.macro_bombs(lines_of(chain=chain, calm="#define ONE 1\n#define TWO ONE", twice=twice)).collect()}
    assert rows["chain"].bomb and rows["chain"].depth == 9 and rows["chain"].fanout == 4
    assert not rows["calm"].bomb and rows["calm"].depth == 2
    # growth of the doubling chain: product of parameter multipliers over all expansion paths
    g = {0: 2.0}
    for i in range(1, 7):
        g[i] = 3.0 * g[i - 1] ** 2
    import math
    assert abs(rows["twice"].log10_growth - math.log10(g[6])) < 1e-3


def test_headers(spark, lines_of):
    s = lines_of(top='#include "a.h"\n#include "big.h"', a='#include "b.h"\nsystem("x");', b='popen("y");\n#include "a.h"', big='system("z");')
    inc = s.where(F.col("raw").startswith("#include")).select("file", "line_no", F.regexp_extract("raw", '"(\\w+)', 1).alias("header"))
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("big", 300 * 1024)], "file string, bytes bigint")
    got = found(EX.header_findings(inc, EX.execution_findings(s), sizes, max_bytes=256 * 1024).where("file = 'top'"), "line_no", "header", "category")
    assert got == [(1, "a", "process_execution"), (1, "b", "process_execution")]


def test_quality_and_complexity(spark, lines_of):
    s = lines_of(q="void f(std::string s, const std::string& t) {\n  std::vector<int> v;\n  for (int i = 0; i < strlen(p); i++) {\n    for (int j = 0; j < n; j++) {\n      v.push_back(j); cout << endl;\n      s = s + \"x\";\n    }\n  }\n  cout << endl;\n}",
                 calm="int main() { return 0; }", sorts="void f() {\n  for (int i = 0; i < n; i++) {\n    g();\n  }\n  std::sort(a, b);\n}")
    hints = found(Q.quality_hints(s), "file", "line_no", "hint", "weight")
    assert {h[1:] for h in hints if h[0] == "q"} == {
        (1, "pass_by_value", 1), (3, "strlen_in_loop_condition", 2), (4, "nested_loops", 2), (5, "endl_in_loop", 1),
        (5, "push_back_without_reserve", 1), (6, "string_concat_in_loop", 1)}
    levels = {r.file: r.level for r in Q.quality_level(s.select("file").distinct(), Q.quality_hints(s)).collect()}
    assert levels == {"q": "Needs work", "calm": "Good", "sorts": "Good"}
    cx = {r.file: (r.loop_depth, r.time_class) for r in Q.complexity(s.select("file").distinct(), s).collect()}
    assert cx == {"q": (2, "O(n²)"), "calm": (0, "O(1)"), "sorts": (1, "O(n log n)")}


def test_patch_rules(spark):
    orig = "int a;\nif (p == nullptr) return;\nb();\nc();\nd();\ne();"
    cases = {"mute": (orig, "int a;\nif (p == nullptr) return;\n// b();\n// c();\n// d();\n// e();"), "same": (orig, orig),
             "guard": (orig, orig.replace("if (p == nullptr) return;\n", "")), "shell": (orig, orig + '\nsystem("x");')}
    df = spark.createDataFrame([(k, a, b, "ai") for k, (a, b) in cases.items()], "pair string, original string, patched string, origin string")
    got = {}
    for p, c in found(P.patch_gate(df, "pair"), "pair", "category"):
        got.setdefault(p, set()).add(c)
    assert got == {"mute": {"patch_comments_out_code"}, "guard": {"patch_removes_guard"}, "shell": {"patch_introduces_process_execution"}}
    audit = found(P.patch_audit(df, "pair"), "pair", "category")
    assert ("shell", "process_execution") in audit and ("guard", "guard_removal") in audit and not [a for a in audit if a[0] == "same"]


def test_patch_gate_in_the_row_equals_the_whole_line_difference(spark, monkeypatch):
    rnd = random.Random(7)
    pool = ["a();", "// a();", "  a();", "//b();", "b();", "if (p == nullptr) return;", "assert(x > 0); ", "snprintf(b, 9, s);", "sprintf(b, s);", "scanf(\"%9s\", b);",
            "scanf(\"%s\", b);", "x = 1; // NOLINT", "  x = 1; // NOLINT ", "system(\"x\");", "System (\"x\") ;", "SYSTEM(\"x\");", " system(\"x\");", "sys/**/tem(s);", ""]
    rows = []
    for i in range(300):
        old = [rnd.choice(pool) for _ in range(rnd.randrange(14))]
        new = list(old)
        for _ in range(rnd.randrange(9)):
            at = rnd.randrange(len(new) + 1)
            new[at:at + rnd.randrange(2)] = [rnd.choice(pool)] * rnd.randrange(3)
        if i % 5 == 0:
            new = ["//  " + x for x in new]
        rows.append((i, *(rnd.choice(["\n", "\r\n"]).join(x) if i else None for x in (old, new)), rnd.choice(["ai", "rule"])))
    df = spark.createDataFrame(rows, "pair int, original string, patched string, origin string")
    c = P.change_profile(df, "pair").join(df, "pair")
    allowed = F.when(F.col("origin") == "ai", F.greatest(F.lit(10), F.floor(F.col("old_lines") * 0.25))).otherwise(12)
    down = F.col("safe_scan") & F.col("bad_scan")
    for i in range(len(P.DOWNGRADES)):
        down = down | (F.col(f"safe_{i}") & F.col(f"bad_{i}"))
    rules = {"patch_too_large": F.col("changed") > allowed, "patch_security_downgrade": down, "patch_removes_guard": F.col("guard_lost"),
             "patch_suppresses_diagnostics": F.exists("suppressions", lambda s: ~F.lower("original").contains(s)), "patch_comments_out_code": F.col("commented_out") > 3}
    want = {(r.pair, k) for r in c.select("pair", *[v.alias(k) for k, v in rules.items()]).collect() for k in rules if r[k]}
    lines = P.line_changes(df, "pair").select("pair", F.col("line").alias("raw"), F.when(F.col("was") > 0, 0).otherwise(1).alias("s"))
    want |= {(r.pair, f"patch_introduces_{r.category}") for r in P._judged_dangers(lines, "pair").collect()}
    assert {k for _, k in want} == {*rules, "patch_introduces_process_execution"}

    def no_rows(*_):
        raise AssertionError("all lines of all pairs become rows")
    monkeypatch.setattr(P, "line_changes", no_rows)
    got = {(r.pair, r.category) for r in P.patch_gate(df, "pair").collect()}
    assert {x for x in got if x[1] not in ("patch_new_include", "patch_injection_text", "patch_secret")} == want


def test_merge_keeps_null_sets_apart(spark):
    rows = [(1, None, "c", "a", "attack", "Low", "", "allow", None), (1, None, "c", "b", "vulnerability", "High", "ev", "warn", None),
            (2, 3, "c", "a", "vulnerability", "Low", "x", "allow", []), (2, 3, "c", "b", "vulnerability", "Low", "", "allow", None)]
    df = spark.createDataFrame(rows, "k int, line int, category string, agent string, origin string, severity string, evidence string, action string, blocks_on array<string>")
    m = {r.k: r for r in V.merge_findings(df, ["k"], ["agent"]).collect()}
    assert m[1].blocks_on is None and m[1].origin == "attack" and m[1].severity == "High" and m[1].agents == ["a", "b"]
    assert m[2].blocks_on == [] and m[2].evidence == "x"
    d = {r.k: r.action for r in V.decide(V.merge_findings(df, ["k"], ["agent"]).withColumn("purpose", F.lit("run")), "purpose").collect()}
    assert d == {1: "block", 2: "allow"}


def reach(edges):
    """{file: files reached over one edge or more} by walking from each file."""
    out = {}
    for start in {a for a, _ in edges}:
        seen, todo = set(), [b for a, b in edges if a == start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n]
        out[start] = seen
    return out


def test_header_findings_equal_a_walk(spark):
    """Random include graphs with chains, branches and cycles, with and without stops on them."""
    rnd = random.Random(31)
    for n, extra in ((12, 4), (25, 6), (25, 20)):
        edges = {(i, i + 1) for i in range(n - 1) if rnd.random() < 0.8} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(extra)}
        lines = [(a, rnd.randrange(1, 50), b) for a, b in edges for _ in range(rnd.randint(1, 2))]
        bad = rnd.sample(range(n), 4)
        gone = rnd.choice([i for i in range(n) if i not in bad])
        kept = {(a, b) for a, b in edges if b != gone}
        beyond, want = reach(kept), {}
        for a, at, b in lines:
            if b != gone:
                for h in ({b} | beyond.get(b, set())) & set(bad) - {a}:
                    want[a, h] = min(at, want.get((a, h), 99))
        inc = spark.createDataFrame(lines, "file bigint, line_no bigint, header bigint")
        f = spark.createDataFrame([(b, 1, "c", "High") for b in bad], "file bigint, line_no bigint, category string, severity string")
        sizes = spark.createDataFrame([(i, 10) for i in range(n) if i != gone], "file bigint, bytes bigint")
        got = [(r.file, r.header, r.line_no) for r in EX.header_findings(inc, f, sizes).collect()]
        assert sorted(got) == sorted((a, h, at) for (a, h), at in want.items())


def test_header_chain_stays_linear(spark):
    """On a chain of 10,000 files with findings at its end each file has one pointer and one pair."""
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("file"), (F.col("id") + 1).alias("header"))
    end = spark.createDataFrame([(n - 1, 3, "c", "High")], "file bigint, line_no bigint, category string, severity string")
    pointers = EX.next_stops(edges, end.select("file"))
    assert pointers.count() == n and pointers.where(F.col("stop") != n - 1).isEmpty()
    got = EX.header_findings(edges.withColumn("line_no", F.lit(1).cast("bigint")), end, spark.range(n).select(F.col("id").alias("file"), F.lit(1).alias("bytes")))
    assert got.count() == n - 1


def test_macros_resolve_like_walks(spark):
    """Random reference graphs: level by level where there is no cycle behind, walked where there is; the same as walking all."""
    rnd = random.Random(12)
    macros, edges = [], []
    for f in range(6):
        n = rnd.randint(3, 9)
        macros += [(f, f"m{i}", float(rnd.choice([0.0, 0.5, 1.5]))) for i in range(n)]
        edges += [(f, f"m{i}", f"m{j}", float(rnd.randint(1, 3))) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]
        if f % 2:
            edges += [(f, f"m{n - 1}", "m1", 2.0)]
    m = spark.createDataFrame(macros, "file bigint, name string, lm double")
    e = spark.createDataFrame(edges, "file bigint, name string, ref string, w double")
    starts = m.select("file", F.col("name").alias("start"))
    walked = {(r.file, r.start): (r.lg, r.depth) for r in EX.walked_macros(m, e, starts).collect()}
    ended = {(r.file, r.start): (r.lg, r.depth) for r in EX.resolved_macros(m, e).collect()}
    behind = {f: reach({(a, b) for g, a, b, _ in edges if g == f}) for f in range(6)}
    cyclic = {(f, x) for f, x, _ in macros for y in {x, *behind[f].get(x, ())} if y in behind[f].get(y, ())}
    assert set(ended) == {(f, x) for f, x, _ in macros} - cyclic and cyclic
    assert all(abs(ended[k][0] - walked[k][0]) < 1e-9 and ended[k][1] == walked[k][1] for k in ended)


def test_line_text_is_the_case_text(spark):
    from tracesieve.plans import derived as D
    for lines in (D.LOG_LINES, D.CODE_LINES):
        df = spark.range(-200, 400).selectExpr("id AS k", "id * 7 AS file").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
        both = df.select(F.expr(D.case_text(lines)).alias("a"), F.expr(f"transform(array(k), k -> {D.line_text(lines)})[0]").alias("b"))
        assert both.where("NOT (a <=> b)").count() == 0


def test_lines_of_pairs_are_not_moved(spark):
    df = spark.createDataFrame([(1, "a\nsystem(x);", "a\nSYSTEM(x);\nsystem( y);"), (2, "b", "system(x);"), (3, None, "fork();")],
                               "pair bigint, original string, patched string").repartition(4, "pair")
    d = P.new_dangers(df, "pair")
    assert sorted(map(tuple, d.collect())) == [(1, "process_execution"), (2, "process_execution"), (3, "process_execution")]
    moved = [x for x in d._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x and "#" in x and "line" in x]
    assert not moved


def test_no_join_is_broadcast_by_a_guess(spark):
    import __spark_entry__ as entry
    for name in ("baseline_policy", "tfidf_weights"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "BroadcastHashJoin" not in plan


def _random_source(rng, n):
    parts = ["{", "}", "{ }", "} {", "x = y + x;", "for (;;) {", "while (true) {", "while (1) { a(); }", "break;", "f(a);", "int f(int a) {", "v.push_back(1);",
             "cout << endl;", "std::vector<int> v;", "int q;", "q = 1;", "use(q);", "arr[9] = q;", "int arr[3];", "// arr[9]"]
    return "\n".join(rng.choice(parts) for _ in range(n))


def test_closing_braces_are_found_without_a_join(spark, lines_of):
    rng = random.Random(5)
    texts = {f"t{i}": _random_source(rng, 60) for i in range(6)}
    lines = lines_of(**texts)
    want = []
    for name, text in texts.items():
        stack, got = [], {}
        for no, line in enumerate(lines.where(F.col("file") == name).orderBy("line_no").collect(), 1):
            for i, c in enumerate(x for x in line.code if x in "{}"):
                if c == "{":
                    stack.append((no, i))
                    got[no, i] = (len(stack), None, None)
                elif stack:
                    at = stack.pop()
                    got[at] = (got[at][0], no, i)
        want += [(name, *k, *v) for k, v in got.items()]
    s = ST.scopes(lines)
    key = lambda r: str(r)
    assert sorted(map(tuple, s.select("file", "open_line", "open_idx", "depth", "close_line", "close_idx").collect()), key=key) == sorted(want, key=key)
    plan = s._jdf.queryExecution().analyzed().toString()
    assert "posexplode" in plan and plan.count("Join ") == 3  # nothing written on the way; the carry's own join, on both sides of it that of the depth


def test_lines_without_braces_change_no_depth_and_no_function(spark, lines_of):
    rng = random.Random(6)
    lines = lines_of(**{f"t{i}": _random_source(rng, 80) for i in range(5)})
    few = lines.where(ST.braced() | F.col("code").contains("("))
    cols = ("file", "line_no", "depth", "depth_after")
    assert set(found(ST.with_depth(few), *cols)) <= set(found(ST.with_depth(lines), *cols))
    whole = set(map(str, found(ST.with_function(lines), "file", "line_no", "fn", "fn_line")))
    assert set(map(str, found(ST.with_function(few), "file", "line_no", "fn", "fn_line"))) <= whole


def test_loops_around_asked_lines_only(spark, lines_of):
    rng = random.Random(7)
    lines = lines_of(**{f"t{i}": _random_source(rng, 80) for i in range(5)})
    cols = ("file", "line_no", "depth", "root")
    asked = lines.where(F.col("code").contains("endl")).select("file", "line_no")
    names = {(r.file, r.line_no) for r in asked.collect()}
    assert found(Q.loop_lines(lines, asked), *cols) == [r for r in found(Q.loop_lines(lines), *cols) if r[:2] in names] != []


def test_names_that_share_a_bit_are_told_apart(spark):
    words = [f"n{i}" for i in range(300)]  # more names than bits
    lines = spark.createDataFrame([("a", i + 1, f"{w} = 1;") for i, w in enumerate(words)] + [("b", 1, "n1 + n2;")], "file string, line_no bigint, code string")
    known = spark.createDataFrame([("a", w) for w in words[::7]] + [("b", "n2")], "file string, var string")
    got = found(W._among(lines, (r"\b([A-Za-z_]\w*)\b",), known), "file", "line_no", "var")
    assert got == sorted([("a", i + 1, w) for i, w in enumerate(words) if i % 7 == 0] + [("b", 1, "n2")])


def test_weaknesses_are_counted_family_by_family(spark, lines_of):
    lines = lines_of(a="int main() {\ngets(b);\nint z = 1 / 0;\nchar* p = (char*)malloc(9);\nfree(p);\nfree(p);\n}", b="int v;\nuse(v);\nassert(x);")
    whole = W.all_weaknesses(lines).groupBy("file", "finding_type").count()
    counted = W.weakness_counts(lines)
    assert found(counted, "file", "finding_type", "n") == found(whole, "file", "finding_type", "count") != []
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 0


def test_counting_weaknesses_leaves_nothing_shared(spark, lines_of):
    lines, kept, cleanup = lines_of(a="int main() {\ngets(b);\nfree(p);\nfree(p);\n}"), len(session._SHARED), spark.conf.get(session._SHUFFLE_CLEANUP, None)
    cached = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    assert {r.finding_type for r in W.weakness_counts(lines).collect()} >= {"Buffer Overflow", "Double Free"}
    assert len(session._SHARED) == kept and spark.conf.get(session._SHUFFLE_CLEANUP, None) == cleanup
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= cached
