import hashlib
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracesieve.functions.ordered import running
from tracesieve.operators import eventlog as G
from tracesieve.operators import labels as L
from tracesieve.operators import stateful as H
from tracesieve.operators.dataset import entry_gate
from tracesieve.session import checkpoint_dir, cut_lineage
from tracesieve.sources import readers as R
from tracesieve.sources import writers as WR
from tracesieve.streaming import jobs as J


@pytest.fixture
def tmp():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_jsonl(spark, tmp):
    p = tmp / "a.jsonl"
    p.write_text('{"message_raw": "m1", "category": "other"}\n\n{broken\n[1, 2]\n{"message_raw": "m2"}\n')
    df = R.read_jsonl(spark, str(p), R.MESSAGE)
    assert sorted(r.message_raw for r in df.collect()) == ["m1", "m2"]
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(p), R.MESSAGE, strict=True).collect()


def test_gold_and_array(spark, tmp):
    (tmp / "g.csv").write_text('id,message_raw,source,proposed_label,final_label\n1,"a, ""q"" b",s,x,other\n2,m,s,x,\n3,"two\nlines",s,x, type_error \n')
    g = {r.id: r for r in R.read_gold(spark, str(tmp / "g.csv")).collect()}
    assert set(g) == {"1", "3"} and g["1"].message_raw == 'a, "q" b' and g["3"].final_label == "type_error"
    (tmp / "t.json").write_text(json.dumps([{"message": "", "raw_message": "r", "category": "other"}, {"message": "m"}, {"message": "k", "category": "x"}]))
    assert sorted(r.message for r in R.read_training_array(spark, str(tmp / "t.json")).collect()) == ["k", "r"]


def test_raw_logs_prune_and_order(spark, tmp):
    rows = [(str(i), "C++" if i % 2 else "Go", "out" if i % 3 else " ") for i in range(20)]
    spark.createDataFrame(rows, R.RAW_LOG).coalesce(1).write.parquet(str(tmp / "logs"))
    df = R.read_raw_logs(spark, str(tmp / "logs"))
    got = [r.log_id for r in df.orderBy("shard", "ordinal").collect()]
    assert got == [i for i, l, o in rows if l == "C++" and o.strip()]
    plan = df.select("compiler_output")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,C++)" in plan and "log_id" not in plan.split("ReadSchema")[1].split(">")[0]


def test_corpus_and_checksums(spark, tmp):
    d = tmp / "c" / "CWE121_Stack"
    d.mkdir(parents=True)
    (d / "x_bad.cpp").write_text("gets(b);\n")
    (d / "x_good.cpp").write_text("ok();\n")
    c = {Path(r.path).name: r for r in R.read_corpus(spark, str(tmp / "c")).collect()}
    assert c["x_bad.cpp"].is_bad and c["x_good.cpp"].is_good and c["x_bad.cpp"].cwe == "CWE121" and c["x_bad.cpp"].text.strip() == "gets(b);"
    files = R.read_checksums(spark, str(tmp / "c"), "*.cpp")
    sha = {n: hashlib.sha256((d / n).read_bytes()).hexdigest() for n in c}
    assert {r.name: r.sha256 for r in files.collect()} == sha
    m = spark.createDataFrame([("x_bad.cpp", sha["x_bad.cpp"].upper(), 9), ("x_good.cpp", sha["x_good.cpp"], 7)], "name string, sha256 string, size bigint")
    assert {r.name: r.problem for r in R.verify_models(files, m, str(tmp / "c")).collect()} == {"x_bad.cpp": None, "x_good.cpp": "model_hash_mismatch"}
    assert {r.problem for r in R.verify_models(files, m, "/elsewhere").collect()} == {"model_outside_data_dir"}
    assert {r.problem for r in R.verify_models(files, m.where("false"), str(tmp)).collect()} == {"model_manifest_missing"}


def test_sinks(spark, tmp):
    f = spark.createDataFrame([("r1", "b.cpp", 3, None, "High", "Buffer Overflow", "CWE-120"), ("r1", "a.cpp", None, 0, "Low", "Odd Thing", None),
                               ("r1", "b.cpp", 9, 1, "High", "Unbounded Input", "CWE-120")],
                              "run string, file string, line int, column int, severity string, finding_type string, cwe_id string")
    doc = json.loads(WR.sarif_documents(f, "run").first().value)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["ruleId"] for r in run["results"]] == ["ODD_THING", "CWE-120", "CWE-120"]
    assert run["results"][0]["level"] == "note" and run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1}
    assert {r["id"]: r["name"] for r in run["tool"]["driver"]["rules"]} == {"CWE-120": "Buffer Overflow", "ODD_THING": "Odd Thing"}
    WR.write_sarif(f, "run", str(tmp / "sarif"))
    log = spark.createDataFrame([("2024-01-01T10:00:00Z", "block"), ("2024-01-02T00:00:00Z", "warn")], "timestamp string, action string")
    WR.append_log(log, str(tmp / "log"))
    WR.append_log(log, str(tmp / "log"))
    assert spark.read.json(str(tmp / "log")).where("day = '2024-01-01'").count() == 2
    WR.write_telemetry(log, log, str(tmp / "tele"))
    WR.write_metrics({"a": log.limit(1), "b": log.limit(1)}, str(tmp / "metrics"))
    assert spark.read.json(str(tmp / "metrics")).select("a.action").count() == 1


def test_log_summary_golden(spark):
    lines = ['{"action": "block", "agents": ["execution"], "categories": ["process_execution"]}', '{"action": "block", "agents": ["secret"], "categories": ["hardcoded_secret"]}',
             '{"action": "log", "agents": ["execution"], "categories": ["process_execution"]}', "", "{bad", "[1]"]
    rec = G.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    got = {(r.dimension, r.name): r.n for r in G.log_summary(rec).collect()}
    assert got[("total", "all")] == 3 and got[("action", "block")] == 2 and got[("agent", "execution")] == 2 and got[("category", "process_execution")] == 2


def test_entry_gate_golden(spark):
    rows = [("s", 1, "expected thing", "syntax_error", "#error expected thing\nint x;"), ("s", 2, "fine message", "nope", ""), ("s", 3, "x" * 400, "other", ""),
            ("s", 4, "see C:\\Users\\a.h", "other", ""), ("s", 5, 'token = "abcdefgh12345"', "other", ""), ("s", 6, "good one", "other", ""), ("s", 7, "good two", "other", "")]
    df = spark.createDataFrame(rows, "session string, line_no bigint, message string, category string, source_text string")
    g = {r.line_no: r.problems for r in entry_gate(df, "session", F.floor(F.col("line_no") / 2), ["line_no"], "message", "category", "source_text", run_limit=1).collect()}
    assert g == {1: ["dataset_directive_message"], 2: ["dataset_bad_category"], 3: ["dataset_bad_message"], 4: ["dataset_bad_message"],
                 5: ["dataset_secret"], 6: [], 7: ["dataset_rate_limit"]}


def _stream(spark, df, folder, schema):
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_streams_equal_batch(spark, tmp):
    ev = spark.createDataFrame([(i, i % 3, 1_700_000_000_000_000 + i * 7_000_000 + (i % 5) * 900_000) for i in range(150)], "event_id bigint, user bigint, us bigint")
    s = _stream(spark, ev, str(tmp / "ev"), ev.schema)
    q = J.limit_stream(s, "user", 2, 60_000_000).writeStream.format("parquet").option("path", str(tmp / "out")).option(
        "checkpointLocation", str(tmp / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp / "out")).collect()}
    want = {r.event_id: r.accepted for r in H.limit_rate(ev, ["user"], "us", "event_id", 2, 60_000_000).collect()}
    assert got == want and len(got) == 150
    u = ev.withColumn("urgent", F.col("event_id") % 4 == 0)
    s = _stream(spark, u, str(tmp / "u"), u.schema)
    q = J.bucket_stream(s, "user", 4).writeStream.format("parquet").option("path", str(tmp / "out2")).option(
        "checkpointLocation", str(tmp / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp / "out2")).collect()}
    assert got == {r.event_id: r.accepted for r in H.token_bucket(u, ["user"], "us", "event_id", F.col("urgent"), 4).collect()}


def test_window_counts_and_quarantine(spark, tmp):
    ev = spark.createDataFrame([(i, "ab"[i % 2], 1_700_000_000 + i * 50) for i in range(100)], "event_id bigint, kind string, s bigint") \
        .select("event_id", "kind", F.timestamp_seconds("s").alias("ts"))
    s = _stream(spark, ev, str(tmp / "ev"), ev.schema)
    q = J.live_counts(s, "ts", "kind", "10 minutes").writeStream.format("memory").queryName("live_counts_t").outputMode("complete").option(
        "checkpointLocation", str(tmp / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.window_start, r.kind): r.n for r in spark.table("live_counts_t").collect()}
    assert got == {(r.window_start, r.kind): r.n for r in G.window_counts(ev, "ts", "kind", "10 minutes").collect()}
    en = spark.createDataFrame([("2024-01-01T00:00:00Z", "expected ';' here", "syntax_error", 1.0, ""), ("2024-01-01T00:00:01Z", "bad", "nope", 1.0, "")],
                               "ts string, message string, category string, confidence double, source_text string")
    J.quarantine(_stream(spark, en, str(tmp / "en"), en.schema), str(tmp / "pending"), str(tmp / "rejected"), str(tmp / "ck3")).awaitTermination(240)
    p = spark.read.json(str(tmp / "pending")).collect()
    assert [(r.message, r.status) for r in p] == [("expected statement terminator here", "pending")]
    assert spark.read.json(str(tmp / "rejected")).first().details.categories == "dataset_bad_category"


def test_lineage_and_overrides(spark):
    assert checkpoint_dir(spark) and cut_lineage(spark.range(5)).count() == 5
    assert running(spark.range(3).withColumn("k", F.lit(1)), ["k"], F.lit(0), ["id"], {"s": ("sum", F.lit(1))}).count() == 3
    rows = ["variable 'x' set but not used", "'cout' was not declared in this scope", "'zed' was not declared in this scope", "no idea"]
    df = spark.createDataFrame([(r,) for r in rows], "m string").select("m", L.override(F.col("m")).alias("o"))
    assert [(r.o.category, r.o.confidence) if r.o else None for r in df.collect()] == [
        ("unused_variable", 0.98), ("missing_include", 0.99), ("name_resolution", 0.99), None]


def test_training_keeps_counts_not_ngrams(spark):
    """Rows stay where they are for class weights, the vocabulary is by count and then term, and only counts are kept."""
    from tracesieve import session
    from tracesieve.operators import ml as M
    df = spark.createDataFrame([("aa bb aa", "x"), ("bb cc", "y"), ("dd ee", "y"), (None, "x")], "t string, l string")
    plan = M.class_weights(df, "l")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    model = M.train(df, "t", "l", 5, max_iter=2)
    assert model.stages[0].vocabulary == ["aa", "bb", "aa bb", "aa bb aa", "bb aa"]
    kept = session._SHARED[-1].columns
    assert "terms" not in kept and "tf" in kept
    assert M.predict(model, df, "t").count() == 4
