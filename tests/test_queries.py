"""Registered queries against their SQL twins. TRACESIEVE_ALL=1 runs every query."""
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = ["secret_risk_by_source", "merged_findings", "corpus_messages", "first_diagnostic", "classifier_normalised", "verified_labels",
         "keyword_rank", "first_wins_dedupe", "per_class_cap", "nested_caps", "grouped_stratified_split", "split_leakage", "dataset_gate",
         "injection_flags", "verdict_by_purpose", "routing_difference", "safe_html", "request_screen", "case_outcomes", "attack_success_rollup",
         "latency_percentiles", "macro_f1", "majority_vote", "rate_limit", "token_bucket", "energy_integral", "log_summary", "brace_depth",
         "array_bounds", "free_misuse", "execution_risks", "line_changes", "fuzzy_dictionary", "tfidf_terms"]
NAMES = sorted(entry.queries()) if os.environ.get("TRACESIEVE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, msg, _ = check.compare(spark, con, FOLDER, name)
    assert ok, msg


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def _small_events(folder, rows):
    """`events` of (event_id, us, event_type, value) in a folder, and a connection that sees them."""
    con = duckdb.connect()
    values = ", ".join(f"({i}, {us}, '{e}', {v}::DOUBLE)" for i, us, e, v in rows)
    con.execute(f"""COPY (SELECT i::BIGINT AS event_id, make_timestamp(us) AS ts, 3::BIGINT AS user_id, e AS event_type, v AS value FROM (VALUES {values}) x(i, us, e, v))
        TO '{folder}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return con


def test_action_energy_rounds_as_its_sql(spark, tmp_path):
    """0.2599 mWh are 0.1234525 mg: up by SQL, whose rounding scales first, and down by the value's decimal form."""
    con = _small_events(tmp_path, [(0, 0, "view", 10.0), (1, 10_000, "purchase", 0.5), (2, 20_000, "click", 52.97)])
    ok, msg, _ = check.compare(spark, con, str(tmp_path), "action_energy")
    assert ok, msg
    assert entry.queries()["action_energy"](spark, str(tmp_path)).first().co2_mg == 0.123453


def test_energy_integral_rounds_as_its_sql(spark, tmp_path):
    con = _small_events(tmp_path, [(0, 0, "view", 0.01), (1, 20_000, "click", 0.33)])
    ok, msg, _ = check.compare(spark, con, str(tmp_path), "energy_integral")
    assert ok, msg
    assert entry.queries()["energy_integral"](spark, str(tmp_path)).where("event_id = 1").first().co2_mg == 0.436098
