"""Benchmark analytics over orders as cases, and classifier evaluation over labelled documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions import text as T
from tracesieve.operators import casebook as C
from tracesieve.operators import evaluation as E
from tracesieve.operators import labels as L
from tracesieve.plans.dataset import DOC_LINES_SQL
from tracesieve.plans.registry import Tables, query
from tracesieve.plans.sqltext import RISK, any_sql, in_sql, q

AGENTS = ["execution", "resource", "output", "request", "secret", "integrity", "prompt", "patch", "weakness"]

# Case columns as plain SQL, shared by both engines.
CASE_COLS = {
    "case_id": "o_orderkey",
    "label": "CASE WHEN o_orderkey % 4 = 0 THEN 'benign' ELSE 'attack' END",
    '"set"': "CASE WHEN o_custkey % 5 = 0 THEN 'hard' ELSE 'standard' END",
    "family": "CASE WHEN o_custkey % 11 = 0 THEN 'scanner_evasion' WHEN o_orderpriority = '1-URGENT' THEN 'process_execution' WHEN o_orderpriority = '2-HIGH' THEN 'prompt_injection' WHEN o_orderpriority = '3-MEDIUM' THEN 'patch_tampering' ELSE 'request_abuse' END",
    "kind": "CASE o_orderstatus WHEN 'O' THEN 'USER_SOURCE' WHEN 'F' THEN 'PATCH' ELSE 'HTTP_REQUEST' END",
    "purpose": "CASE o_orderstatus WHEN 'O' THEN 'run' WHEN 'F' THEN 'patch' ELSE 'request' END",
    "prevention": "CASE WHEN o_orderkey % 6 < 3 THEN 'block' WHEN o_orderkey % 6 < 5 THEN 'neutralize' ELSE 'warn' END",
    "expected_category": "CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'cat_0' WHEN 1 THEN 'cat_1' ELSE 'cat_2' END",
    "expected_origin": "CASE WHEN o_custkey % 7 = 0 THEN 'vulnerability' ELSE 'attack' END",
    "blocked": "o_totalprice > 150000",
    "neutral": "o_totalprice < 350000",
    "baseline_allowed": "o_custkey % 3 <> 0",
    "risk_score": "CAST(floor(o_totalprice / 20000) AS INT)",
    "total_ms": "CAST(floor(o_totalprice) AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "notes": "'priority ' || o_orderpriority",
    "agent_1": "CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'execution' WHEN 1 THEN 'secret' WHEN 2 THEN 'prompt' ELSE 'weakness' END",
    "agent_2": "CASE WHEN o_custkey % 2 = 0 THEN 'output' ELSE 'patch' END",
}
FINDING_COLS = {
    "case_id": "l_orderkey",
    "agent": "CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'execution' WHEN 1 THEN 'secret' WHEN 2 THEN 'prompt' WHEN 3 THEN 'weakness' WHEN 4 THEN 'output' ELSE 'patch' END",
    "origin": "CASE WHEN l_partkey % 5 = 0 THEN 'vulnerability' ELSE 'attack' END",
    "category": "CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'cat_0' WHEN 1 THEN 'cat_1' WHEN 2 THEN 'cat_2' ELSE 'cat_3' END",
    "severity": "CASE WHEN l_linenumber = 1 THEN 'Critical' WHEN l_linenumber < 4 THEN 'High' WHEN l_linenumber < 6 THEN 'Medium' ELSE 'Low' END",
}
OUTCOME_SQL = f"""
WITH cases AS (SELECT {", ".join(f"{e} AS {n}" for n, e in CASE_COLS.items())} FROM orders),
fnd AS (SELECT {", ".join(f"{e} AS {n}" for n, e in FINDING_COLS.items())} FROM lineitem),
per AS (SELECT f.case_id, bool_or(f.origin = c.expected_origin AND f.agent IN (agent_1, agent_2)) AS m,
    bool_or(f.origin = c.expected_origin AND f.agent IN (agent_1, agent_2) AND f.category = c.expected_category) AS mc,
    bool_or(f.origin = 'attack' AND f.severity <> 'Low') AS al, string_agg(DISTINCT f.agent, ';' ORDER BY f.agent) AS agents_found,
    string_agg(DISTINCT f.category, ';' ORDER BY f.category) AS categories
  FROM fnd f JOIN cases c ON c.case_id = f.case_id GROUP BY 1),
oc AS (SELECT c.*, label = 'attack' AND coalesce(m, false) AS detected, label = 'attack' AND coalesce(mc, false) AS category_attributed,
    label = 'attack' AND CASE prevention WHEN 'block' THEN blocked WHEN 'neutralize' THEN neutral ELSE false END AS prevented,
    label = 'benign' AND coalesce(al, false) AS alert_fp, label = 'benign' AND blocked AS block_fp,
    coalesce(agents_found, '') AS agents_found, coalesce(categories, '') AS categories FROM cases c LEFT JOIN per ON per.case_id = c.case_id)
"""


def case_findings(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.expr(e).alias(n) for n, e in FINDING_COLS.items()])


def cases(t: Tables) -> DataFrame:
    c = t.orders.select(*[F.expr(e).alias(n.strip('"')) for n, e in CASE_COLS.items()])
    return c.withColumn("expected_agents", F.array("agent_1", "agent_2")).drop("agent_1", "agent_2")


def case_outcomes(t: Tables) -> DataFrame:
    return C.outcomes(cases(t), case_findings(t))


@query("case_outcomes", OUTCOME_SQL + "SELECT case_id, detected, category_attributed, detected AND category_attributed AS attributed, prevented, alert_fp, block_fp, agents_found, categories FROM oc")
def case_outcomes_q(t: Tables) -> DataFrame:
    """Detection, attribution, prevention and false-positive flags of every case."""
    return case_outcomes(t).select("case_id", "detected", "category_attributed", "attributed", "prevented", "alert_fp", "block_fp",
                                   F.array_join("agents_found", ";").alias("agents_found"), F.array_join("categories", ";").alias("categories"))


@query("manifest_totals", OUTCOME_SQL + """SELECT count(*) AS total_cases, count(*) FILTER (NOT ev) AS headline_cases, count(*) FILTER (NOT ev AND atk) AS headline_attacks, count(*) FILTER (NOT ev AND NOT atk) AS headline_benign,
 count(*) FILTER (NOT ev AND atk AND "set" = 'standard') AS standard_attacks, count(*) FILTER (NOT ev AND atk AND "set" = 'hard') AS hard_attacks, count(*) FILTER (ev) AS evasion_cases,
 count(*) FILTER (ev AND atk) AS evasion_attacks, count(*) FILTER (ev AND NOT atk) AS evasion_benign FROM (SELECT *, family = 'scanner_evasion' AS ev, label = 'attack' AS atk FROM oc)""")
def manifest_totals(t: Tables) -> DataFrame:
    """Nine totals of the case table."""
    return C.manifest_totals(cases(t))


def _wilson_sql(k: str, n: str, z: str = "1.959963984540054", lo: str = "0.0", hi: str = "1.0", empty=("0.0", "0.0")) -> tuple[str, str]:
    z = f"{z}::DOUBLE"
    p = f"({k}::DOUBLE / {n})"
    d = f"(1.0::DOUBLE + {z} * {z} / {n})"
    c = f"(({p} + {z} * {z} / (2.0::DOUBLE * {n})) / {d})"
    m = f"({z} * sqrt({p} * (1.0::DOUBLE - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})) / {d})"
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {c} - {m}) ELSE {empty[0]}::DOUBLE END",
            f"CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {c} + {m}) ELSE {empty[1]}::DOUBLE END")


def _rat(k: str, n: str, e: str = "0.0") -> str:
    return f"CASE WHEN ({n}) > 0 THEN ({k})::DOUBLE / ({n}) ELSE {e}::DOUBLE END"


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_RL, _RH = _wilson_sql("detected", "attacks")
_AL, _AH = _wilson_sql("alerts", "benign")
_PR, _RC = _rat("detected", "detected + alerts", "1.0"), _rat("detected", "attacks")


@query("detection_wilson", OUTCOME_SQL.rstrip() + f""", a AS (SELECT "set", count(*) FILTER (label = 'attack') AS attacks, count(*) FILTER (detected) AS detected, count(*) FILTER (label = 'benign') AS benign,
  count(*) FILTER (alert_fp) AS alerts, count(*) FILTER (block_fp) AS blocks FROM oc WHERE family <> 'scanner_evasion' GROUP BY 1)
SELECT "set", attacks, detected, benign, alerts, blocks, round({_PR}, 6) AS precision, round({_RC}, 6) AS recall, round(CASE WHEN ({_PR}) + ({_RC}) > 0 THEN 2.0::DOUBLE * ({_PR}) * ({_RC}) / (({_PR}) + ({_RC})) ELSE 0 END, 6) AS f1,
 round({_RL}, 6) AS recall_low, round({_RH}, 6) AS recall_high, round({_rat('alerts', 'benign')}, 6) AS alert_rate, round({_AL}, 6) AS alert_low, round({_AH}, 6) AS alert_high FROM a""")
def detection_wilson(t: Tables) -> DataFrame:
    """Detection metrics with intervals per case set."""
    return _r6(C.detection(C.headline(case_outcomes(t)), ["set"]), "precision", "recall", "f1", "recall_low", "recall_high", "alert_rate", "alert_low", "alert_high")


_PL, _PH = _wilson_sql("prevented", "measured")


@query("attack_success_rollup", OUTCOME_SQL.rstrip() + f""", b AS (SELECT *, label = 'attack' AND prevention IN ('block', 'neutralize') AS ms FROM oc), a AS (
 SELECT 'overall' AS level, 'all' AS name, count(*) FILTER (label = 'attack') AS attacks, count(*) FILTER (detected) AS detected, count(*) FILTER (ms) AS measured, count(*) FILTER (ms AND prevented) AS prevented, count(*) FILTER (ms AND baseline_allowed) AS base_allowed FROM b WHERE family <> 'scanner_evasion'
 UNION ALL SELECT 'set', "set", count(*) FILTER (label = 'attack'), count(*) FILTER (detected), count(*) FILTER (ms), count(*) FILTER (ms AND prevented), count(*) FILTER (ms AND baseline_allowed) FROM b WHERE family <> 'scanner_evasion' GROUP BY 2
 UNION ALL SELECT 'family', family, count(*) FILTER (label = 'attack'), count(*) FILTER (detected), count(*) FILTER (ms), count(*) FILTER (ms AND prevented), count(*) FILTER (ms AND baseline_allowed) FROM b GROUP BY 2)
SELECT level, name, attacks, detected, measured, prevented, base_allowed, round({_rat('base_allowed', 'measured')}, 6) AS success_before, round({_rat('measured - prevented', 'measured')}, 6) AS success_after,
 round(CASE WHEN base_allowed > 0 THEN (({_rat('base_allowed', 'measured')}) - ({_rat('measured - prevented', 'measured')})) / ({_rat('base_allowed', 'measured')}) ELSE 0 END, 6) AS reduction, round({_PL}, 6) AS prevention_low, round({_PH}, 6) AS prevention_high FROM a""")
def attack_success_rollup(t: Tables) -> DataFrame:
    """Attack success before and after defence at three levels."""
    return _r6(C.attack_success(case_outcomes(t)), "success_before", "success_after", "reduction", "prevention_low", "prevention_high")


@query("per_agent", OUTCOME_SQL.rstrip() + f""", reg(agent) AS (VALUES {", ".join(f"('{a}')" for a in AGENTS)}),
ex AS (SELECT agent, count(*) AS expected, count(*) FILTER (detected) AS hits FROM (SELECT unnest([agent_1, agent_2]) AS agent, detected FROM oc WHERE label = 'attack') GROUP BY 1),
fp AS (SELECT f.agent, count(DISTINCT f.case_id) AS fps FROM fnd f JOIN oc ON oc.case_id = f.case_id WHERE oc.label = 'benign' AND f.origin = 'attack' AND f.severity <> 'Low' GROUP BY 1)
SELECT agent, e AS expected, h AS hits, f AS fps, round({_rat('h', 'e')}, 6) AS recall, round({_rat('h', 'h + f', '1.0')}, 6) AS precision FROM (
 SELECT reg.agent, coalesce(expected, 0) AS e, coalesce(hits, 0) AS h, coalesce(fps, 0) AS f FROM reg LEFT JOIN ex ON ex.agent = reg.agent LEFT JOIN fp ON fp.agent = reg.agent)""")
def per_agent(t: Tables) -> DataFrame:
    """Recall and precision of every registered agent."""
    return _r6(C.per_agent(case_outcomes(t), case_findings(t), AGENTS), "recall", "precision")


@query("latency_percentiles", """WITH e AS (SELECT event_type, value FROM events UNION ALL SELECT 'all', value FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS max FROM e GROUP BY 1""")
def latency_percentiles(t: Tables) -> DataFrame:
    """Mean, median, p95 and maximum overall and per event type, exact at any scale."""
    s = C.spread(t.events.select("event_type", "value"), "event_type", "value", {"median": 0.5, "p95": 0.95})
    return s.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"), "max")


@query("risk_distribution", OUTCOME_SQL.rstrip() + """, r AS (SELECT CASE WHEN label = 'benign' THEN 'benign' ELSE family END AS bucket, risk_score FROM oc)
SELECT bucket, count(*) AS n, min(risk_score) AS min, round(quantile_cont(risk_score, 0.5), 4) AS median, round(avg(risk_score), 4) AS mean, max(risk_score) AS max FROM r GROUP BY 1""")
def risk_distribution(t: Tables) -> DataFrame:
    """Risk scores by attack family, benign cases as one bucket."""
    d = cases(t).select(F.when(F.col("label") == "benign", "benign").otherwise(F.col("family")).alias("bucket"), "risk_score")
    s = C.spread(d, "bucket", "risk_score", {"median": 0.5}, total=None)
    return s.select("bucket", "n", "min", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"), "max")


@query("known_misses", OUTCOME_SQL + """SELECT case_id, "set", family, expected_category, prevented, CASE WHEN "set" = 'hard' THEN 'Hard evasion: ' || notes ELSE 'Evasion not matched by regex / parser heuristic' END AS reason
FROM oc WHERE family <> 'scanner_evasion' AND label = 'attack' AND NOT detected""")
def known_misses(t: Tables) -> DataFrame:
    """Headline attacks nobody detected."""
    return C.known_misses(case_outcomes(t))


@query("detected_not_prevented", OUTCOME_SQL + """SELECT case_id, "set", family, categories, blocked, purpose, prevention FROM oc WHERE family <> 'scanner_evasion' AND label = 'attack' AND prevention <> 'warn' AND detected AND NOT prevented""")
def detected_not_prevented(t: Tables) -> DataFrame:
    """Attacks that were seen but went through."""
    return C.detected_not_prevented(case_outcomes(t))


@query("attribution_mismatches", OUTCOME_SQL + """SELECT case_id, "set", family, agent_1 || ';' || agent_2 AS expected_agents, agents_found, expected_category, categories AS categories_found FROM oc WHERE label = 'attack' AND NOT (detected AND category_attributed)""")
def attribution_mismatches(t: Tables) -> DataFrame:
    """Attacks without full attribution, evasion included."""
    return C.attribution_mismatches(case_outcomes(t))


@query("case_report", OUTCOME_SQL + """SELECT case_id, label, "set", family, CAST(detected AS INT) AS detected, CAST(category_attributed AS INT) AS category_attributed, CAST(detected AND category_attributed AS INT) AS attributed,
 CAST(prevented AS INT) AS prevented, CAST(blocked AS INT) AS blocked, CAST(baseline_allowed AS INT) AS baseline_allowed, agents_found, categories, risk_score AS risk, round(total_ms, 3) AS latency_ms FROM oc""")
def case_report(t: Tables) -> DataFrame:
    """Flat case rows as written to the report file."""
    return C.case_report(case_outcomes(t))


@query("family_filter", OUTCOME_SQL + """SELECT family, label, count(*) AS n, count(*) FILTER (detected) AS detected FROM oc WHERE family IN ('prompt_injection', 'request_abuse') GROUP BY 1, 2""")
def family_filter(t: Tables) -> DataFrame:
    """Cases of two named families only; the filter is applied before any join."""
    wanted = cases(t).where(F.col("family").isin("prompt_injection", "request_abuse"))
    o = C.outcomes(wanted, case_findings(t))
    return o.groupBy("family", "label").agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"))


_REP = {"file": "l_suppkey", "status": "CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'suggested' WHEN 1 THEN 'skipped' WHEN 2 THEN 'rejected' ELSE 'fixed' END",
        "risk_before": "CAST(l_quantity AS INT) % 11", "risk_after": "CASE WHEN l_partkey % 5 > 2 THEN 0 ELSE CAST(l_quantity AS INT) % 11 END"}


@query("repair_totals", f"""WITH r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _REP.items())} FROM lineitem)
SELECT coalesce(CAST(file AS VARCHAR), 'all') AS file, findings, fixed, suggested, skipped, rejected, rb AS risk_before, ra AS risk_after, round(CASE WHEN rb > 0 THEN 100.0::DOUBLE * (rb - ra) / rb ELSE 0 END, 6) AS risk_cut_pct, round(fixed::DOUBLE / findings, 6) AS fix_rate
FROM (SELECT file, count(*) AS findings, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status = 'suggested') AS suggested, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'rejected') AS rejected,
 CAST(sum(risk_before) AS BIGINT) AS rb, CAST(sum(risk_after) AS BIGINT) AS ra FROM r GROUP BY ROLLUP (file))""")
def repair_totals(t: Tables) -> DataFrame:
    """Repair outcomes and risk reduction per file and in total."""
    r = t.lineitem.select(*[F.expr(e).alias(n) for n, e in _REP.items()])
    return _r6(C.repair_totals(r, "file"), "risk_cut_pct", "fix_rate")


# ---- classifier evaluation -------------------------------------------------------------------
# Truth: a nine-class label from the label table; predictions: two rule sets over document text.
_TRUTH = "CASE WHEN n_chars % 11 = 0 THEN 'access_error' WHEN n_chars % 13 = 0 THEN 'return_type_error' WHEN toxic = 1 THEN 'type_error' WHEN quality = 0 THEN 'syntax_error' WHEN n_chars % 3 = 0 THEN 'name_resolution' WHEN n_chars % 3 = 1 THEN 'linker_error' ELSE 'other' END"
_PRED_A = "CASE WHEN n_chars % 22 = 0 THEN 'access_error' WHEN n_chars % 39 = 0 THEN 'return_type_error' WHEN text LIKE '%&&&%' THEN 'syntax_error' WHEN n_chars % 3 = 0 AND length(text) > 400 THEN 'name_resolution' WHEN n_chars % 3 = 1 THEN 'linker_error' WHEN text LIKE '%the the%' THEN 'unused_variable' ELSE 'other' END"
_PRED_B = "CASE WHEN n_chars % 11 = 0 AND length(text) > 600 THEN 'access_error' WHEN n_chars % 26 = 0 THEN 'return_type_error' WHEN text LIKE '%###%' THEN 'syntax_error' WHEN n_chars % 3 = 0 THEN 'name_resolution' WHEN n_chars % 3 = 1 AND n_chars % 2 = 0 THEN 'linker_error' WHEN length(text) < 300 THEN 'type_error' ELSE 'other' END"
EVAL_SQL = f"WITH ev AS (SELECT d.doc_id, lang, {_TRUTH} AS truth, {_PRED_A} AS pred_a, {_PRED_B} AS pred_b FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def evaluated(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", F.expr(_TRUTH).alias("truth"), F.expr(_PRED_A).alias("pred_a"), F.expr(_PRED_B).alias("pred_b"))


_DIM = "dim(label) AS (VALUES " + ", ".join(f"({q(c)})" for c in L.CATEGORIES) + ")"


@query("confusion_matrix", EVAL_SQL + f", {_DIM} SELECT dim.label AS truth, " + ", ".join(f"count(*) FILTER (pred_a = {q(c)}) AS {c}" for c in L.CATEGORIES) + " FROM dim LEFT JOIN ev ON ev.truth = dim.label GROUP BY 1")
def confusion_matrix(t: Tables) -> DataFrame:
    """Nine by nine matrix with empty classes kept."""
    return E.confusion(E.pair_counts(evaluated(t), "truth", "pred_a"), L.CATEGORIES)


def _cls_sql(pred: str) -> str:
    return f"""SELECT label, count(*) FILTER (truth = label AND {pred} = label) AS tp, count(*) FILTER (truth <> label AND {pred} = label) AS fp, count(*) FILTER (truth = label) AS support FROM (SELECT truth, {pred}, unnest(list_distinct([truth, {pred}])) AS label FROM ev) GROUP BY 1"""


def _prf(p: str = "tp", fp: str = "fp", s: str = "support") -> tuple[str, str, str]:
    pr, rc = _rat(p, f"{p} + {fp}"), _rat(p, s)
    return pr, rc, f"CASE WHEN ({pr}) + ({rc}) > 0 THEN 2.0::DOUBLE * ({pr}) * ({rc}) / (({pr}) + ({rc})) ELSE 0 END"


_P, _R, _F = _prf()


@query("per_class_prf", EVAL_SQL + f", {_DIM}, c AS ({_cls_sql('pred_a')}) SELECT label, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f1, support FROM (SELECT dim.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(support, 0) AS support FROM dim LEFT JOIN c ON c.label = dim.label)")
def per_class_prf(t: Tables) -> DataFrame:
    """Precision, recall, F1 and support per canonical class."""
    return _r6(E.per_class(E.pair_counts(evaluated(t), "truth", "pred_a"), L.CATEGORIES), "precision", "recall", "f1")


@query("macro_f1", EVAL_SQL + f""", c AS ({_cls_sql('pred_a')}) SELECT round((SELECT count(*) FILTER (truth = pred_a)::DOUBLE / count(*) FROM ev), 6) AS accuracy, (SELECT count(*) FROM ev) AS rows,
 round(avg({_P}), 6) AS macro_precision, round(avg({_R}), 6) AS macro_recall, round(avg({_F}), 6) AS macro_f1, count(*) AS labels FROM c""")
def macro_f1(t: Tables) -> DataFrame:
    """Accuracy and macro scores over the labels that occur."""
    return _r6(E.summary(E.pair_counts(evaluated(t), "truth", "pred_a")), "accuracy", "macro_precision", "macro_recall", "macro_f1")


WATCHED = ("access_error", "return_type_error")
_SC = lambda p: f"(SELECT count(*) FILTER (truth = {p})::DOUBLE / count(*) FROM ev)"
_MF = lambda c: f"(SELECT avg({_F}) FROM {c})"


@query("model_ab_gate", EVAL_SQL + f""", a AS ({_cls_sql('pred_a')}), b AS ({_cls_sql('pred_b')}), g AS (SELECT
 (SELECT count(*) FROM b WHERE label IN ({", ".join(q(c) for c in L.CATEGORIES)}) AND ({_F}) > 0) = 9 AS all_labels, {_SC('pred_b')} >= {_SC('pred_a')} AND {_MF('b')} >= {_MF('a')} AS scores_hold,
 (SELECT count(*) FILTER (truth = pred_b) FROM ev WHERE lang = 'en') >= (SELECT count(*) FILTER (truth = pred_a) FROM ev WHERE lang = 'en') AS bench_holds,
 (SELECT coalesce(bool_and(coalesce(n, 0) >= coalesce(o, 0)), true) FROM (SELECT label, {_F} AS n FROM b) FULL JOIN (SELECT label, {_F} AS o FROM a) USING (label) WHERE {in_sql('label', WATCHED)}) AS watched_hold)
SELECT *, all_labels AND scores_hold AND bench_holds AND watched_hold AS promote FROM g""")
def model_ab_gate(t: Tables) -> DataFrame:
    """Promotion decision of rule set B against rule set A."""
    ev = evaluated(t)
    pa, pb = E.pair_counts(ev, "truth", "pred_a"), E.pair_counts(ev, "truth", "pred_b")
    bench = lambda p: ev.where("lang = 'en'").agg(F.count_if(F.col("truth") == F.col(p))).scalar()
    scored = lambda pairs, p: E.summary(pairs).withColumn("bench_correct", bench(p))
    return E.promotion(scored(pa, "pred_a"), scored(pb, "pred_b"), E.per_class(pa), E.per_class(pb), L.CATEGORIES, WATCHED)


@query("variant_selection", EVAL_SQL + f""", a AS ({_cls_sql('pred_a')}), b AS ({_cls_sql('pred_b')}) SELECT name AS winner FROM (SELECT 'A' AS name, 0 AS place, {_MF('a')} + {_SC('pred_a')} AS s UNION ALL SELECT 'B', 1, {_MF('b')} + {_SC('pred_b')}) ORDER BY s DESC, place LIMIT 1""")
def variant_selection(t: Tables) -> DataFrame:
    """Rule set with the best summed score."""
    ev = evaluated(t)
    rows = None
    for i, (n, p) in enumerate((("A", "pred_a"), ("B", "pred_b"))):
        s = E.summary(E.pair_counts(ev, "truth", p)).select(F.lit(n).alias("name"), F.lit(i).alias("place"), (F.col("macro_f1") + F.col("accuracy")).alias("s"))
        rows = s if rows is None else rows.unionByName(s)
    return E.best_variant(rows, "name", F.col("s"), "place")


# Per-line votes of two cheap line labellers, rolled up to documents.
_VOTE_A = "CASE WHEN contains(line, '###') THEN 'syntax_error' WHEN length(line) % 3 = 0 THEN 'name_resolution' WHEN length(line) % 3 = 1 THEN 'linker_error' ELSE 'other' END"
_VOTE_B = "CASE WHEN contains(line, '&&&') THEN 'syntax_error' WHEN length(line) % 2 = 0 THEN 'linker_error' ELSE 'other' END"


def _maj_sql(expr: str) -> str:
    return f"""SELECT doc_id, pred FROM (SELECT doc_id, pred, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rn FROM (
      SELECT doc_id, {expr} AS pred, count(*) AS n, min(line_no) AS p FROM ln GROUP BY 1, 2)) WHERE rn = 1"""


@query("majority_vote", f"WITH ln AS ({DOC_LINES_SQL}) {_maj_sql(_VOTE_A)}")
def majority_vote(t: Tables) -> DataFrame:
    """Most frequent line label of every document, first seen on ties."""
    ln = T.explode_lines(t.documents, "text", "doc_id")
    return E.majority(ln.select("doc_id", "line_no", F.expr(_VOTE_A).alias("pred")), "doc_id", "pred", "line_no")


@query("method_scores", EVAL_SQL + f""", ln AS ({DOC_LINES_SQL}), va AS ({_maj_sql(_VOTE_A)}), vb AS ({_maj_sql(_VOTE_B)}),
j AS (SELECT truth, coalesce(va.pred = truth AND length(truth) > 0, false) AS a, coalesce(vb.pred = truth, false) AS b FROM ev LEFT JOIN va ON va.doc_id = ev.doc_id LEFT JOIN (SELECT * FROM vb WHERE pred <> 'other') vb ON vb.doc_id = ev.doc_id)
SELECT truth, count(*) AS total, count(*) FILTER (a) AS votes, count(*) FILTER (b) AS gaps, round(100.0::DOUBLE * count(*) FILTER (a) / count(*), 1) AS votes_pct, round(100.0::DOUBLE * count(*) FILTER (b) / count(*), 1) AS gaps_pct FROM j GROUP BY 1""")
def method_scores(t: Tables) -> DataFrame:
    """Correct documents per method and class; the second method abstains where it would say
    'other', and a missing answer counts as wrong."""
    ln = T.explode_lines(t.documents, "text", "doc_id")
    a = E.majority(ln.select("doc_id", "line_no", F.expr(_VOTE_A).alias("pred")), "doc_id", "pred", "line_no")
    b = E.majority(ln.select("doc_id", "line_no", F.expr(_VOTE_B).alias("pred")), "doc_id", "pred", "line_no").where("pred <> 'other'")
    return E.method_scores(evaluated(t), {"votes": a, "gaps": b}, "doc_id", "truth")


_FL, _FH = _wilson_sql("fp", "clean", "1.96", empty=("0.0", "1.0"))
_TL, _TH = _wilson_sql("tp", "flawed", "1.96", empty=("0.0", "1.0"))


@query("labelled_corpus_eval", f"""WITH h AS (SELECT DISTINCT doc_id FROM documents WHERE contains(text, '###') OR contains(text, '&&&')), f AS (SELECT l.doc_id, quality = 0 AS bad, h.doc_id IS NOT NULL AS hit, toxic = 1 AS fixed FROM labels l LEFT JOIN h ON h.doc_id = l.doc_id),
a AS (SELECT count(*) FILTER (bad) AS flawed, count(*) FILTER (bad AND hit) AS tp, count(*) FILTER (NOT bad) AS clean, count(*) FILTER (NOT bad AND hit) AS fp, count(*) FILTER (bad AND fixed) AS rep FROM f)
SELECT flawed, tp, clean, fp, round({_rat('tp', 'flawed')}, 6) AS recall, round({_TL}, 6) AS recall_low, round({_TH}, 6) AS recall_high, round({_rat('fp', 'clean')}, 6) AS fpr, round({_FL}, 6) AS fpr_low, round({_FH}, 6) AS fpr_high,
 round({_rat('tp', 'tp + fp', '1.0')}, 6) AS precision, round({_rat('rep', 'flawed')}, 6) AS repair_rate FROM a""")
def labelled_corpus_eval(t: Tables) -> DataFrame:
    """Recall, false-positive rate and precision of a junk scan over labelled documents."""
    files = t.labels.select("doc_id", (F.col("quality") == 0).alias("bad"), (F.col("toxic") == 1).alias("fixed"))
    hits = t.documents.where(F.col("text").contains("###") | F.col("text").contains("&&&")).select("doc_id")
    return _r6(E.corpus_evaluation(files, hits, "doc_id", "bad", "fixed"), "recall", "recall_low", "recall_high", "fpr", "fpr_low", "fpr_high", "precision", "repair_rate")
