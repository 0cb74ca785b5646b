"""Findings to verdicts: taxonomy, merge, policy, risk rollups and SARIF rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.ordered import first_per_key
from tracesieve.functions.rules import risk_label, severity_rank, severity_weight

# fixed values: finding type -> CWE id, CERT rule
TAXONOMY: tuple[tuple[str, str, str], ...] = (
    ("Buffer Overflow", "CWE-120", "ARR30-C"),
    ("Unsafe String Function", "CWE-676", "STR31-C"),
    ("Unsafe Memory Copy", "CWE-120", "ARR30-C"),
    ("Format String Vulnerability", "CWE-134", "FIO30-C"),
    ("Null Pointer Dereference", "CWE-476", "EXP34-C"),
    ("Dangling Pointer", "CWE-562", "DCL30-C"),
    ("Use After Free", "CWE-416", "MEM50-CPP"),
    ("Double Free", "CWE-415", "MEM51-CPP"),
    ("Potential Memory Leak", "CWE-401", "MEM51-CPP"),
    ("Integer Overflow", "CWE-190", "INT30-C"),
    ("Integer Underflow", "CWE-191", "INT32-C"),
    ("Logic Error / Integer Overflow Risk", "CWE-190", "INT30-C"),
    ("Signed/Unsigned Mismatch", "CWE-195", "INT31-C"),
    ("Division by Zero", "CWE-369", "INT33-C"),
    ("Command Injection", "CWE-78", "ENV33-C"),
    ("Process Execution", "CWE-78", "ENV33-C"),
    ("Insecure Randomness", "CWE-338", "MSC50-CPP"),
    ("Weak Randomness", "CWE-338", "MSC50-CPP"),
    ("Uninitialized Memory", "CWE-457", "EXP33-C"),
    ("Uninitialized Variable", "CWE-457", "EXP33-C"),
    ("Unbounded Input", "CWE-120", "FIO34-C"),
    ("Unchecked Return Value", "CWE-252", "ERR33-C"),
    ("Missing Error Handling (fopen)", "CWE-252", "FIO42-C"),
    ("Infinite Recursion", "CWE-674", "MSC15-C"),
    ("Unused Variable / Dead Code", "CWE-563", "MSC13-C"),
    ("Use of Deprecated API", "CWE-477", "MSC24-C"),
    ("Unsafe Pointer Arithmetic", "CWE-469", "ARR37-C"),
    ("Hardcoded Secret / Sensitive Word", "CWE-798", "MSC03-C"),
    ("Disabled Safety Check (assert in release)", "CWE-670", "MSC11-C"),
    ("Vector Out of Bounds", "CWE-129", "CTR50-CPP"),
)

# fixed values: finding category -> CAPEC id
CAPEC: tuple[tuple[str, str], ...] = (
    ("process_execution", "CAPEC-88"), ("command_injection", "CAPEC-88"), ("destructive_file_op", "CAPEC-165"),
    ("sensitive_file_access", "CAPEC-126"), ("network_access", "CAPEC-594"), ("inline_assembly", "CAPEC-242"),
    ("dynamic_loading", "CAPEC-641"), ("obfuscation", "CAPEC-24"), ("startup_code", "CAPEC-550"),
    ("unsafe_include", "CAPEC-253"), ("prompt_injection", "CAPEC-690"), ("encoded_payload", "CAPEC-267"),
    ("role_marker", "CAPEC-690"), ("hidden_prompt_unicode", "CAPEC-71"), ("secret_exfiltration_request", "CAPEC-118"),
    ("policy_bypass_request", "CAPEC-690"), ("macro_expansion_bomb", "CAPEC-197"), ("huge_allocation", "CAPEC-130"),
    ("possible_infinite_loop", "CAPEC-130"), ("oversized_input", "CAPEC-130"), ("special_file_include", "CAPEC-130"),
    ("cross_site_request", "CAPEC-62"), ("bad_host", "CAPEC-137"), ("bad_token", "CAPEC-115"), ("bad_origin", "CAPEC-62"),
    ("body_too_large", "CAPEC-130"), ("display_injection", "CAPEC-242"), ("terminal_escape", "CAPEC-268"),
    ("hidden_unicode", "CAPEC-71"), ("spoofed_status", "CAPEC-148"), ("hardcoded_secret", "CAPEC-37"),
    ("tool_secret_value", "CAPEC-118"), ("secret_env_access", "CAPEC-126"), ("patch_removes_guard", "CAPEC-552"),
    ("patch_security_downgrade", "CAPEC-552"), ("patch_injection_text", "CAPEC-690"), ("model_hash_mismatch", "CAPEC-184"),
    ("model_manifest_missing", "CAPEC-184"),
)

# fixed values: categories a site policy may downgrade, by setting
TOGGLES = {"allow_system_calls": "process_execution", "allow_assembly": "inline_assembly", "allow_sys_includes": "unsafe_include"}


def add_taxonomy(df: DataFrame, finding_type: str, cwe: str = "cwe_id", cert: str = "cert_rule") -> DataFrame:
    """Fills CWE and CERT where not already set; the dimension has 30 rows and is broadcast."""
    dim = df.sparkSession.createDataFrame(list(TAXONOMY), f"{finding_type} string, __cwe string, __cert string")
    out = df
    for c in (cwe, cert):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return (out.join(F.broadcast(dim), finding_type, "left")
            .withColumns({cwe: F.coalesce(cwe, "__cwe"), cert: F.coalesce(cert, "__cert")}).drop("__cwe", "__cert"))


def add_capec(df: DataFrame, category: str = "category") -> DataFrame:
    dim = df.sparkSession.createDataFrame(list(CAPEC), f"{category} string, __capec string")
    out = df if "capec_id" in df.columns else df.withColumn("capec_id", F.lit(None).cast("string"))
    return out.join(F.broadcast(dim), category, "left").withColumn("capec_id", F.coalesce("capec_id", "__capec")).drop("__capec")


def dedupe_findings(df: DataFrame, identity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First of every fully equal finding."""
    return first_per_key(df, list(identity), order)


def add_second_scan(first: DataFrame, second: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """Findings of a second scanner only where the first has none with the same keys."""
    fresh = first_per_key(second, keys, order)
    known = first.select(*keys).distinct().withColumn("__known", F.lit(True))
    cond = [fresh[k].eqNullSafe(known[k]) for k in keys]
    return first.unionByName(fresh.join(known, cond, "left_anti"))


def order_by_severity(df: DataFrame) -> DataFrame:
    """Severity, file, line and column with missing ones last, type."""
    return df.orderBy(severity_rank(F.col("severity")), "file", F.asc_nulls_last("line"), F.asc_nulls_last("column"), "finding_type")


def order_for_view(df: DataFrame) -> DataFrame:
    """Severity, then line with missing lines first."""
    return df.orderBy(severity_rank(F.col("severity")), F.coalesce("line", F.lit(0)))


def apply_toggles(df: DataFrame, **settings: bool) -> DataFrame:
    """Permitted categories become Low warnings."""
    names = [TOGGLES[k] for k, v in settings.items() if v]
    if not names:
        return df
    on = F.col("category").isin(*names)
    return df.withColumns({"severity": F.when(on, "Low").otherwise(F.col("severity")),
                           "action": F.when(on, "warn").otherwise(F.col("action"))})


def merge_findings(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One finding per (input, line, category); a missing line is one group.

    The most severe finding (first in ``order`` on ties) gives severity, evidence and action;
    agents and purposes are unions. ``blocks_on`` stays NULL only where every part is NULL.
    Sets are combined map-side, so a heap of equal findings leaves each task as one row.
    """
    rank = F.struct(severity_rank(F.col("severity")), *[F.col(c) for c in order])
    best = F.min_by(F.struct("severity", "evidence", "action"), rank)
    sets = F.collect_set("blocks_on")
    grouped = df.groupBy(*keys, "line", "category").agg(
        best.alias("__b"),
        F.array_sort(F.collect_set("agent")).alias("agents"),
        F.when(F.bool_or(F.col("origin") == "attack"), "attack").otherwise("vulnerability").alias("origin"),
        F.min_by("evidence", F.when(F.col("evidence") != "", rank)).alias("__ev"),
        F.when(F.size(sets) > 0, F.array_sort(F.array_distinct(F.flatten(sets)))).alias("blocks_on"))
    return grouped.select(*keys, "line", "category", "agents", "origin", F.col("__b.severity").alias("severity"),
                          F.coalesce(F.nullif(F.col("__b.evidence"), F.lit("")), "__ev", F.lit("")).alias("evidence"),
                          F.col("__b.action").alias("action"), "blocks_on")


def decide(merged: DataFrame, purpose: str) -> DataFrame:
    """Final action of each merged finding for the purpose of its input."""
    default = (F.col(purpose) == "run") & (F.col("origin") == "attack") \
        & (F.col("severity").isin("Critical", "High") | (F.col("category") == "guard_error"))
    blocks = F.when(F.col("blocks_on").isNotNull(), F.array_contains("blocks_on", F.col(purpose))).otherwise(default)
    warns = (F.col("action") == "warn") | F.col("severity").isin("Critical", "High", "Medium")
    return merged.withColumn("action", F.when(blocks, "block").when(warns, "warn").otherwise("allow"))


def worth_logging(decided: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, findings, blocked) of the inputs that are logged: those with an attack or a block among their findings."""
    g = decided.groupBy(*keys).agg(F.count("*").alias("findings"), F.bool_or(F.col("action") == "block").alias("blocked"),
                                   F.bool_or(F.col("origin") == "attack").alias("__attack"))
    return g.where("__attack OR blocked").drop("__attack")


def verdicts(inputs: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """One row per input and purpose: score, label, action. Inputs without findings are Clean."""
    agg = decided.groupBy(*keys).agg(
        F.sum(severity_weight(F.col("severity"))).alias("__s"), F.count("*").alias("__n"),
        F.bool_or(F.col("action") == "block").alias("__b"), F.bool_or(F.col("action") == "warn").alias("__w"))
    score = F.coalesce("__s", F.lit(0))
    return inputs.select(*keys).join(agg, keys, "left").select(
        *keys, F.coalesce("__n", F.lit(0)).alias("findings"), score.cast("bigint").alias("risk_score"),
        risk_label(score).alias("risk_label"),
        F.when(F.col("__b"), "block").when(F.col("__w"), "warn").otherwise("allow").alias("action"),
        F.coalesce("__b", F.lit(False)).alias("blocked"))


def blocked_purposes(v: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    return v.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("blocked"), F.col(purpose)))), ";").alias("blocked_purposes"))


def risk_rollup(groups: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Severity counts, score and label per group; groups without findings stay as Clean."""
    sev = F.col("severity")
    agg = findings.groupBy(key).agg(*[F.count_if(sev == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")],
                                    F.sum(severity_weight(sev)).alias("__s"))
    score = F.coalesce("__s", F.lit(0)).cast("bigint")
    return groups.join(agg, key, "left").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "high", "medium", "low")],
        score.alias("score"), risk_label(score).alias("label"))


def severity_profile(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Findings by severity, and findings of blocked inputs by category and by agent."""
    blocked = merged.where(F.col("__blocked")) if "__blocked" in merged.columns else merged
    sev = merged.groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("n")).withColumn("dimension", F.lit("severity"))
    cat = blocked.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")).withColumn("dimension", F.lit("blocked_category"))
    ag = (blocked.select(F.explode("agents").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
          .withColumn("dimension", F.lit("blocked_agent")))
    return sev.unionByName(cat).unionByName(ag)


def agent_activity(merged: DataFrame, agents: Sequence[str]) -> DataFrame:
    """Findings per registered agent; inactive agents stay with zero."""
    reg = merged.sparkSession.createDataFrame([(a, i) for i, a in enumerate(agents)], "agent string, place int")
    n = merged.select(F.explode("agents").alias("agent")).groupBy("agent").agg(F.count("*").alias("__n"))
    return F.broadcast(reg).join(n, "agent", "left").select("agent", "place", F.coalesce("__n", F.lit(0)).alias("findings"),
                                                            (F.coalesce("__n", F.lit(0)) > 0).alias("active"))


# fixed values: SARIF levels
SARIF_LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note"}


def sarif_rows(df: DataFrame) -> DataFrame:
    """Result rows: rule id, level and location with line and column at least 1."""
    lv = F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv])
    rule = F.coalesce("cwe_id", F.upper(F.replace("finding_type", F.lit(" "), F.lit("_"))))
    return df.select("file", rule.alias("rule_id"), "finding_type", F.coalesce(F.try_element_at(lv, "severity"), F.lit("warning")).alias("level"),
                     F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("start_line"),
                     F.greatest(F.coalesce("column", F.lit(1)), F.lit(1)).alias("start_column"))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """First finding type seen per rule id, in file and line order."""
    return rows.groupBy("rule_id").agg(F.min_by("finding_type", F.struct("file", "start_line", "start_column", "finding_type")).alias("name"))
