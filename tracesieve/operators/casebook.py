"""Benchmark analytics over case results: detection, prevention, attack success, latency, risk.

``cases`` carries one row per case; ``findings`` one row per (case, agent, origin, category,
severity). Arrays are only built for output columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.ordered import exact_percentiles
from tracesieve.functions.stats import f1, ratio, wilson

EVASION = "scanner_evasion"
MEASURED = ("block", "neutralize")


def outcomes(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds detection, attribution, prevention and false-positive flags to every case.

    A finding counts when its origin is the expected one and its agent is among the expected
    agents; findings are first reduced to distinct facts per case.
    """
    facts = findings.groupBy("case_id", "agent", "origin", "category", "severity").agg(F.count("*").alias("__n"))
    j = facts.join(cases.select("case_id", "expected_agents", "expected_category", "expected_origin"), "case_id")
    match = (F.col("origin") == F.col("expected_origin")) & F.array_contains("expected_agents", F.col("agent"))
    per = j.groupBy("case_id").agg(
        F.bool_or(match).alias("__m"), F.bool_or(match & (F.col("category") == F.col("expected_category"))).alias("__c"),
        F.bool_or((F.col("origin") == "attack") & F.col("severity").isin("Medium", "High", "Critical")).alias("__a"),
        F.array_sort(F.collect_set("agent")).alias("__ag"), F.array_sort(F.collect_set("category")).alias("__ca"))
    attack, benign = F.col("label") == "attack", F.col("label") == "benign"
    no = F.lit(False)
    d, c = attack & F.coalesce("__m", no), attack & F.coalesce("__c", no)
    prevented = attack & F.when(F.col("prevention") == "block", F.col("blocked")).when(
        F.col("prevention") == "neutralize", F.col("neutral")).otherwise(no)
    empty = F.array().cast("array<string>")
    return cases.join(per, "case_id", "left").withColumns({
        "detected": d, "category_attributed": c, "attributed": d & c, "prevented": prevented,
        "alert_fp": benign & F.coalesce("__a", no), "block_fp": benign & F.col("blocked"),
        "agents_found": F.coalesce("__ag", empty), "categories": F.coalesce("__ca", empty)}).drop("__m", "__c", "__a", "__ag", "__ca")


def headline(c: DataFrame) -> DataFrame:
    return c.where(F.col("family") != EVASION)


def manifest_totals(c: DataFrame) -> DataFrame:
    """Nine conditional counts in one pass."""
    ev, at, be = F.col("family") == EVASION, F.col("label") == "attack", F.col("label") == "benign"
    return c.agg(F.count("*").alias("total_cases"), F.count_if(~ev).alias("headline_cases"), F.count_if(~ev & at).alias("headline_attacks"),
                 F.count_if(~ev & be).alias("headline_benign"), F.count_if(~ev & at & (F.col("set") == "standard")).alias("standard_attacks"),
                 F.count_if(~ev & at & (F.col("set") == "hard")).alias("hard_attacks"), F.count_if(ev).alias("evasion_cases"),
                 F.count_if(ev & at).alias("evasion_attacks"), F.count_if(ev & be).alias("evasion_benign"))


def detection(c: DataFrame, by: list[str]) -> DataFrame:
    """Binary detection metrics with intervals per group (or overall for an empty list)."""
    at, be = F.col("label") == "attack", F.col("label") == "benign"
    a = c.groupBy(*by).agg(F.count_if(at).alias("attacks"), F.count_if(at & F.col("detected")).alias("detected"),
                           F.count_if(be).alias("benign"), F.count_if(F.col("alert_fp")).alias("alerts"), F.count_if(F.col("block_fp")).alias("blocks"))
    p = ratio(F.col("detected"), F.col("detected") + F.col("alerts"), 1.0)
    r = ratio(F.col("detected"), F.col("attacks"))
    lo, hi = wilson(F.col("detected"), F.col("attacks"))
    al, ah = wilson(F.col("alerts"), F.col("benign"))
    return a.select(*by, "attacks", "detected", "benign", "alerts", "blocks", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"),
                    lo.alias("recall_low"), hi.alias("recall_high"), ratio(F.col("alerts"), F.col("benign")).alias("alert_rate"),
                    al.alias("alert_low"), ah.alias("alert_high"))


def attack_success(c: DataFrame) -> DataFrame:
    """Attack success before and after defence: overall, per set and per family in one pass.

    Overall and set rows leave evasion cases out, family rows keep them: the filter sits inside
    the conditional sums because it depends on the grouping.
    """
    at = F.col("label") == "attack"
    measured = at & F.col("prevention").isin(*MEASURED)

    def n(cond: Column, kept: Column) -> Column:
        return F.count_if(cond & kept)

    main = F.col("family_raw") != EVASION
    every = F.lit(True)
    src = c.withColumn("family_raw", F.col("family"))
    g = src.groupingSets([[], [F.col("set")], [F.col("family")]], F.col("set"), F.col("family"))
    cols = {"attacks": at, "detected": at & F.col("detected"), "measured": measured, "prevented": measured & F.col("prevented"),
            "base_allowed": measured & F.col("baseline_allowed")}
    a = g.agg(F.grouping_id().alias("__g"), *[n(v, main).alias(f"__m_{k}") for k, v in cols.items()],
              *[n(v, every).alias(f"__e_{k}") for k, v in cols.items()])
    fam = F.col("__g") == 2  # set rolled up, family kept
    pick = {k: F.when(fam, F.col(f"__e_{k}")).otherwise(F.col(f"__m_{k}")) for k in cols}
    level = F.when(F.col("__g") == 3, "overall").when(fam, "family").otherwise("set")
    a = a.select(level.alias("level"), F.coalesce("set", "family", F.lit("all")).alias("name"), *[v.alias(k) for k, v in pick.items()])
    before = ratio(F.col("base_allowed"), F.col("measured"))
    after = ratio(F.col("measured") - F.col("prevented"), F.col("measured"))
    lo, hi = wilson(F.col("prevented"), F.col("measured"))
    return a.select("*", before.alias("success_before"), after.alias("success_after"),
                    F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0)).alias("reduction"),
                    lo.alias("prevention_low"), hi.alias("prevention_high"))


def per_agent(c: DataFrame, findings: DataFrame, agents: list[str]) -> DataFrame:
    """Recall over the cases that expect an agent and false positives on benign cases."""
    exp = (c.where("label = 'attack'").select(F.explode("expected_agents").alias("agent"), "detected")
           .groupBy("agent").agg(F.count("*").alias("expected"), F.count_if("detected").alias("hits")))
    bad = findings.where((F.col("origin") == "attack") & F.col("severity").isin("Medium", "High", "Critical")) \
        .groupBy("case_id", "agent").agg(F.count("*").alias("__n"))
    fp = bad.join(c.where("label = 'benign'").select("case_id"), "case_id", "left_semi").groupBy("agent").agg(F.count("*").alias("fps"))
    dim = c.sparkSession.createDataFrame([(a,) for a in agents], "agent string")
    j = F.broadcast(dim).join(exp, "agent", "left").join(fp, "agent", "left").na.fill(0)
    return j.select("agent", "expected", "hits", "fps", ratio(F.col("hits"), F.col("expected")).alias("recall"),
                    ratio(F.col("hits"), F.col("hits") + F.col("fps"), 1.0).alias("precision"))


def spread(df: DataFrame, by: str, value: str, ps: dict[str, float], total: str | None = "all") -> DataFrame:
    """Mean, exact percentiles and extremes per group, plus one row over everything.

    The values are first reduced to a histogram; the overall row is built from it, not from a
    second pass over the rows.
    """
    hist = df.groupBy(by, value).agg(F.count("*").alias("__c"), F.sum(value).alias("__s"))
    if total:
        hist = hist.unionByName(hist.groupBy(value).agg(F.sum("__c").alias("__c"), F.sum("__s").alias("__s")).withColumn(by, F.lit(total)))
    base = hist.groupBy(by).agg(F.sum("__c").alias("n"), (F.sum("__s") / F.sum("__c")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return base.join(exact_percentiles(hist, [by], value, "__c", ps), by)


def spread_sketch(df: DataFrame, by: str, value: str, ps: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Approximate variant of ``spread`` for dashboards; its percentiles are sample values."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"),
                              *[F.percentile_approx(value, p, accuracy).alias(k) for k, p in ps.items()])


def known_misses(c: DataFrame) -> DataFrame:
    """Headline attacks that no expected agent found, with the reason text of their set."""
    reason = F.when(F.col("set") == "hard", F.concat(F.lit("Hard evasion: "), F.col("notes"))).otherwise(
        "Evasion not matched by regex / parser heuristic")
    return headline(c).where("label = 'attack' AND NOT detected").select("case_id", "set", "family", "expected_category", "prevented", reason.alias("reason"))


def detected_not_prevented(c: DataFrame) -> DataFrame:
    return headline(c).where(F.col("prevention").isin(*MEASURED) & (F.col("label") == "attack") & F.col("detected") & ~F.col("prevented")) \
        .select("case_id", "set", "family", F.array_join("categories", ";").alias("categories"), "blocked", "purpose", "prevention")


def attribution_mismatches(c: DataFrame) -> DataFrame:
    """Attacks of every family, evasion included, without full attribution."""
    return c.where("label = 'attack' AND NOT (detected AND category_attributed)").select(
        "case_id", "set", "family", F.array_join("expected_agents", ";").alias("expected_agents"),
        F.array_join("agents_found", ";").alias("agents_found"), "expected_category", F.array_join("categories", ";").alias("categories_found"))


def case_report(c: DataFrame) -> DataFrame:
    """Flat report rows: flags as 0/1, arrays joined, latency to three places."""
    flags = ["detected", "category_attributed", "attributed", "prevented", "blocked", "baseline_allowed"]
    return c.select("case_id", "label", "set", "family", *[F.col(f).cast("int").alias(f) for f in flags],
                    F.array_join("agents_found", ";").alias("agents_found"), F.array_join("categories", ";").alias("categories"),
                    F.col("risk_score").alias("risk"), F.round("total_ms", 3).alias("latency_ms"))


def repair_totals(df: DataFrame, file: str) -> DataFrame:
    """Repair outcomes per file and in total from (file, status, risk_before, risk_after) rows."""
    st = F.col("status")
    g = df.rollup(file).agg(F.count("*").alias("findings"), *[F.count_if(st == s).alias(s) for s in ("fixed", "suggested", "skipped", "rejected")],
                            F.sum("risk_before").alias("risk_before"), F.sum("risk_after").alias("risk_after"))
    cut = F.when(F.col("risk_before") > 0, F.lit(100.0) * (F.col("risk_before") - F.col("risk_after")) / F.col("risk_before")).otherwise(0.0)
    return g.select(F.coalesce(F.col(file).cast("string"), F.lit("all")).alias("file"), "findings", "fixed", "suggested", "skipped", "rejected",
                    "risk_before", "risk_after", cut.alias("risk_cut_pct"), ratio(F.col("fixed"), F.col("findings")).alias("fix_rate"))
