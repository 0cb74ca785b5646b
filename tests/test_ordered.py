import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tracesieve.functions import ordered as O
from tracesieve.functions.stats import Z_SHORT, wilson
from tracesieve.functions.ordered import numbered
from tracesieve.operators import diagnostics as DG
from tracesieve.operators import eventlog as G
from tracesieve.operators import stateful as H
from tracesieve.operators.dataset import assert_no_leakage, cap_per_class

DAY = 1000


def events(seed, n, keys, span, hot=0.5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(keys)
        rows.append((i, k, rnd.randrange(span)))
    return rows


def limiter(rows, n, w):
    got, state = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        acc = [x for x in state.get(k, []) if x > t - w]
        got[i] = len(acc) < n
        if got[i]:
            acc.append(t)
        state[k] = acc
    return got


def test_limiter_equals_fold(spark):
    for seed, n, w, span in ((1, 3, 50, 4000), (2, 1, 200, 3000), (3, 5, 100, 1500), (4, 2, 7, 900)):
        rows = events(seed, 800, 4, span)
        df = spark.createDataFrame(rows, "event_id bigint, k bigint, us bigint").repartition(5)
        got = {r.event_id: r.accepted for r in H.limit_rate(df, ["k"], "us", "event_id", n, w, bucket=4 * w).collect()}
        assert got == limiter(rows, n, w), (seed, n, w)


def test_token_bucket_equals_fold(spark):
    rnd = random.Random(5)
    t, rows = 0, []
    for i in range(500):
        t += rnd.choice([1_000_000, 5_000_000, 20_000_000, 70_000_000])
        rows.append((i, i % 2, t, rnd.random() < 0.3))
    want, st = {}, {}
    for i, k, at, urgent in rows:
        tokens, last = st.get(k, (6.0, None))
        if last is not None:
            tokens = min(6.0, tokens + (at - last) * 6 / 60e6)
        ok = tokens >= 1 and (urgent or tokens > 1.5)
        st[k] = (tokens - 1 if ok else tokens, at)
        want[i] = ok
    df = spark.createDataFrame(rows, "event_id bigint, k bigint, us bigint, urgent boolean")
    got = {r.event_id: r.accepted for r in H.token_bucket(df, ["k"], "us", "event_id", F.col("urgent"), 6, chunk=100_000_000).collect()}
    assert got == want


def test_running_over_small_chunks(spark):
    rnd = random.Random(9)
    rows = [(k, i, rnd.choice([-2, -1, 0, 1, 2])) for k in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "k bigint, p bigint, v bigint").repartition(7)
    chunk = F.floor(F.col("p") / 5)
    got = {(r.k, r.p): (r.s, r.m) for r in O.running(df, ["k"], chunk, ["p"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}).collect()}
    floor = {(r.k, r.p): (r.d, r.d_after) for r in O.running_floored(df, ["k"], chunk, ["p"], F.col("v"), F.least(F.col("v"), F.lit(0)), "d").collect()}
    last = {(r.k, r.p): r.x for r in O.carry_forward(df, ["k"], chunk, ["p"], {"x": F.when(F.col("v") == 2, F.col("p"))}).collect()}
    for k in range(3):
        s, m, d, x = 0, 99, 0, None
        for i in range(120):
            v = next(r[2] for r in rows if r[0] == k and r[1] == i)
            assert last[(k, i)] == x
            s, m, before = s + v, min(m, v), d
            d = max(0, d + v)
            x = i if v == 2 else x
            assert got[(k, i)] == (s, m) and floor[(k, i)] == (before, d)


def test_percentiles_and_trailing(spark):
    rnd = np.random.default_rng(3)
    vals = np.round(rnd.gamma(1.0, 5.0, 999), 2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "k int, v double")
    hist = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r.k: (r.a, r.b) for r in O.exact_percentiles(hist, ["k"], "v", "n", {"a": 0.5, "b": 0.95}, ranges=7).collect()}
    for k in (0, 1):
        mine = vals[k::2]
        assert np.allclose(got[k], (np.percentile(mine, 50), np.percentile(mine, 95)))
    rows = events(11, 400, 3, 500)
    e = spark.createDataFrame(rows, "event_id bigint, k bigint, us bigint")
    t = {r.event_id: r.c for r in O.trailing(e, ["k"], "us", 20, {"c": lambda: F.count("*")}, bucket=30).collect()}
    assert t == {i: sum(1 for _, k2, u2 in rows if k2 == k and u - 20 < u2 <= u) for i, k, u in rows}


def test_ranges_are_balanced(spark):
    """One outlier, a hot key and a burst: no range holds more than twice the median, and the numbers ascend with the order."""
    rnd = random.Random(21)
    values = [rnd.random() for _ in range(7999)] + [1e12]
    rows = [(0 if rnd.random() < 1 / 3 else rnd.randrange(1, 40), v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k bigint, v double, i bigint").repartition(5)
    for by in (["v"], ["k", "v"], ["k", "i"]):
        got = [(tuple(r[c] for c in by), r[O.RANGE]) for r in O.by_ranges(df, by, 16).collect()]
        sizes = sorted(np.bincount([n for _, n in got], minlength=16))
        assert len(sizes) == 16 and sizes[-1] <= 2 * np.median(sizes)
        assert [n for _, n in sorted(got)] == sorted(n for _, n in got)
    hot = {n for r in O.by_ranges(df, ["k", "v"], 16).where("k = 0").collect() for n in [r[O.RANGE]]}
    assert len(hot) >= 5


def test_percentiles_with_an_outlier(spark):
    rnd = np.random.default_rng(4)
    vals = np.append(np.round(rnd.random(3000), 3), 1e12)
    hist = spark.createDataFrame([("x", float(v)) for v in vals], "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    r = O.exact_percentiles(hist, ["k"], "v", "n", {"a": 0.5, "b": 0.99, "c": 1.0}, ranges=11).first()
    assert np.allclose((r.a, r.b, r.c), [np.percentile(vals, p) for p in (50, 99, 100)])


def test_ranked_equals_row_number(spark):
    rnd = random.Random(6)
    rows = [(None if rnd.random() < 0.1 else 0 if rnd.random() < 0.5 else rnd.randrange(5), rnd.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint, i bigint").repartition(6)
    want, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert {r.i: r.place for r in O.ranked(df, ["k"], ["v", "i"], "place").collect()} == want
    whole = {r.i: r.place for r in O.ranked(df, [], [F.desc("v"), "i"], "place").collect()}
    assert whole == {i: n for n, (_, i) in enumerate(sorted((-v, i) for _, v, i in rows), 1)}
    assert O.ranked(df.where("i < 0"), ["k"], ["v"], "place").collect() == []
    plan = O.ranked(df, ["k"], ["v", "i"], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and not any(re.search(r"\bk#", x) for x in plan.splitlines() if "Window [" in x)


def test_energy_of_a_burst(spark):
    """All samples within one minute are still several ranges, with the sums of one pass."""
    rows = [(i, 1_000_000 * 60 + i * 7_000, float(i % 100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, pct double")
    got = {r.event_id: r.energy_mwh for r in G.energy(df, "us", "event_id", F.col("pct"), ranges=8).collect()}
    total = 0.0
    for i, _, pct in rows:
        total += (3.0 + 12.0 * pct / 100) * (1.0 if i == 0 else 0.1) / 3600
        assert abs(got[i] - total * 1000) < 1e-6


def test_running_energy_is_the_exact_sum(spark):
    rnd = random.Random(5)
    us = sorted(rnd.randrange(10 ** 10) for _ in range(6000))
    rows = [(i, t, rnd.random() * 100) for i, t in enumerate(us)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, pct double").repartition(4)
    got = G.energy(df, "us", "event_id", F.col("pct"), ranges=6).orderBy("us", "event_id").collect()
    for n in range(100, len(got), 97):
        assert math.isclose(got[n].co2_mg, math.fsum(r.step_wh for r in got[:n + 1]) * 475.0, rel_tol=5e-16)


def test_action_energy_takes_the_last_of_samples_at_one_time(spark):
    m = spark.createDataFrame([(i, 7, float(i), 1e-9, "a", 5) for i in (3, 1, 4, 2)], "event_id bigint, us bigint, power_mw double, step_wh double, action string, action_start bigint")
    actions = spark.createDataFrame([("a", 5, 3_600_000_005)], "label string, start bigint, end bigint")
    for parts in (1, 4):
        assert G.action_energy(m.repartition(parts), actions, "us", "event_id").collect()[0].energy_mwh == 4.0

def test_wilson_golden(spark):
    def iv(k, n, **kw):
        lo, hi = wilson(F.lit(k), F.lit(n), **kw)
        r = spark.range(1).select(F.round(lo, 4), F.round(hi, 4)).first()
        return r[0], r[1]
    assert iv(84, 89) == (0.8751, 0.9758) and iv(78, 84) == (0.8528, 0.9669) and iv(7, 12) == (0.3195, 0.8067)
    assert iv(0, 31) == (0.0, 0.1103) and iv(0, 0) == (0.0, 0.0) and iv(0, 0, z=Z_SHORT, empty=(0.0, 1.0)) == (0.0, 1.0)


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, i % 3) for i in range(500)]
    a = spark.createDataFrame(rows, "i bigint, c bigint")
    one = sorted(map(tuple, cap_per_class(a.repartition(1), "c", [F.col("i")], 40).collect()))
    assert one == sorted(map(tuple, cap_per_class(a.repartition(8), "c", [F.col("i")], 40).collect())) and len(one) == 120


def test_leakage_assert(spark):
    gold = spark.createDataFrame([("g",)], "key string")
    assert_no_leakage(spark.createDataFrame([("a", "train"), ("b", "test")], "key string, split string"), "key", "split", gold)
    try:
        assert_no_leakage(spark.createDataFrame([("a", "train"), ("a", "test")], "key string, split string"), "key", "split", gold)
    except ValueError as e:
        assert "train_test" in str(e)
    else:
        raise AssertionError("leak not reported")


def test_numbered(spark):
    """Places by a hot key, over stretches, with nulls and repeats; one exchange of the rows themselves."""
    rows = [(i % 7 and 1, (i * 37) % 500 - 100, i) for i in range(2000)] + [(None, 5, 1), (None, 9, 2), (1, None, 3), (2, 1 << 40, 4)]
    df = spark.createDataFrame(rows, "g int, at bigint, v int")
    got = numbered(df, "g", "at", [F.min("v").alias("v")], "n", width=64)
    want = {}
    for g, at, v in rows:
        want[g, at] = min(v, want.get((g, at), v))
    expected, seen = set(), {}
    for g, at in sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)):
        seen[g] = seen.get(g, 0) + 1
        expected.add((g, at, want[g, at], seen[g]))
    assert {(r.g, r.at, r.v, r.n) for r in got.collect()} == expected
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_mark_blocks_across_chunks(spark):
    """Blocks opened in one chunk and closed in a later one, chunks without events, lines that open and close; marked with one cached copy."""
    from tracesieve import session
    rnd = random.Random(5)
    texts = [DG.BLOCK_OPEN + " x", DG.BLOCK_CLOSE, DG.BLOCK_OPEN + " " + DG.BLOCK_CLOSE] + ["a.c:1: error: b"] * 9
    rows = [(f, i, rnd.choice(texts)) for f in range(6) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "file int, line_no int, line string")
    held = len(session._SHARED)
    got = DG.mark_blocks(df, ["file"], F.floor(F.col("line_no") / 7))
    assert len(session._SHARED) == held + 1
    want, file = set(), None
    for f, i, line in rows:
        if f != file:
            file, state, n = f, "c", 0
        o, c = DG.BLOCK_OPEN in line, DG.BLOCK_CLOSE in line
        inside = state == "o"
        n += o and not inside
        want.add((f, i, n if inside or o else None))
        state = "c" if c else "o" if o else state
    assert {(r.file, r.line_no, r.block) for r in got.collect()} == want


def test_label_chains_lower_a_text_once(spark):
    df = spark.createDataFrame([("Unused Variable 'x'",)], "m string")
    from tracesieve.operators import labels as L
    for label in (L.override, L.phrase_label, L.verified_label, L.failure_reason, L.keyword_candidates):
        plan = df.select(label(F.col("m")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1, label
