"""Event-log queries: summaries, limits, suppression, energy."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.stats import rounded
from tracesieve.operators import eventlog as G
from tracesieve.operators import stateful as H
from tracesieve.plans.registry import Tables, query

DAY = 86_400_000_000

# Log lines in both record shapes, with some that do not parse.
_LINE = """CASE WHEN event_type = 'signup' AND value < 3 THEN '{"action": broken' WHEN event_type = 'view' THEN
 '{"action": "log", "agents": ["agent_' || CAST(user_id % 4 AS STRING) || '"], "categories": ["cat_' || CAST(user_id % 9 AS STRING) || '", "flat"]}'
 WHEN event_type = 'error' THEN '{"event": "model_unavailable", "details": {"u": "' || CAST(user_id AS STRING) || '"}}'
 ELSE '{"action": "' || CASE WHEN value > 20 THEN 'block' ELSE 'warn' END || '", "findings": [{"agents": ["agent_' || CAST(user_id % 3 AS STRING) || '", "agent_x"], "category": "cat_' || CAST(user_id % 9 AS STRING) || '"}]}' END"""


@query("log_summary", """WITH e AS (SELECT event_type, user_id, value FROM events WHERE NOT (event_type = 'signup' AND value < 3)),
f AS (SELECT 'total' AS dimension, 'all' AS name FROM e
 UNION ALL SELECT 'action', CASE event_type WHEN 'view' THEN 'log' WHEN 'error' THEN 'unknown' ELSE CASE WHEN value > 20 THEN 'block' ELSE 'warn' END END FROM e
 UNION ALL SELECT 'agent', 'agent_' || CAST(CASE event_type WHEN 'view' THEN user_id % 4 ELSE user_id % 3 END AS VARCHAR) FROM e WHERE event_type <> 'error'
 UNION ALL SELECT 'agent', 'agent_x' FROM e WHERE event_type NOT IN ('error', 'view')
 UNION ALL SELECT 'category', 'cat_' || CAST(user_id % 9 AS VARCHAR) FROM e WHERE event_type <> 'error'
 UNION ALL SELECT 'category', 'flat' FROM e WHERE event_type = 'view'),
c AS (SELECT dimension, name, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, name) AS p FROM c)
SELECT dimension, name, n, CAST(CASE WHEN dimension = 'category' AND p <= 5 THEN p END AS INT) AS place FROM r""")
def log_summary(t: Tables) -> DataFrame:
    """Totals of a log in two record shapes, corrupt lines skipped."""
    lines = t.events.select(F.expr(_LINE).alias("line"))
    return G.log_summary(G.parse_log_lines(lines, "line"))


@query("log_tail", "SELECT event_id, epoch_us(ts) AS us, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)")
def log_tail(t: Tables) -> DataFrame:
    """The last 200 events."""
    return G.tail(t.timed_events.select("us", "event_id", "event_type"), ["us", "event_id"], 200)


@query("last_n_per_key", "SELECT user_id, event_id, epoch_us(ts) AS us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def last_n_per_key(t: Tables) -> DataFrame:
    """The last ten events of every user."""
    return G.last_per_key(t.timed_events.select("user_id", "event_id", "us"), ["user_id"], ["us", "event_id"], 10)


@query("rate_trailing_window", f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_trailing_window(t: Tables) -> DataFrame:
    """Events of the same user in the last day, at every event."""
    return G.trailing_counts(t.timed_events.select("event_id", "user_id", "us"), ["user_id"], "us", DAY).drop("us")


def _limit_sql(src: str, key: str, n: int, width: int) -> str:
    """Accepted events by a fold over each key's ordered list."""
    return f"""SELECT {key}, unnest(list_reduce(list_transform(list(us ORDER BY us), lambda x: [x]),
      lambda acc, x: CASE WHEN len(acc) < {n} OR acc[len(acc) - {n - 1}] <= x[1] - {width} THEN list_concat(acc, x) ELSE acc END, CAST([] AS BIGINT[]))) AS us FROM {src} GROUP BY {key}"""


@query("rate_limit", f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), a AS ({_limit_sql('e', 'user_id', 3, DAY)})
SELECT event_id, e.user_id, a.us IS NOT NULL AS accepted FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.us = e.us""")
def rate_limit(t: Tables) -> DataFrame:
    """Sliding-log limiter: at most three accepted events per user and day."""
    return H.limit_rate(t.timed_events.select("event_id", "user_id", "us"), ["user_id"], "us", "event_id", 3, DAY) \
        .select("event_id", "user_id", "accepted")


@query("rolling_budget", f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events), s AS (SELECT * FROM e WHERE value <= 30), a AS ({_limit_sql('s', 'user_id', 2, DAY)})
SELECT event_id, e.user_id, CASE WHEN e.value > 30 THEN 'too_large' WHEN a.us IS NOT NULL THEN 'accepted' ELSE 'over_limit' END AS outcome FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.us = e.us AND e.value <= 30""")
def rolling_budget(t: Tables) -> DataFrame:
    """Two calls per user and day; oversized calls are refused without using the budget."""
    d = t.timed_events.select("event_id", "user_id", "us", "value")
    return H.limit_budget(d, ["user_id"], "us", "event_id", F.col("value"), 30.0, 2, DAY).select("event_id", "user_id", "outcome")


@query("suppress_repeats", f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), a AS ({_limit_sql('e', 'user_id, event_type', 1, 2 * DAY)})
SELECT event_id, a.us IS NOT NULL AS kept FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type AND a.us = e.us""")
def suppress_repeats(t: Tables) -> DataFrame:
    """Repeats of a (user, type) within two days of the last kept one are dropped."""
    d = t.timed_events.select("event_id", "user_id", "event_type", "us")
    return H.suppress_repeats(d, ["user_id", "event_type"], "us", "event_id", 2 * DAY).select("event_id", "kept")


# event time runs 2,000 times as fast, so that eight tokens a minute are not enough
_LEFT = "least(8.0::DOUBLE, acc[1] + (x[1] - acc[2]) * (8.0::DOUBLE / 60000000.0::DOUBLE))"
_OK = f"({_LEFT} >= 1.0 AND (x[2] = 1.0 OR {_LEFT} > 2.0))"


@query("token_bucket", f"""WITH e AS (SELECT event_id, event_type, epoch_us(ts) // 2000 AS us, CASE WHEN user_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urgent FROM events),
l AS (SELECT event_type, list(event_id ORDER BY us, event_id) AS ids, list_reduce(list(CAST([us, urgent] AS DOUBLE[]) ORDER BY us, event_id),
  lambda acc, x: [{_LEFT} - CASE WHEN {_OK} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, x[1]] || acc[3:] || [CASE WHEN {_OK} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END], [8.0::DOUBLE, 0.0::DOUBLE]) AS st FROM e GROUP BY 1)
SELECT unnest(ids) AS event_id, event_type, unnest(st[3:]) = 1.0 AS accepted FROM l""")
def token_bucket(t: Tables) -> DataFrame:
    """Eight tokens a minute and event type, the last two of which are kept for urgent users."""
    d = t.timed_events.select("event_id", "event_type", F.floor(F.col("us") / 2000).cast("bigint").alias("us"), (F.col("user_id") % 4 == 0).alias("urgent"))
    return H.token_bucket(d, ["event_type"], "us", "event_id", F.col("urgent"), 8).select("event_id", "event_type", "accepted")


_ACTIONS = "event_type = 'purchase'"
ENERGY_SQL = f"""WITH s AS (SELECT event_id, epoch_us(ts) AS us, value FROM events WHERE NOT {_ACTIONS}),
d AS (SELECT *, CASE WHEN lag(us) OVER (ORDER BY us, event_id) IS NULL THEN 1.0::DOUBLE ELSE greatest(0.1::DOUBLE, least(5.0::DOUBLE, (us - lag(us) OVER (ORDER BY us, event_id)) / 1000000.0::DOUBLE)) END AS dt, 3.0::DOUBLE + 12.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100.0::DOUBLE)) AS w FROM s),
m AS (SELECT event_id, us, w * 1000.0::DOUBLE AS power_mw, w * dt / 3600.0::DOUBLE AS step_wh, sum(w * dt / 3600.0::DOUBLE) OVER (ORDER BY us, event_id) AS wh FROM d),
act AS (SELECT 'act_' || CAST(user_id % 7 AS VARCHAR) AS label, epoch_us(ts) AS start, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS "end" FROM events WHERE {_ACTIONS}),
u AS (SELECT m.*, a.label, a.start, a."end" FROM m ASOF LEFT JOIN act a ON m.us >= a.start),
met AS (SELECT event_id, us, power_mw, step_wh, wh, CASE WHEN "end" > us THEN label ELSE 'idle' END AS action, CASE WHEN "end" > us THEN start END AS action_start FROM u)
"""


def metered(t: Tables) -> tuple[DataFrame, DataFrame]:
    ev = t.timed_events
    samples = ev.where(f"NOT {_ACTIONS}").select("event_id", "us", "value")
    actions = ev.where(_ACTIONS).select(F.concat(F.lit("act_"), (F.col("user_id") % 7).cast("string")).alias("label"), F.col("us").alias("start"),
                                        (F.col("us") + F.floor(F.col("value") * 60000000).cast("bigint")).alias("end"))
    m = G.energy(samples, "us", "event_id", F.col("value"))
    return G.running_action(m, actions, "us", "event_id"), actions


@query("energy_integral", ENERGY_SQL + "SELECT event_id, round(power_mw, 4) AS power_mw, round(wh * 1000.0::DOUBLE, 4) AS energy_mwh, round(wh * 475.0::DOUBLE, 6) AS co2_mg, action FROM met")
def energy_integral(t: Tables) -> DataFrame:
    """Running session energy with the action of each sample."""
    m, _ = metered(t)
    return m.select("event_id", *[rounded(F.col(c), n).alias(c) for c, n in (("power_mw", 4), ("energy_mwh", 4), ("co2_mg", 6))], "action")


@query("action_energy", ENERGY_SQL.rstrip() + """, p AS (SELECT action, action_start, sum(step_wh) * 1000.0::DOUBLE AS mwh, arg_max(power_mw, us) AS mw FROM met WHERE action <> 'idle' GROUP BY 1, 2),
j AS (SELECT label, start, greatest(0.01::DOUBLE, ("end" - start) / 1000000.0::DOUBLE) AS seconds, coalesce(mwh, 0) AS mwh, mw FROM act LEFT JOIN p ON p.action = label AND p.action_start = start),
k AS (SELECT label, start, seconds, CASE WHEN mwh <= 0.001 AND mw IS NOT NULL THEN mw * seconds / 3600.0::DOUBLE ELSE mwh END AS e FROM j)
SELECT label, start, round(seconds, 6) AS seconds, round(e, 6) AS energy_mwh, round(greatest(0.001::DOUBLE, e / 1000.0::DOUBLE * 475.0::DOUBLE), 6) AS co2_mg FROM k""")
def action_energy(t: Tables) -> DataFrame:
    """Seconds, energy and CO2 of every action."""
    m, actions = metered(t)
    e = G.action_energy(m, actions, "us", "event_id")
    return e.select("label", "start", *[rounded(F.col(c), 6).alias(c) for c in ("seconds", "energy_mwh", "co2_mg")])


@query("live_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def live_counts(t: Tables) -> DataFrame:
    """Events per six-hour window and type; the streaming form uses the same operator."""
    return G.window_counts(t.timed_events, "ts", "event_type", "6 hours")


@query("session_counts", """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, us, sum(n) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM g)
SELECT user_id, min(us) AS session_start, count(*) AS n, least(count(*), 50) AS within_cap FROM s GROUP BY user_id, sid""")
def session_counts(t: Tables) -> DataFrame:
    """Events per user session (12 h pause) and how many fit the session cap."""
    s = t.timed_events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("us").alias("session_start"), F.count("*").alias("n"))
    return s.select("user_id", "session_start", "n", F.least(F.col("n"), F.lit(50)).alias("within_cap"))
