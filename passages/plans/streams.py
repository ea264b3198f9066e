"""Queries over event streams, in their batch form; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.adapters import view, with_views
from passages.plans.accounting import _BUCKET, _RANGES, BOUNDS
from passages.streaming import lockouts, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return register


def _usage(spark, sf_dir):
    return view(spark, sf_dir, "usage_events").withColumnRenamed("created_at", "ts")


_FIVE = "time_bucket(INTERVAL 5 MINUTE, ts)"


@query(f"SELECT {_FIVE} AS window_start, route, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM requests GROUP BY 1, 2", "requests")
def request_rate(spark, sf_dir):
    return windows.request_rate(view(spark, sf_dir, "requests"))


@query(f"SELECT {_FIVE} AS window_start, route, round(count(*) / 300.0::DOUBLE, 6) AS per_second FROM requests WHERE status >= 500 GROUP BY 1, 2", "requests")
def error_rate(spark, sf_dir):
    return windows.error_rate(view(spark, sf_dir, "requests"))


_LE = ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le_{i}" for i, b in enumerate(BOUNDS))


_SQL_P95 = "CASE " + " ".join(f"WHEN le_{i} >= n * 0.95::DOUBLE THEN {low} + ({b} - {low}) * (n * 0.95::DOUBLE - {below}) / (le_{i} - {below})" for i, (b, low, below) in enumerate(zip(BOUNDS, [0.0, *BOUNDS], ["0", *[f"le_{i}" for i in range(len(BOUNDS))]]))) + f" ELSE {BOUNDS[-1]} END"


@query(f"SELECT *, round(({_SQL_P95})::DOUBLE, 6) AS p95 FROM (SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start, route, {_LE}, count(*) AS n FROM requests, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2)", "requests")
def latency_p95(spark, sf_dir):
    return windows.latency_p95(view(spark, sf_dir, "requests"), BOUNDS)


@query("SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, model, direction, round(sum(tokens) / 300.0::DOUBLE, 6) AS per_second FROM (SELECT created_at, model, 'in' AS direction, tokens_in AS tokens FROM usage_events UNION ALL SELECT created_at, model, 'out', tokens_out FROM usage_events) GROUP BY 1, 2, 3", "usage_events")
def token_rate(spark, sf_dir):
    return windows.token_rate(_usage(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, model, (sum(cost_micro) * 12)::BIGINT AS micro_per_hour FROM usage_events WHERE cost_micro IS NOT NULL GROUP BY 1, 2", "usage_events")
def spend_per_hour(spark, sf_dir):
    return windows.spend_per_hour(_usage(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def outcome_rate(spark, sf_dir):
    return windows.outcome_rate(view(spark, sf_dir, "events").withColumnRenamed("event_type", "status"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, created_at) AS window_start, provider, model, count(*) AS n FROM usage_events WHERE event_id % 4 = 0 GROUP BY 1, 2, 3", "usage_events")
def provider_error_rate(spark, sf_dir):
    """Provider errors by provider and model: calls of which every fourth failed."""
    return windows.outcome_rate(_usage(spark, sf_dir).where("event_id % 4 = 0"), ("provider", "model"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def chat_sessions(spark, sf_dir):
    return windows.chat_sessions(view(spark, sf_dir, "events"))


_CHANGES = "SELECT event_id, ts, CAST(user_id % 3 AS INT) AS key, CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE -1 END AS delta FROM {t}"


@query(f"SELECT key, event_id, sum(delta) OVER (PARTITION BY key ORDER BY ts, event_id)::BIGINT AS depth FROM ({_CHANGES.format(t='events')})")
def backlog_depth(spark, sf_dir):
    return windows.backlog_depth(spark.sql(_CHANGES, t=view(spark, sf_dir, "events")))


@query("""WITH r AS (SELECT org_id, event_id, created_at, sum(tokens_in + tokens_out) OVER (PARTITION BY org_id ORDER BY created_at, event_id) AS used FROM usage_events WHERE key_source = 'system')
SELECT org_id, arg_min(event_id, (created_at, event_id)) AS event_id, min(used)::BIGINT AS used FROM r WHERE used >= 100000 GROUP BY 1""", "usage_events")
def running_allowance(spark, sf_dir):
    return windows.running_allowance(_usage(spark, sf_dir), 100_000)


@query("""WITH RECURSIVE h AS (SELECT user_id AS key, event_id, epoch_us(ts) AS tt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT key, event_id, tt, i, tt AS start, 1 AS n FROM h WHERE i = 1
  UNION ALL SELECT h.key, h.event_id, h.tt, h.i, CASE WHEN h.tt >= f.start + 86400000000 THEN h.tt ELSE f.start END, CASE WHEN h.tt >= f.start + 86400000000 THEN 1 ELSE f.n + 1 END FROM f JOIN h ON h.key = f.key AND h.i = f.i + 1)
SELECT key, event_id, n::INT AS n, n > 2 AS rejected, CASE WHEN n > 2 THEN greatest(1, ceil((start + 86400000000 - tt) / 1000000.0::DOUBLE))::BIGINT END AS retry_after FROM f""")
def rate_limit_flags(spark, sf_dir):
    return windows.rate_limit_flags(view(spark, sf_dir, "events").withColumnRenamed("user_id", "key"), 2, 86_400)


@query("""WITH RECURSIVE h AS (SELECT account AS key, event_id, epoch_us(ts) AS tt, success, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS i FROM (
  SELECT event_id, ts, CAST(user_id % 20 AS BIGINT) AS account, event_type = 'signup' AS success FROM events WHERE event_type IN ('signup', 'error', 'purchase'))),
f AS (SELECT key, 0::BIGINT AS event_id, 0 AS i, 0::BIGINT AS start, 0 AS n, 0::BIGINT AS until, 0 AS failures, false AS locked FROM (SELECT DISTINCT key FROM h)
  UNION ALL SELECT key, event_id, i, nstart, CASE WHEN NOT locked AND failures >= 3 THEN 0 ELSE failures END, CASE WHEN NOT locked AND failures >= 3 THEN tt + 86400000000 ELSE until END, failures, locked FROM (
    SELECT h.key, h.event_id, h.tt, h.i, f.until, h.tt < f.until AS locked,
      CASE WHEN h.tt < f.until THEN f.n WHEN h.success THEN 0 WHEN h.tt >= f.start + 86400000000 OR f.n = 0 THEN 1 ELSE f.n + 1 END AS failures,
      CASE WHEN h.tt >= f.until AND NOT h.success AND (h.tt >= f.start + 86400000000 OR f.n = 0) THEN h.tt ELSE f.start END AS nstart
    FROM f JOIN h ON h.key = f.key AND h.i = f.i + 1))
SELECT key, event_id, failures::INT AS failures, locked FROM f WHERE i > 0""")
def lockout_flags(spark, sf_dir):
    return windows.lockout_flags(view(spark, sf_dir, "logins"), "account", 3, 1440)


# accounts and addresses go across tenants: every address is shared by accounts of several
_LOGINS = "SELECT event_id, ts, user_id AS account, concat('10.', user_id % 12, '.', event_id % 5) AS address, event_type = 'signup' AS success FROM {t} WHERE event_type IN ('signup', 'error', 'purchase')"
_SQL_BOTH = f"""WITH RECURSIVE h AS (SELECT event_id, epoch_us(ts) AS tt, account, address, success, row_number() OVER (ORDER BY ts, event_id) AS i FROM ({_LOGINS.format(t='events')})),
f AS (SELECT 0::BIGINT AS event_id, 0::BIGINT AS account, '' AS address, 0::BIGINT AS i, MAP {{}}::MAP(VARCHAR, STRUCT(s BIGINT, n INT, u BIGINT)) AS held, 0 AS account_failures, 0 AS address_failures, false AS locked
  UNION ALL SELECT event_id, account, address, i, map_concat(held, MAP {{ak: CASE WHEN locked THEN a WHEN success THEN {{'s': a.s, 'n': 0, 'u': a.u}} WHEN af >= 3 THEN {{'s': aw, 'n': 0, 'u': tt + 86400000000}} ELSE {{'s': aw, 'n': af, 'u': a.u}} END,
      dk: CASE WHEN locked THEN d WHEN success THEN {{'s': d.s, 'n': 0, 'u': d.u}} WHEN df >= 3 THEN {{'s': dw, 'n': 0, 'u': tt + 86400000000}} ELSE {{'s': dw, 'n': df, 'u': d.u}} END}}),
    CASE WHEN locked THEN CASE WHEN tt < a.s + 86400000000 THEN a.n ELSE 0 END WHEN success THEN 0 ELSE af END, CASE WHEN locked THEN CASE WHEN tt < d.s + 86400000000 THEN d.n ELSE 0 END WHEN success THEN 0 ELSE df END, locked FROM (
    SELECT *, tt < a.u OR tt < d.u AS locked, CASE WHEN a.n = 0 OR tt >= a.s + 86400000000 THEN tt ELSE a.s END AS aw, CASE WHEN a.n = 0 OR tt >= a.s + 86400000000 THEN 1 ELSE a.n + 1 END AS af,
      CASE WHEN d.n = 0 OR tt >= d.s + 86400000000 THEN tt ELSE d.s END AS dw, CASE WHEN d.n = 0 OR tt >= d.s + 86400000000 THEN 1 ELSE d.n + 1 END AS df FROM (
      SELECT h.*, f.held, 'a' || h.account AS ak, 'd' || h.address AS dk, coalesce(f.held['a' || h.account], {{'s': 0::BIGINT, 'n': 0, 'u': 0::BIGINT}}) AS a, coalesce(f.held['d' || h.address], {{'s': 0::BIGINT, 'n': 0, 'u': 0::BIGINT}}) AS d FROM f JOIN h ON h.i = f.i + 1)))
SELECT event_id, account, address, account_failures, address_failures, locked FROM f WHERE i > 0"""


@query(_SQL_BOTH)
def lockout_both(spark, sf_dir):
    """Lockouts of accounts and addresses that act on each other, whatever tenant they belong to."""
    return lockouts.lockout_both(spark.sql(_LOGINS, t=view(spark, sf_dir, "events")), 3, 1440)


@query(f"""SELECT event_id, s.subject, bucket, coalesce(a.variant_id, s.variant_id) AS variant_id FROM (SELECT event_id, subject, bucket, variant_id FROM (SELECT *, {_BUCKET} AS bucket FROM (SELECT event_id, concat('user:', user_id) AS subject, 1 AS experiment_id FROM events))
  JOIN ({_RANGES}) USING (experiment_id) WHERE bucket >= low AND bucket < high) s LEFT JOIN (SELECT subject, min(variant_id) AS variant_id FROM assignments WHERE experiment_id = 1 AND variant_id IN (SELECT id FROM variants WHERE experiment_id = 1) GROUP BY 1) a USING (subject)""", "variants", "assignments")
def stream_assign(spark, sf_dir):
    turns = view(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"))
    return windows.stream_assign(turns, view(spark, sf_dir, "variants"), 1, view(spark, sf_dir, "assignments"))
