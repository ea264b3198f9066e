"""Queries over usage, experiments, the source tree and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.adapters import AS_OF, view, with_views
from passages.operators import experiments, reports, tree, usage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with its SQL over the views named."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return register


def _distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


@query(f"""
SELECT count(*) AS calls, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out,
  coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro, count(*) FILTER (WHERE cost_micro IS NULL) AS calls_without_price
FROM usage_events WHERE org_id = 1 AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""", "usage_events")
def usage_summary(spark, sf_dir):
    return usage.usage_summary(view(spark, sf_dir, "usage_events").where("org_id = 1"), AS_OF, 30)


@query(f"""
SELECT coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost_micro)::BIGINT AS cost_micro
FROM usage_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1, 2 ORDER BY cost_micro DESC NULLS LAST, 1, 2 LIMIT 10""", "usage_events")
def usage_by_model(spark, sf_dir):
    return usage.usage_by_model(view(spark, sf_dir, "usage_events"), AS_OF, 400)


@query("""
WITH u AS (SELECT org_id, sum(tokens_in + tokens_out)::BIGINT AS used FROM usage_events WHERE key_source = 'system' GROUP BY 1), o AS (SELECT DISTINCT org_id FROM usage_events)
SELECT org_id, coalesce(used, 0) AS used, greatest(600000 - coalesce(used, 0), 0)::BIGINT AS remaining, coalesce(used, 0) >= 600000 AS exhausted FROM o LEFT JOIN u USING (org_id)""", "usage_events")
def allowance(spark, sf_dir):
    rows = view(spark, sf_dir, "usage_events")
    return usage.allowance(rows, _distinct(rows, "org_id"), 600_000, AS_OF)


@query("""
SELECT org_id, strftime(created_at, '%Y-%m-%d') AS day, coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro, count(*) AS calls FROM usage_events GROUP BY 1, 2 HAVING coalesce(sum(cost_micro), 0) > 50000""", "usage_events")
def tenant_spend(spark, sf_dir):
    return usage.tenant_spend(view(spark, sf_dir, "usage_events"), 50_000)


@query("""
SELECT event_id, round_even((price_in::DECIMAL(18,0) * tokens_in + price_out::DECIMAL(18,0) * tokens_out)::DECIMAL(30,6)::DOUBLE / 1000000, 6) AS cost, price_in IS NULL AS cost_unknown
FROM usage_events LEFT JOIN catalog USING (provider, model)""", "usage_events", "catalog")
def price_calls(spark, sf_dir):
    priced = usage.price_calls(view(spark, sf_dir, "usage_events"), view(spark, sf_dir, "catalog"))
    return priced.select("event_id", F.col("cost").cast("double").alias("cost"), "cost_unknown")


@query("""
SELECT provider, model, any_value(kind) AS kind, any_value(CASE WHEN kind = 'chat' THEN NULL WHEN provider NOT IN ('north', 'south') THEN 'no embedding adapter for ' || provider
  WHEN NOT supports_dimensions AND native_dimensions <> 64 THEN 'fixed width of ' || native_dimensions || ', the index stores 64' END) AS unusable_reason,
  bool_and(kind = 'chat' OR provider IN ('north', 'south') AND (supports_dimensions OR native_dimensions = 64)) AS usable, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in FROM usage_events JOIN catalog USING (provider, model)
WHERE retires_on IS NULL OR retires_on > '2024-01-10' GROUP BY 1, 2""", "usage_events", "catalog")
def select_models(spark, sf_dir):
    columns = ("provider", "model", "kind", "unusable_reason", "usable")
    offered = usage.select_models(view(spark, sf_dir, "catalog"), "2024-01-10", 64, ("north", "south")).select(*columns)
    return view(spark, sf_dir, "usage_events").join(offered, ["provider", "model"]).groupBy(*columns).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"))


_CALLS = """SELECT provider, model, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 429 WHEN 3 THEN NULL WHEN 4 THEN 503 ELSE 404 END AS status,
  CASE WHEN event_id % 6 = 1 THEN 'You exceeded your current Quota' ELSE 'slow down' END AS message FROM {t} WHERE provider IS NOT NULL"""


@query(f"""
SELECT provider, model, CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 AND regexp_matches(lower(message), 'quota|credit|billing|insufficient|payment') THEN 'quota'
  WHEN status = 429 THEN 'rate_limited' WHEN status IS NULL OR status >= 500 THEN 'unavailable' ELSE 'error' END AS code, count(*) AS n FROM ({_CALLS.format(t="usage_events")}) GROUP BY 1, 2, 3""", "usage_events")
def classify_provider_errors(spark, sf_dir):
    return usage.classify_provider_errors(spark.sql(_CALLS, t=view(spark, sf_dir, "usage_events")))


@query("""
WITH o AS (SELECT DISTINCT org_id, provider FROM usage_events WHERE provider IS NOT NULL), own AS (SELECT DISTINCT org_id, provider FROM usage_events WHERE key_source = 'org' AND org_id % 2 = 0)
SELECT o.org_id, o.provider, CASE WHEN own.org_id IS NOT NULL THEN 'org' WHEN o.provider <> 'west' THEN 'system' ELSE 'org' END AS key_source, own.org_id IS NOT NULL OR o.provider <> 'west' AS usable
FROM o LEFT JOIN own USING (org_id, provider)""", "usage_events")
def resolve_key_source(spark, sf_dir):
    rows = view(spark, sf_dir, "usage_events").where("provider IS NOT NULL")
    return usage.resolve_key_source(_distinct(rows, "org_id", "provider"), rows.where("key_source = 'org' AND org_id % 2 = 0"), _distinct(rows.where("provider <> 'west'"), "provider"))


@query("""SELECT id AS source_id, org_id, n_chars AS tokens_in, n_chars * 2 AS cost_micro, CASE WHEN org_id % 3 = 0 THEN 'org' WHEN org_id % 3 = 1 THEN 'system' ELSE 'org' END AS key_source FROM sources""", "sources")
def embedding_usage(spark, sf_dir):
    sources = view(spark, sf_dir, "sources")
    chunks = sources.select(F.col("id").alias("source_id"), "org_id", F.inline(F.array(*[F.struct(part.alias("tokens")) for part in (F.col("n_chars") - F.col("n_chars") % 7, F.col("n_chars") % 7)])))
    orgs = sources.select("org_id", F.when(F.col("org_id") % 3 == 2, "west").otherwise("north").alias("provider")).distinct()
    keys = usage.resolve_key_source(orgs, orgs.where("org_id % 3 = 0"), _distinct(orgs.where("provider = 'north'"), "provider"))
    return usage.embedding_usage(chunks, 2, keys)


# experiments

_SUBJECTS = "SELECT DISTINCT CAST(1 + user_id % 2 AS INT) AS experiment_id, concat('user:', user_id) AS subject FROM {t}"
_BUCKET = "(('0x' || substr(sha256(experiment_id || ':' || subject), 1, 8))::BIGINT % 100)::INT"
_RANGES = """SELECT experiment_id, id AS variant_id, sum(traffic_percent) OVER w - traffic_percent AS low,
  CASE WHEN lead(id) OVER w IS NULL THEN greatest(sum(traffic_percent) OVER w, 100) ELSE sum(traffic_percent) OVER w END AS high FROM variants WINDOW w AS (PARTITION BY experiment_id ORDER BY id)"""


@query(f"SELECT experiment_id, subject, {_BUCKET} AS bucket FROM ({_SUBJECTS.format(t='events')})")
def bucket_subjects(spark, sf_dir):
    rows = spark.sql(_SUBJECTS, t=view(spark, sf_dir, "events"))
    return rows.withColumn("bucket", experiments.bucket(F.col("experiment_id"), F.col("subject")))


_ARMS = """SELECT (s_suppkey - s_suppkey % 3) / 3 AS experiment_id, CASE s_suppkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE CASE WHEN s_suppkey % 5 = 0 THEN 10 ELSE 20 END END AS traffic_percent,
  s_suppkey % 3 = 0 OR s_suppkey % 11 = 0 AS is_control FROM {t}"""


@query(f"""
SELECT experiment_id, total, arms, controls, CASE WHEN total <> 100 THEN 'traffic' WHEN arms < 2 THEN 'arms' WHEN controls <> 1 THEN 'control' END AS violation FROM (
  SELECT experiment_id, sum(traffic_percent)::BIGINT AS total, count(*) AS arms, count(*) FILTER (WHERE is_control) AS controls FROM ({_ARMS.format(t='supplier')}) GROUP BY 1)
WHERE total <> 100 OR arms < 2 OR controls <> 1""")
def validate_splits(spark, sf_dir):
    return experiments.validate_splits(spark.sql(_ARMS, t=view(spark, sf_dir, "supplier")))


@query(f"""
SELECT experiment_id, subject, bucket, variant_id FROM (SELECT *, {_BUCKET} AS bucket FROM ({_SUBJECTS.format(t='events')})) JOIN ({_RANGES}) USING (experiment_id) WHERE bucket >= low AND bucket < high""", "variants")
def assign_by_bucket(spark, sf_dir):
    return experiments.assign_by_bucket(spark.sql(_SUBJECTS, t=view(spark, sf_dir, "events")), view(spark, sf_dir, "variants"))


@query(f"""
SELECT s.experiment_id, s.subject, coalesce(a.variant_id, s.variant_id) AS variant_id, a.variant_id IS NULL AS is_new FROM (
  SELECT experiment_id, subject, variant_id FROM (SELECT *, {_BUCKET} AS bucket FROM ({_SUBJECTS.format(t='events')})) JOIN ({_RANGES}) USING (experiment_id) WHERE bucket >= low AND bucket < high) s
LEFT JOIN (SELECT a.* FROM assignments a JOIN variants v ON v.experiment_id = a.experiment_id AND v.id = a.variant_id) a USING (experiment_id, subject)""", "variants", "assignments")
def sticky_assign(spark, sf_dir):
    return experiments.sticky_assign(spark.sql(_SUBJECTS, t=view(spark, sf_dir, "events")), view(spark, sf_dir, "assignments"), view(spark, sf_dir, "variants"))


_EXPERIMENTS = "SELECT * FROM (VALUES (1, 0, 'running', 5), (2, 1, 'running', 3), (3, 1, 'running', 1), (4, 2, 'stopped', 9)) AS e(id, bot_id, status, started_at)"
_TURNS = """SELECT event_id, CAST(user_id % 3 AS INT) AS bot_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 50 END AS conversation_id FROM {t}"""


@query(f"""
WITH t AS (SELECT event_id, experiment_id, CASE WHEN user_id IS NOT NULL THEN concat('user:', user_id) WHEN conversation_id IS NOT NULL THEN concat('conv:', conversation_id) ELSE 'conv:new' END AS subject
  FROM ({_TURNS.format(t='events')}) JOIN (SELECT bot_id, arg_max(id, (started_at, id)) AS experiment_id FROM ({_EXPERIMENTS}) WHERE status = 'running' GROUP BY 1) USING (bot_id)),
s AS (SELECT experiment_id, subject, variant_id FROM (SELECT *, {_BUCKET} AS bucket FROM (SELECT DISTINCT experiment_id, subject FROM t)) JOIN ({_RANGES}) USING (experiment_id) WHERE bucket >= low AND bucket < high)
SELECT event_id, experiment_id, subject, coalesce(a.variant_id, s.variant_id) AS variant_id FROM t JOIN s USING (experiment_id, subject)
LEFT JOIN (SELECT a.* FROM assignments a JOIN variants v ON v.experiment_id = a.experiment_id AND v.id = a.variant_id) a USING (experiment_id, subject)""", "variants", "assignments")
def assign_variants(spark, sf_dir):
    turns = spark.sql(_TURNS, t=view(spark, sf_dir, "events"))
    found = experiments.assign_variants(turns, spark.sql(_EXPERIMENTS), view(spark, sf_dir, "variants"), view(spark, sf_dir, "assignments"))
    return found.select("event_id", "experiment_id", "subject", "variant_id")


@query("""
WITH u AS (SELECT CAST(1 + event_id % 3 AS INT) AS experiment_id, CAST(max(event_id % 3) + 10 AS INT) AS current_version_id FROM usage_events GROUP BY 1),
p AS (SELECT v.experiment_id, id, name, is_control, CASE WHEN is_control THEN coalesce(version_id, current_version_id) ELSE version_id END AS version_id FROM variants v LEFT JOIN u USING (experiment_id))
SELECT p.experiment_id, p.id, p.name, p.version_id, NOT p.is_control AND p.version_id IS NOT DISTINCT FROM c.version_id AS same_as_control FROM p LEFT JOIN (SELECT * FROM p WHERE is_control) c USING (experiment_id)""", "variants", "usage_events")
def pin_and_check_arms(spark, sf_dir):
    current = view(spark, sf_dir, "usage_events").groupBy((1 + F.col("event_id") % 3).cast("int").alias("experiment_id")).agg((F.max(F.col("event_id") % 3) + 10).cast("int").alias("current_version_id"))
    return experiments.pin_and_check_arms(view(spark, sf_dir, "variants"), current)


@query("""
SELECT CAST(v.id AS BIGINT) AS variant_id, name, traffic_percent, is_control, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, coalesce(cost_micro, 0) AS cost_micro, coalesce(subjects, 0) AS subjects FROM variants v
LEFT JOIN (SELECT variant_id, count(*) AS calls, sum(tokens_in + tokens_out)::BIGINT AS tokens, sum(cost_micro)::BIGINT AS cost_micro FROM usage_events WHERE variant_id IS NOT NULL AND org_id = 3 GROUP BY 1) u ON u.variant_id = v.id
LEFT JOIN (SELECT variant_id, count(DISTINCT subject) AS subjects FROM assignments WHERE experiment_id = 1 GROUP BY 1) a ON a.variant_id = v.id WHERE v.experiment_id = 1""", "usage_events", "variants", "assignments")
def variant_stats(spark, sf_dir):
    return experiments.variant_stats(view(spark, sf_dir, "usage_events"), view(spark, sf_dir, "variants"), view(spark, sf_dir, "assignments"), experiment_id=1, org_id=3)


# the source tree


@query("SELECT path, name, type FROM nodes WHERE type <> 'directory' AND (starts_with(path, 'r1.') OR starts_with(path, 'r2.n8.') OR path IN ('r1', 'r2.n8'))", "nodes")
def expand_subtree(spark, sf_dir):
    nodes = view(spark, sf_dir, "nodes")
    return tree.expand_subtree(nodes, nodes.where("path IN ('r1', 'r2.n8')"))


@query("SELECT path, name, type, len(string_split(path, '.'))::INT AS level, regexp_replace(path, '\\.[^.]*$', '') AS parent_path FROM nodes WHERE starts_with(path, 'r3.') ORDER BY 4, 2, 1", "nodes")
def tree_listing(spark, sf_dir):
    return tree.tree_listing(view(spark, sf_dir, "nodes"), "r3")


_ORDERS = "SELECT o_orderkey, concat('r', n_regionkey, '.n', n_nationkey, '.c', c_custkey) AS source_path FROM {o} JOIN {c} ON o_custkey = c_custkey JOIN {n} ON c_nationkey = n_nationkey"


@query(f"""
SELECT count(*) AS nodes, (SELECT count(*) FROM ({_ORDERS.format(o='orders', c='customer', n='nation')}) WHERE source_path IN (SELECT path FROM nodes WHERE path = 'r0' OR starts_with(path, 'r0.'))) AS children
FROM nodes WHERE path = 'r0' OR starts_with(path, 'r0.')""", "nodes")
def delete_subtree(spark, sf_dir):
    children = spark.sql(_ORDERS, o=view(spark, sf_dir, "orders"), c=view(spark, sf_dir, "customer"), n=view(spark, sf_dir, "nation"))
    return tree.delete_subtree(view(spark, sf_dir, "nodes"), children, "r0")[2]


@query("SELECT id, org_id, path FROM sources WHERE org_id = 3 AND lang = 'en'", "sources")
def tenant_scope(spark, sf_dir):
    sources = view(spark, sf_dir, "sources")
    return tree.tenant_scope(sources.select("id", "org_id", "path"), 3, sources.where("lang = 'en'"))


_MEMBERS = "SELECT DISTINCT user_id, CAST(user_id % 8 AS BIGINT) AS org_id, CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' WHEN 2 THEN 'admin' WHEN 3 THEN 'owner' ELSE 'guest' END AS role FROM {t}"


@query("SELECT event_id, org_id, 'admin' AS role FROM usage_events WHERE org_id IN (SELECT CAST(user_id % 8 AS BIGINT) FROM events WHERE user_id = 7 AND user_id % 5 = 2)", "usage_events")
def access_scope(spark, sf_dir):
    members = spark.sql(_MEMBERS, t=view(spark, sf_dir, "events"))
    return tree.access_scope(view(spark, sf_dir, "usage_events").select("event_id", "org_id"), members, 7, False, "editor")


# reports

_STAMPS = """SELECT label AS source_id, CASE WHEN label % 4 = 0 THEN NULL ELSE '2' END AS chunker_version, CASE WHEN label % 7 = 6 THEN 'large' ELSE '400000' END AS chunk_size,
  CAST(40 - CASE WHEN label % 6 = 5 THEN 1 ELSE 0 END AS VARCHAR(9)) AS chunk_overlap, CASE WHEN label % 5 = 3 THEN NULL WHEN label % 5 = 4 THEN 'fixed' ELSE 'semantic' END AS chunk_strategy FROM {t} GROUP BY label"""


@query(f"""
WITH s AS ({_STAMPS.format(t='embeddings')}), f AS (SELECT source_id, bool_or(chunk_id % 5 <> 0 OR source_id % 5 = 0) AS indexed,
  coalesce(bool_or(model <> 'm0') FILTER (WHERE chunk_id % 5 <> 0 OR source_id % 5 = 0), false) AS other_model FROM vectors GROUP BY 1)
SELECT source_id, indexed, indexed AND (other_model OR NOT coalesce(chunker_version = '2' AND chunk_size = '400000' AND chunk_overlap = '40' AND chunk_strategy = 'semantic', false)) AS stale FROM f LEFT JOIN s USING (source_id)""", "vectors")
def index_state(spark, sf_dir):
    rows = view(spark, sf_dir, "vectors")
    stored = rows.where("chunk_id % 5 <> 0 OR source_id % 5 = 0").select("chunk_id", "model")
    return reports.index_state(rows.select("chunk_id", "source_id"), stored, spark.sql(_STAMPS, t=view(spark, sf_dir, "embeddings")), {"model": "m0", "chunker_version": 2, "chunk_size": 400_000, "chunk_overlap": 40, "chunk_strategy": "semantic"})


@query("SELECT id, 'pending' AS status FROM sources WHERE type <> 'directory' AND n_chars > 3000", "sources")
def select_reindex(spark, sf_dir):
    sources = view(spark, sf_dir, "sources")
    state = sources.select(F.col("id").alias("source_id"), (F.col("n_chars") > 3000).alias("stale"))
    return reports.select_reindex(sources, state, True).select("id", "status")


_REPORT = """SELECT CASE WHEN n_chars < 100 THEN 'failed' ELSE 'ready' END AS status, lang, CAST(n_chars // 1600 + 1 AS BIGINT) AS chunks, CAST(n_chars // 4 AS BIGINT) AS tokens,
  CASE WHEN n_chars < 100 THEN concat('too short: ', text) END AS error FROM {t}"""


@query(f"SELECT status, lang, count(*) AS sources, sum(chunks)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens, arg_max(substr(error, 1, 1900), (length(error), error)) AS error FROM ({_REPORT.format(t='sources')}) GROUP BY 1, 2", "sources")
def ingest_report(spark, sf_dir):
    return reports.ingest_report(spark.sql(_REPORT.replace("//", "div"), t=view(spark, sf_dir, "sources")))


@query("SELECT vec_id AS chunk_id, 'vector' AS missing FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT vec_id, 'postings' FROM embeddings WHERE label = 3")
def audit_index(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return reports.audit_index(rows, rows.where("chunk_id % 9 <> 0"), rows.where("label <> 3"))


@query("""
WITH e AS (SELECT c_custkey AS entity_id, c_nationkey AS pipeline_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey END AS pinned FROM customer), v AS (SELECT s_nationkey AS pipeline_id, max(s_suppkey) AS cur FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT entity_id, coalesce(pinned, cur, -1)::BIGINT AS version_id FROM e LEFT JOIN v USING (pipeline_id)""")
def resolve_current_version(spark, sf_dir):
    entities = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("pipeline_id"), F.expr("CASE WHEN c_custkey % 10 = 0 THEN c_custkey END").alias("pinned_version"))
    versions = view(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pipeline_id"), F.col("s_suppkey").alias("version_id"), (F.col("s_suppkey") % 2 == 0).alias("is_current"))
    return reports.resolve_current_version(entities, versions, -1)


@query("""SELECT event_type AS type, count(*) AS n, round(avg(value), 4) AS mean_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms FROM events GROUP BY 1""")
def node_timing_report(spark, sf_dir):
    runs = view(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("node_id"), F.col("event_type").alias("type"), F.col("value").alias("duration_ms"))).alias("node_timings"))
    return reports.node_timing_report(runs)


@query("""SELECT conversation_id, turn_no, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro, count(*) FILTER (WHERE role = 'system') AS tool_calls,
  coalesce(string_agg(split_part(content, ' ', 1), ',' ORDER BY turn, content) FILTER (WHERE role = 'system'), '') AS calls, arg_max(content, turn) FILTER (WHERE role = 'assistant') AS answer
FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM messages) GROUP BY 1, 2""", "messages")
def agent_turn_rollup(spark, sf_dir):
    return reports.agent_turn_rollup(view(spark, sf_dir, "messages"))


@query("""SELECT n_nationkey AS pipeline_id, coalesce(v, 0) AS versions, coalesce(b, 0) AS bots, coalesce(b, 0) = 0 AS deletable FROM nation
LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS v FROM supplier GROUP BY 1) USING (n_nationkey) LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS b FROM customer WHERE c_acctbal > 9900 GROUP BY 1) USING (n_nationkey)""")
def pipeline_usage(spark, sf_dir):
    key = lambda t, c: view(spark, sf_dir, t).withColumnRenamed(c, "pipeline_id")
    return reports.pipeline_usage(key("nation", "n_nationkey").select("pipeline_id"), key("supplier", "s_nationkey"), key("customer", "c_nationkey").where("c_acctbal > 9900"))


@query("""SELECT conversation_id, substr(arg_min(content, turn) FILTER (WHERE role = 'user'), 1, 64) AS title, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, count(*) FILTER (WHERE role = 'system') AS system_messages, max(created_s) AS last_activity_s, sum(tokens_in + tokens_out)::BIGINT AS tokens,
  coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro, max(latency_ms) AS latency_ms FROM messages GROUP BY 1""", "messages")
def conversation_rollup(spark, sf_dir):
    return reports.conversation_rollup(view(spark, sf_dir, "messages"))


BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
_SQL_BUCKET = "CASE " + " ".join(f"WHEN seconds <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"


def sql_quantile(by: str, source: str, q: float) -> str:
    edges = [0.0, *BOUNDS, BOUNDS[-1]]
    return f"""
SELECT {by}, total::BIGINT AS n, round(CASE WHEN bucket = {len(BOUNDS)} THEN {BOUNDS[-1]} ELSE lo + (hi - lo) * (total * {q}::DOUBLE - (upto - n)) / n END, 6) AS quantile FROM (
  SELECT *, (CAST({edges} AS DOUBLE[]))[bucket + 1] AS lo, (CAST({edges} AS DOUBLE[]))[bucket + 2] AS hi, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (
    SELECT {by}, {_SQL_BUCKET} AS bucket, count(*) AS n FROM {source} GROUP BY ALL)) WHERE upto >= total * {q}::DOUBLE AND upto - n < total * {q}::DOUBLE"""


@query(sql_quantile("route", "requests", 0.95), "requests")
def histogram_quantile(spark, sf_dir):
    return reports.histogram_quantile(view(spark, sf_dir, "requests"), "seconds", ["route"], BOUNDS, 0.95)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def runs_by_status(spark, sf_dir):
    return reports.runs_by_status(view(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("SELECT route AS stage, status, count(*) AS hits FROM requests GROUP BY 1, 2", "requests")
def stage_hits(spark, sf_dir):
    return reports.stage_hits(view(spark, sf_dir, "requests").withColumnRenamed("route", "stage"), ["stage", "status"])


_AUDIT = """SELECT event_type AS action, user_id AS actor_user_id, CAST(user_id % 4 AS BIGINT) AS org_id, concat('10.0.', CAST(user_id % 30 AS INT), '.1') AS ip,
  CASE WHEN event_type = 'error' THEN concat('{{"reason": "r', CAST(event_id % 3 AS INT), '"}}') ELSE '{{}}' END AS payload FROM {t}"""


@query("SELECT event_type AS action, user_id AS actor_user_id, CAST(user_id % 4 AS BIGINT) AS org_id, CASE WHEN event_type = 'error' THEN concat('r', CAST(event_id % 3 AS INT)) END AS reason, count(*) AS n, count(DISTINCT user_id % 30) AS addresses FROM events GROUP BY ALL")
def audit_report(spark, sf_dir):
    return reports.audit_report(spark.sql(_AUDIT, t=view(spark, sf_dir, "events")), ["action", "org_id", "actor_user_id"])


_REQUESTS = "SELECT event_id AS request_id, ts AS requested_at, ts + INTERVAL 12 HOUR AS decided_at, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'rejected' ELSE 'approved' END AS decision FROM {t} WHERE event_type = 'signup'"
_INVITES = """SELECT event_id AS request_id, ts AS invited_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS accepted_at, ts + INTERVAL 7 DAY AS expires_at FROM {t} WHERE event_type = 'signup' AND event_id % 5 > 1 AND event_id % 4 <> 0"""


@query(f"""WITH moment AS (SELECT TIMESTAMP '2024-01-20' AS t), r AS (SELECT *, decided_at <= t AS decided FROM ({_REQUESTS.format(t='events')}), moment WHERE requested_at <= t),
i AS (SELECT *, accepted_at IS NOT NULL AND accepted_at <= t AS accepted, expires_at <= t AS ended FROM ({_INVITES.format(t='events')}), moment WHERE invited_at <= t)
SELECT (SELECT count(*) FROM r) AS requested, (SELECT count(*) FROM r WHERE decided AND decision = 'approved') AS approved, (SELECT count(*) FROM r WHERE decided AND decision = 'rejected') AS rejected, count(*) AS invited,
  count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted AND NOT ended) AS pending, count(*) FILTER (WHERE NOT accepted AND ended) AS expired FROM i WHERE request_id IN (SELECT request_id FROM r)""")
def access_funnel(spark, sf_dir):
    events = view(spark, sf_dir, "events")
    return reports.access_funnel(spark.sql(_REQUESTS, t=events), spark.sql(_INVITES, t=events), "2024-01-20 00:00:00")


_SESSIONS = """SELECT event_id AS session_id, user_id, ts AS created_at, ts + INTERVAL 3 DAY AS expires_at, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 DAY END AS revoked_at, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS rotated_from FROM {t}"""


@query(f"""WITH s AS ({_SESSIONS.format(t='events')})
SELECT user_id, count(*) AS sessions, max(expires_at) AS last_expiry FROM s WHERE created_at <= TIMESTAMP '2024-01-15' AND expires_at > TIMESTAMP '2024-01-15' AND (revoked_at IS NULL OR revoked_at > TIMESTAMP '2024-01-15')
  AND session_id NOT IN (SELECT rotated_from FROM s WHERE rotated_from IS NOT NULL AND created_at <= TIMESTAMP '2024-01-15') GROUP BY 1""")
def active_sessions(spark, sf_dir):
    return reports.active_sessions(spark.sql(_SESSIONS, t=view(spark, sf_dir, "events")), "2024-01-15 00:00:00")
