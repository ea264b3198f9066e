"""Domain views over the driver's tables, written once in SQL that Spark and DuckDB both read.

A view may use tables and earlier views. Queries get them as DataFrames from `View`; their SQL gets them as common table expressions
from `with_views`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The moment that reports look back from: the test events end a little before it.
AS_OF = "2024-02-01 00:00:00"

VIEWS: dict[str, str] = {
    "usage_events": """
        SELECT event_id, CAST(user_id % 8 AS BIGINT) AS org_id, user_id, CAST(user_id % 3 AS BIGINT) AS bot_id, ts AS created_at,
          CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'north' WHEN event_id % 3 = 1 THEN 'south' ELSE 'west' END AS provider,
          CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS model,
          CAST(floor(value * 10) AS BIGINT) AS tokens_in, CAST(event_id % 97 AS BIGINT) AS tokens_out,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 10) * 3 + (event_id % 97) * 7 AS BIGINT) END AS cost_micro,
          CASE WHEN event_id % 5 = 0 THEN 'org' ELSE 'system' END AS key_source,
          CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 + event_id % 3 AS BIGINT) END AS variant_id
        FROM events""",
    "requests": """
        SELECT event_id, ts, user_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN concat('/', event_type) ELSE 'unmatched' END AS route,
          CASE WHEN event_type = 'error' THEN 500 + CAST(event_id % 4 AS INT) ELSE 200 END AS status, round(value * 0.05, 4) AS seconds
        FROM events""",
    "logins": """
        SELECT event_id, ts, CAST(user_id % 20 AS BIGINT) AS account, concat('10.0.0.', CAST(user_id % 7 AS INT)) AS address, event_type = 'signup' AS success
        FROM events WHERE event_type IN ('signup', 'error', 'purchase')""",
    "sources": """
        SELECT doc_id AS id, CAST(CASE WHEN source IS NULL THEN -1 ELSE CAST(substr(source, 4) AS INT) END AS BIGINT) AS org_id, 'file' AS type,
          concat('doc-', doc_id, '.', CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'txt' WHEN 1 THEN 'PDF' WHEN 2 THEN 'md' WHEN 3 THEN 'exe' ELSE 'html' END) AS name,
          concat(coalesce(source, 'none'), '.', coalesce(lang, 'xx'), '.', doc_id) AS path, lang, n_chars, text
        FROM documents""",
    "nodes": """
        SELECT concat('r', r_regionkey) AS path, r_name AS name, 'directory' AS type FROM region
        UNION ALL SELECT concat('r', n_regionkey, '.n', n_nationkey), n_name, 'directory' FROM nation
        UNION ALL SELECT concat('r', n_regionkey, '.n', n_nationkey, '.c', c_custkey), c_name, 'file' FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "messages": """
        SELECT conv_id AS conversation_id, turn, role, text AS content, length(text) AS tokens_in, CAST(turn * 7 % 50 AS INT) AS tokens_out,
          CASE WHEN turn % 6 = 5 THEN NULL ELSE CAST(length(text) * 2 + turn AS BIGINT) END AS cost_micro, CAST(100 + (conv_id * 37 + turn * 11) % 900 AS INT) AS latency_ms,
          CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS created_s
        FROM conversations""",
    "catalog": """
        SELECT * FROM (VALUES ('north', 'large', 3, 15, '2030-01-01', 'chat', CAST(NULL AS INT), false), ('north', 'small', 1, 5, NULL, 'embedding', 64, true), ('south', 'large', 2, 8, '2023-06-01', 'chat', NULL, false),
          ('south', 'small', 1, 3, NULL, 'embedding', 128, false), ('west', 'small', 2, 2, '2024-01-15', 'embedding', 32, false)) AS c(provider, model, price_in, price_out, retires_on, kind, native_dimensions, supports_dimensions)""",
    "variants": """
        SELECT * FROM (VALUES (1, 1, 'control', 50, true, 10), (2, 1, 'short', 30, false, 11), (3, 1, 'long', 20, false, CAST(NULL AS INT)),
          (4, 2, 'control', 60, true, 12), (5, 2, 'other', 30, false, 12), (6, 3, 'only', 100, true, CAST(NULL AS INT))) AS v(id, experiment_id, name, traffic_percent, is_control, version_id)""",
    "assignments": """
        SELECT CAST(1 AS INT) AS experiment_id, concat('user:', user_id) AS subject, CAST(min(user_id % 4) + 1 AS INT) AS variant_id
        FROM events WHERE user_id % 3 = 0 GROUP BY user_id""",
    "vectors": """
        SELECT vec_id AS chunk_id, label AS source_id, CASE WHEN vec_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, embedding FROM embeddings""",
    "samples": """
        SELECT c.conv_id * 100 + c.turn AS item_id, CAST(c.conv_id % 3 AS BIGINT) AS run_id, c.text AS question,
          CASE WHEN c.turn % 4 = 0 THEN '' WHEN c.turn % 4 = 1 THEN concat(c.text, ' [1]') WHEN c.turn % 4 = 2 THEN CASE WHEN c.conv_id % 3 = 0 THEN 'I do not know the answer.' WHEN c.conv_id % 3 = 1 THEN 'Я не знаю.' ELSE 'It is not found in the sources.' END ELSE c.text END AS answer,
          CASE WHEN c.turn % 5 = 0 THEN NULL ELSE 'reference' END AS expected_answer,
          CASE WHEN c.conv_id % 4 = 0 THEN '' ELSE concat('Doc-', CAST(c.conv_id % 6 AS INT), ',doc-', CAST(c.conv_id % 9 AS INT)) END AS expected_sources,
          CASE WHEN c.turn % 7 = 6 THEN '' ELSE concat('doc-', CAST(c.turn % 9 AS INT), ',DOC-', CAST(c.conv_id % 9 AS INT), ',doc-', CAST(c.turn % 9 AS INT)) END AS retrieved_sources,
          CASE WHEN c.turn % 7 = 6 THEN '' ELSE 'context' END AS context
        FROM conversations c""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    """The views by that name and those they use, in order."""
    wanted = set(names)
    for name in reversed(list(VIEWS)):
        if name in wanted:
            wanted |= {v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])}
    return [v for v in VIEWS if v in wanted]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver's by its own name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t for t in re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)}
    frames = {t: view(spark, sf_dir, t) for t in used}
    return spark.sql(re.sub(r"((?:FROM|JOIN)\s+)(\w+)", r"\1{\2}", sql), **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that starts with the views it names."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(names))
    body = sql.strip()
    return f"WITH {views}{',' if body.startswith('WITH ') else ''}\n{body.removeprefix('WITH ')}" if views else body
