"""Queries over evaluation samples, runs and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.adapters import view, with_views
from passages.operators import evals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views)
        return f

    return register


def _names(column: str) -> str:
    return f"list_filter(list_transform(string_split(lower({column}), ','), lambda x: trim(x)), lambda x: x <> '')"


_SQL_METRICS = {
    "retrieval_recall": f"CASE WHEN len({_names('expected_sources')}) = 0 THEN 1.0 ELSE len(list_filter({_names('expected_sources')}, lambda x: list_contains({_names('retrieved_sources')}, x)))::DOUBLE / len({_names('expected_sources')}) END",
    "context_precision": f"CASE WHEN len({_names('expected_sources')}) = 0 THEN 1.0 WHEN len({_names('retrieved_sources')}) = 0 THEN 0.0 ELSE len(list_filter({_names('retrieved_sources')}, lambda x: list_contains({_names('expected_sources')}, x)))::DOUBLE / len({_names('retrieved_sources')}) END",
    "citation_rate": r"CASE WHEN trim(context) = '' THEN 0.0 WHEN regexp_matches(answer, '\[[0-9]{1,2}\]') THEN 1.0 ELSE 0.0 END",
    "answered": "CASE WHEN trim(answer) = '' OR regexp_matches(lower(answer), 'i don''t know|i do not know|no information|не знаю|cannot answer') THEN 0.0 ELSE 1.0 END",
}
_SQL_SCORES = " UNION ALL ".join(f"SELECT run_id, item_id, '{m}' AS metric, ({sql})::DOUBLE AS score FROM samples" for m, sql in _SQL_METRICS.items())


def _metric(name: str):
    def run(spark, sf_dir):
        return evals.score_items(view(spark, sf_dir, "samples"), [name])

    run.__name__ = name
    query(f"SELECT run_id, item_id, '{name}' AS metric, ({_SQL_METRICS[name]})::DOUBLE AS score FROM samples", "samples")(run)


for _name in _SQL_METRICS:
    _metric(_name)


@query(f"SELECT run_id, item_id, metric, round(score, 6) AS score FROM ({_SQL_SCORES})", "samples")
def score_items(spark, sf_dir):
    return evals.score_items(view(spark, sf_dir, "samples"), [*evals.METRICS, "no_such_metric"]).withColumn("score", F.round("score", 6))


_ITEMS = "SELECT run_id, item_id, CASE WHEN run_id = 2 OR item_id % 17 = 0 THEN 'failed to run' END AS error FROM {t}"


@query(f"""
WITH i AS ({_ITEMS.format(t='samples')}), sc AS ({_SQL_SCORES}), n AS (SELECT run_id, count(*) AS n FROM i WHERE error IS NULL GROUP BY 1)
SELECT run_id, metric, mean, CASE WHEN n IS NULL THEN 'failed' ELSE 'done' END AS status FROM (SELECT DISTINCT run_id FROM i) LEFT JOIN n USING (run_id) LEFT JOIN (
  SELECT run_id, metric, round(sum(score) / any_value(n), 4) AS mean FROM sc JOIN i USING (run_id, item_id) JOIN n USING (run_id) WHERE error IS NULL GROUP BY 1, 2) USING (run_id)""", "samples")
def summarise_runs(spark, sf_dir):
    samples = view(spark, sf_dir, "samples")
    return evals.summarise_runs(evals.score_items(samples, list(evals.METRICS)), spark.sql(_ITEMS, t=samples))


def _summaries(spark, sf_dir):
    found = summarise_runs(spark, sf_dir)
    return found.where("run_id = 0"), found.where("run_id = 1 AND metric <> 'answered'")


_COMPARED = f"""WITH sc AS ({_SQL_SCORES}), m AS (SELECT run_id, metric, round(avg(score), 4) AS mean FROM sc WHERE item_id % 17 <> 0 GROUP BY 1, 2), c AS (
  SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.mean, 0) AS baseline, coalesce(b.mean, 0) AS candidate
  FROM (SELECT * FROM m WHERE run_id = 0) a FULL JOIN (SELECT * FROM m WHERE run_id = 1 AND metric <> 'answered') b USING (metric))
SELECT *, round(candidate - baseline, 4) AS delta FROM c"""


@query(_COMPARED, "samples")
def compare_runs(spark, sf_dir):
    return evals.compare_runs(*_summaries(spark, sf_dir), datasets=(1, 1))


@query(f"SELECT * FROM ({with_views(_COMPARED, 'samples')}) WHERE delta < -0.01")
def regressions(spark, sf_dir):
    return evals.regressions(compare_runs(spark, sf_dir), 0.01)


@query("SELECT run_id, coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro FROM (SELECT conversation_id % 3 AS run_id, cost_micro FROM messages UNION ALL SELECT org_id % 3, cost_micro FROM usage_events) GROUP BY 1", "messages", "usage_events")
def run_cost(spark, sf_dir):
    items = view(spark, sf_dir, "messages").select((F.col("conversation_id") % 3).alias("run_id"), "cost_micro")
    return evals.run_cost(items, view(spark, sf_dir, "usage_events").select((F.col("org_id") % 3).alias("run_id"), "cost_micro"))


_RUNS = "SELECT o_orderkey AS id, o_custkey % 20 AS org_id, o_custkey % 7 AS dataset_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS status, o_orderkey % 3 = 0 AS is_baseline, o_orderdate AS created_at FROM {t}"


@query(f"SELECT id, org_id, dataset_id FROM ({_RUNS.format(t='orders')}) WHERE status = 'done' AND is_baseline QUALIFY row_number() OVER (PARTITION BY org_id, dataset_id ORDER BY created_at DESC, id DESC) = 1")
def latest_baseline(spark, sf_dir):
    return evals.latest_baseline(spark.sql(_RUNS, t=view(spark, sf_dir, "orders"))).select("id", "org_id", "dataset_id")


_REPLIES = """SELECT doc_id AS item_id, 'faithfulness' AS metric, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat('{{"score": ', quality, '}}') WHEN 1 THEN concat('Sure! {{"score": 0.', doc_id % 10, ', "why": "x"}} Hope it helps.')
  WHEN 2 THEN '{{"score": 5}}' WHEN 3 THEN '{{"score": -3}}' WHEN 4 THEN 'I would say it is good.' ELSE '{{"grade": 1}}' END AS reply FROM {t}"""


@query("SELECT doc_id AS item_id, 'faithfulness' AS metric, (CASE doc_id % 6 WHEN 0 THEN quality WHEN 1 THEN (doc_id % 10) / 10.0 WHEN 2 THEN 1 ELSE 0 END)::DOUBLE AS score FROM labels")
def score_judge_replies(spark, sf_dir):
    return evals.score_judge_replies(spark.sql(_REPLIES, t=view(spark, sf_dir, "labels")))


@query(r"""
SELECT item_id, 'faithfulness' AS metric, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Is every claim supported? Reply {"score": 0..1}.' AS prompt FROM samples WHERE trim(context) <> ''
UNION ALL SELECT item_id, 'answer_relevancy', 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Does it address the question? Reply {"score": 0..1}.' FROM samples
UNION ALL SELECT item_id, 'correctness', 'Reference:' || chr(10) || expected_answer || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Do they agree? Reply {"score": 0..1}.' FROM samples WHERE expected_answer IS NOT NULL""", "samples")
def build_judge_prompts(spark, sf_dir):
    return evals.build_judge_prompts(view(spark, sf_dir, "samples"))


@query(f"""
WITH p AS (SELECT * FROM ({{prompts}})), e AS (SELECT item_id, unnest(['faithfulness', 'answer_relevancy', 'correctness']) AS metric FROM samples)
SELECT item_id, metric, CASE WHEN prompt IS NULL THEN 0 ELSE least(10, length(prompt) // 50) / 10.0 END::DOUBLE AS score FROM e LEFT JOIN p USING (item_id, metric)""".replace("{prompts}", ORACLE["build_judge_prompts"]), "samples")
def judge_scores(spark, sf_dir):
    def judge(batches):
        """A deterministic judge in place of a model: a longer prompt scores more, up to 1."""
        for pdf in batches:
            yield pdf.assign(reply=[f'{{"score": {min(10, len(p) // 50) / 10}}}' for p in pdf["prompt"]])[["item_id", "metric", "reply"]]

    return evals.judge_scores(view(spark, sf_dir, "samples"), judge)
