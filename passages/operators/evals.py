"""Evaluation: metrics as column expressions, judge prompts and replies, run summaries and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.functions.text import words
from passages.operators.sizes import few

# Phrases by which an answer refuses, in lower case.
REFUSALS = ("i don't know", "i do not know", "no information", "не знаю", "cannot answer")


def names(column: str) -> Column:
    """The comma-separated names of a column, lower-cased, without blanks."""
    return F.filter(F.transform(F.split(F.lower(F.col(column)), ","), lambda x: F.trim(x)), lambda x: x != "")


def retrieval_recall() -> Column:
    wanted = names("expected_sources")
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda x: F.array_contains(names("retrieved_sources"), x))) / F.size(wanted))


def context_precision() -> Column:
    wanted, found = names("expected_sources"), names("retrieved_sources")
    return F.when(F.size(wanted) == 0, 1.0).when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda x: F.array_contains(wanted, x))) / F.size(found))


def citation_rate() -> Column:
    return F.when(F.trim("context") == "", 0.0).when(F.col("answer").rlike(r"\[[0-9]{1,2}\]"), 1.0).otherwise(0.0)


def answered() -> Column:
    low = F.lower(F.trim("answer"))
    refuses = F.lit(False)
    for phrase in REFUSALS:
        refuses = refuses | F.contains(low, F.lit(phrase))
    return F.when((low == "") | refuses, 0.0).otherwise(1.0)


#: Metrics that need no model, by name; a name outside this registry is refused by `unknown_metrics`.
METRICS: dict[str, Callable[[], Column]] = {"retrieval_recall": retrieval_recall, "context_precision": context_precision, "citation_rate": citation_rate, "answered": answered}
JUDGED = ("faithfulness", "answer_relevancy", "correctness")


def unknown_metrics(wanted: list[str]) -> list[str]:
    return sorted(set(wanted) - set(METRICS) - set(JUDGED))


def documents_that_hold(items: DataFrame, documents: DataFrame, width: int = 8) -> DataFrame:
    """Rows (item_id, chunk_id): the documents (chunk_id, text) in which an item's words (item_id, text) stand as they are, whatever the white space.

    An item's first words, `width` or fewer, are looked for by an equi-join of hashes, which drops other windows within the task while items
    are few; what they meet is then compared in full.
    """
    spaced = lambda c: F.array_join(F.concat(F.array(F.lit("")), c, F.array(F.lit(""))), " ")
    asked = items.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).withColumn("n", F.least(F.size("item"), F.lit(width)))
    asked = asked.select("item_id", "n", F.xxhash64(F.slice("item", 1, width)).alias("h"), spaced(F.col("item")).alias("item"))
    lengths = [r["n"] for r in asked.select("n").distinct().collect()]  # 1 to width
    rows = documents.select("chunk_id", words(F.col("text")).alias("w"))
    starts = lambda n: F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    hash_of = lambda n: lambda i: F.xxhash64(F.slice("w", i, n))
    hashes = [F.transform(starts(n), hash_of(n)) for n in lengths] or [F.array().cast("array<bigint>")]
    met = rows.select("chunk_id", F.explode(F.array_distinct(F.flatten(F.array(*hashes)))).alias("h")).join(few(asked.select("h").distinct()), "h", "left_semi").join(asked.select("item_id", "h", "item"), "h").select("item_id", "chunk_id", "item").distinct()
    return met.join(rows.select("chunk_id", spaced(F.col("w")).alias("text")), "chunk_id").where(F.contains("text", "item")).select("item_id", "chunk_id")


def start_run(wanted: list[str]) -> list[str]:
    """The metrics of a run that is about to start; unknown names are refused."""
    unknown = unknown_metrics(wanted)
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return wanted


def score_items(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """Long rows (run_id, item_id, metric, score); unknown names are left out here, and a metric that yields no number scores 0."""
    known = [m for m in wanted if m in METRICS]
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(METRICS[m]().cast("double"), F.lit(0.0)).alias("score")) for m in known])
    return samples.select("run_id", "item_id", F.inline(scores))


def build_judge_prompts(samples: DataFrame) -> DataFrame:
    """Rows (item_id, metric, prompt); no faithfulness prompt without context, no correctness prompt without a reference."""
    ask = lambda metric, text, when: F.when(when, F.struct(F.lit(metric).alias("metric"), text.alias("prompt")))
    parts = F.array(
        ask("faithfulness", F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nAnswer:\n"), F.col("answer"), F.lit('\n\nIs every claim supported? Reply {"score": 0..1}.')), F.trim("context") != ""),
        ask("answer_relevancy", F.concat(F.lit("Question:\n"), F.col("question"), F.lit("\n\nAnswer:\n"), F.col("answer"), F.lit('\n\nDoes it address the question? Reply {"score": 0..1}.')), F.lit(True)),
        ask("correctness", F.concat(F.lit("Reference:\n"), F.col("expected_answer"), F.lit("\n\nAnswer:\n"), F.col("answer"), F.lit('\n\nDo they agree? Reply {"score": 0..1}.')), F.col("expected_answer").isNotNull()),
    )
    return samples.select("item_id", F.inline(F.filter(parts, lambda x: x.isNotNull())))


def reply_score(reply: Column) -> Column:
    """The score in the JSON between the first { and the last } of a reply, held to 0..1; 0 where there is none."""
    start, back = F.instr(reply, "{"), F.instr(F.reverse(reply), "}")
    body = F.when((start > 0) & (back > 0), F.substr(reply, start, F.length(reply) - back - start + 2))
    score = F.try_variant_get(F.try_parse_json(body), "$.score", "double")
    return F.when(score.isNull(), 0.0).when(score < 0, 0.0).when(score > 1, 1.0).otherwise(score)


def score_judge_replies(replies: DataFrame) -> DataFrame:
    return replies.select("item_id", "metric", reply_score(F.col("reply")).alias("score"))


def judge_scores(samples: DataFrame, judge: Callable | None) -> DataFrame:
    """Judged metrics in long form. judge: an iterator-of-pandas function from (item_id, metric, prompt) to (item_id, metric, reply)."""
    asked = build_judge_prompts(samples)
    every = samples.select("item_id", F.explode(F.array(*map(F.lit, JUDGED))).alias("metric"))
    if judge is None:
        return every.withColumn("score", F.lit(0.0))
    replies = score_judge_replies(asked.mapInPandas(judge, "item_id long, metric string, reply string"))
    return every.join(replies, ["item_id", "metric"], "left").select("item_id", "metric", F.coalesce("score", F.lit(0.0)).alias("score"))


def summarise_runs(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Mean per run and metric over the items that did not raise; a missing metric counts as 0. items: (run_id, item_id, error).

    A run of which every item raised has no means: one row with a null metric and the status failed.
    """
    ok = items.where("error IS NULL").groupBy("run_id").agg(F.count("*").alias("n"))
    status = items.groupBy("run_id").agg(F.when(F.count_if(F.col("error").isNull()) == 0, "failed").otherwise("done").alias("status"))
    sums = scores.join(items.where("error IS NULL").select("run_id", "item_id"), ["run_id", "item_id"], "left_semi").groupBy("run_id", "metric").agg(F.sum("score").alias("total"))
    means = sums.join(ok, "run_id").select("run_id", "metric", F.round(F.col("total") / F.col("n"), 4).alias("mean"))
    return status.join(means, "run_id", "left").select("run_id", "metric", "mean", "status")


def run_cost(item_costs: DataFrame, judge_costs: DataFrame) -> DataFrame:
    """Known costs of a run's items and judge calls, in millionths; unknown ones add nothing."""
    rows = item_costs.select("run_id", "cost_micro").unionByName(judge_costs.select("run_id", "cost_micro"))
    return rows.groupBy("run_id").agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).cast("long").alias("cost_micro"))


def compare_runs(baseline: DataFrame, candidate: DataFrame, datasets: tuple | None = None) -> DataFrame:
    """Metric by metric: both means (0 where absent) and their difference. datasets: those of the two runs, which must be the same."""
    if datasets and datasets[0] != datasets[1]:
        raise ValueError("runs over different datasets do not compare")
    baseline, candidate = baseline.where("metric IS NOT NULL"), candidate.where("metric IS NOT NULL")
    a, b = baseline.select("metric", F.col("mean").alias("baseline")), candidate.select("metric", F.col("mean").alias("candidate"))
    rows = a.join(b, "metric", "full_outer").select("metric", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("candidate", F.lit(0.0)).alias("candidate"))
    return rows.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 4))


def regressions(comparison: DataFrame, threshold: float = 0.05) -> DataFrame:
    return comparison.where(F.col("delta") < -abs(threshold))


def latest_baseline(runs: DataFrame) -> DataFrame:
    """The newest finished baseline run of each organisation and dataset."""
    newest = Window.partitionBy("org_id", "dataset_id").orderBy(F.desc("created_at"), F.desc("id"))
    return runs.where((F.col("status") == "done") & F.col("is_baseline")).withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
