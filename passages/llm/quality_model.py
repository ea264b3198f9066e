"""Quality classifier: a sparse ensemble of rules, compiled to one Spark column expression.

Trees over text statistics are grown by Spark ML on a bounded sample of labelled rows. Every path from a root is a
conjunction of comparisons, a rule; logistic regression with an L1 penalty weighs the rules and drops most of them. What
is left is a sum of CASE expressions: scoring is a narrow pass inside the JVM, without shuffle, model file or Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import WORD, small, words_of, written

#: (statistic, whether it must be above the threshold, threshold)
Condition = tuple[str, bool, float]


def statistics(docs: DataFrame, *, id_col: str | None = None, id_value: Column | None = None, text_col: str) -> tuple[DataFrame, list[str]]:
    """Rows (id, one double a statistic) and the statistics' names. Null texts count as empty; every value is finite.

    id_value may be any column instead, such as a struct of the whole row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select((F.col(id_col) if id_value is None else id_value).alias("id"), text.alias("text"), words_of(F.col(text_col)).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n_words, n_lines, n_chars = F.size("words"), F.size("lines"), F.length("text")
    repeats = F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1)))
    per = lambda x, n: (x / F.greatest(n, F.lit(1))).cast("double")
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern))
    found = {
        "log_words": F.log1p(n_words.cast("double")),
        "distinct_share": per(F.size(F.array_distinct("words")), n_words),
        "adjacent_repeat_share": per(repeats, n_words),
        "chars_per_word": per(n_chars, n_words),
        "symbols_per_word": per(count(r"[#*$%&<>|~^\\]"), n_words),
        "sentence_marks_per_word": per(count(r"[.!?…]"), n_words),
        "shouts_per_word": per(count("!"), n_words),
        "commas_per_word": per(count("[,;:]"), n_words),
        "capital_share": per(count(r"\p{Lu}"), n_chars),
        "letter_share": per(count(r"\p{L}"), n_chars),
        "digit_share": per(count(r"[0-9]"), n_chars),
        "words_per_line": per(n_words, n_lines),
        "distinct_line_share": per(F.size(F.array_distinct("lines")), n_lines),
        "ended_line_share": per(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:][\x20\x09-\x0D]*\z"))), n_lines),
    }
    return rows.select("id", *[v.alias(k) for k, v in found.items()]), list(found)


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The score over the columns of statistics()."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) > t if above else F.col(name) <= t for name, above, t in rule])


def tree_rules(tree, names: list[str]) -> set[tuple[Condition, ...]]:
    """The conjunctions on the way to each node below a tree's root."""
    found: set[tuple[Condition, ...]] = set()

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found.add(tuple(sorted((name, above, t) for (name, above), t in path.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            name, t = names[node.split().featureIndex()], round(node.split().threshold(), 6)
            walk(node.leftChild(), path | {(name, False): min(t, path.get((name, False), t))})
            walk(node.rightChild(), path | {(name, True): max(t, path.get((name, True), t))})

    walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree.rootNode(), {})
    return found


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, n_trees: int = 12, depth: int = 4, penalty: float = 0.0005) -> RuleEnsemble:
    """Fits on at most max_rows labelled rows, those with the least hash of their id.

    labels: one row an id with a label of 0 or 1; rows with a null id or label are left out, of repeated ids the largest
    label counts. Without labels, or with one label only, the ensemble has no rules and scores the label's smoothed mean.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
    chosen = written(chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows), "labels")
    sample = docs.join(small(chosen.select(F.col("id").alias(id_col))), id_col, "left_semi")
    stats, names = statistics(sample, id_col=id_col, text_col=text_col)
    rows = written(stats.join(small(chosen), "id"), "statistics")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    mean = (positive + 1) / (n + 2)
    if positive in (0, n):
        return RuleEnsemble(_logit(mean), ())
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=n_trees, maxDepth=depth, featureSubsetStrategy="0.5", minInstancesPerNode=max(2, n // 1000), seed=7).fit(vectors)
    rules = sorted(set().union(*(tree_rules(tree, names) for tree in forest.trees)))
    if not rules:
        return RuleEnsemble(_logit(mean), ())
    applied = rows.select("label", array_to_vector(F.array(*[F.when(holds(r), 1.0).otherwise(0.0) for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(applied)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return RuleEnsemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def classify(docs: DataFrame, model: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows (id, score, predicted), one per input row; predicted is 1 where score >= threshold. Null texts score as empty ones."""
    stats, _ = statistics(docs, id_col=id_col, text_col=text_col)
    scored = stats.select(F.col("id").alias(id_col), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_rejected(docs: DataFrame, model: RuleEnsemble, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with all their columns: a filter, without a join."""
    stats, _ = statistics(docs, id_value=F.struct("*"), text_col=text_col)
    # a row number in the same projection keeps Spark from pushing the filter below it, where it would work out each statistic again for each rule
    scored = stats.select("id", model.score().alias("score"), F.monotonically_increasing_id().alias("row"))
    return scored.where((F.col("score") >= threshold) & (F.col("row") >= 0)).select("id.*")
