"""Toxicity: a classifier over words and their beginnings whose score must not hang on who is talked about.

Weights are learnt by logistic regression on a bounded sample of labelled texts. In every sentence of that sample that names a group
of people, the name is swapped for others of its kind; what the swap changes in the features enters the fit as a pair of rows with
both labels, whose common loss is least where the change of score is zero and grows with it either way. Names that stand in many
toxic texts thus don't become evidence themselves, and neutral mentions aren't called toxic.

Scoring is one narrow pass over whole texts: a score is a sum over words, and a word's value is kept in a memo of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import ship, small, written

#: Names of groups of people, by kind; the last of each kind is a name for anybody.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"), ("female", "male", "human"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "ordinary"), ("gays", "lesbians", "homosexuals", "heterosexuals", "people"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "american", "local"), ("immigrants", "refugees", "foreigners", "natives", "people"),
    ("disabled", "deaf", "blind", "autistic", "able"), ("old", "young", "adult"),
    ("frauen", "männer", "menschen"), ("muslime", "christen", "juden", "menschen"), ("ausländer", "flüchtlinge", "menschen"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs", "gens"), ("étrangers", "immigrés", "gens"),
    ("mujeres", "hombres", "personas"), ("musulmanes", "cristianos", "judíos", "personas"), ("extranjeros", "inmigrantes", "personas"),
)

WORDS, SENTENCES = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?…\n]+")

#: What the intercept's own feature is, so that the penalty on its weight hardly weighs.
INTERCEPT = 10.0

#: Letters of the beginnings of words that are features beside the words; words added to a text's length, so that one hit in a short text isn't a high rate.
BEGINNINGS, SMOOTHING = (4, 5, 6), 50


def features_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a hyphen."""
    return [word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) > n]]


def rates(words: list[str]) -> dict[str, float]:
    """Features of a text: how often each occurs among its words, times SMOOTHING, so that one word in SMOOTHING counts about 1."""
    scale = SMOOTHING / (len(words) + SMOOTHING)
    found: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for f in features_of(word):
            found[f] += n
    return {f: n * scale for f, n in found.items()}


def swaps(text: str, groups: tuple[tuple[str, ...], ...]) -> Iterator[dict[str, float]]:
    """What the features of each sentence change by when one of its identity terms is swapped for another of its kind."""
    others: dict[str, set[str]] = {}
    for group in groups:
        for term in group[:-1]:
            others.setdefault(term, set()).update(x for x in group if x != term)
    for sentence in SENTENCES.split(text.lower()):
        words = WORDS.findall(sentence)
        for term in sorted(set(words) & others.keys()):
            n = words.count(term) * SMOOTHING / (len(words) + SMOOTHING)
            for other in sorted(others[term]):
                change = Counter({f: n for f in features_of(other)})
                change.subtract({f: n for f in features_of(term)})
                yield {f: v for f, v in change.items() if v}


@dataclass(frozen=True)
class ToxicityModel:
    """score = logistic(intercept + sum over words of the weights of their features, times SMOOTHING / (words + SMOOTHING))."""

    intercept: float
    weights: dict[str, float]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, n_features: int = 4096, min_docs: int = 3, penalty: float = 2e-4, balance: float = 4.0, identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fits on at most max_rows labelled rows, those with the least hash of their id, and on the n_features features that tell the labels apart best.

    labels: one row an id with a label of 0 or 1; rows with a null id or label are left out, of repeated ids the largest label
    counts. Features stand in min_docs of the sample's texts at least and are ranked by chi-squared of occurrence and label.
    balance is the weight of a swapped sentence beside a text's 1; 0 fits without swaps. Without labels, or with one label only,
    the model has no weights and scores the label's smoothed mean. Whole texts are learnt from; null ones are empty.
    """
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
    chosen = written(chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows), "toxicity-labels")
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small(chosen), "id").select("label", "text")
    sample = written(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxicity-sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    mean = (positive + 1) / (n + 2)
    if positive in (0, n):
        return ToxicityModel(math.log(mean / (1 - mean)), {})
    names = _telling(sample, n, positive, n_features, min_docs)
    index = {f: i + 1 for i, f in enumerate(names)}  # at 0 stands the intercept, which swaps don't touch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[float, float, list[int], list[float]]] = []

            def add(label: float, weight: float, values: dict[int, float]) -> None:
                at = sorted(values)
                out.append((label, weight, at, [values[i] for i in at]))  # noqa: B023

            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add(label, 1.0, {0: INTERCEPT} | {index[f]: v for f, v in rates(WORDS.findall(text.lower())).items() if f in index})
                add(0.0, 1.0, {})  # moves no weight, but lets the intercept's feature vary: the solver drops constant ones
                for change in swaps(text, identity_terms) if balance else ():
                    if values := {index[f]: v for f, v in change.items() if f in index}:
                        add(0.0, balance / 2, values)
                        add(1.0, balance / 2, values)
            label, weight, at, values = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.float64()), pa.array(weight, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["label", "weight", "at", "value"])

    size = len(names) + 1
    sparse = F.udf(lambda at, values: Vectors.sparse(size, at, values), VectorUDT())
    rows = written(sample.mapInArrow(run, "label double, weight double, at array<int>, value array<double>"), "toxicity-rows").select("label", "weight", sparse("at", "value").alias("features"))
    fitted = LogisticRegression(elasticNetParam=0.5, regParam=penalty, fitIntercept=False, standardization=False, weightCol="weight", maxIter=100).fit(rows.cache())
    rows.unpersist()
    found = fitted.coefficients.toArray().tolist()
    return ToxicityModel(found[0] * INTERCEPT, {f: w for f, w in zip(names, found[1:], strict=True) if w})


def _telling(sample: DataFrame, n: int, positive: float, n_features: int, min_docs: int) -> list[str]:
    """The features whose occurrence in a text goes with its label most, by chi-squared; ties by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label > 0].update({f for w in set(WORDS.findall(text.lower())) for f in features_of(w)})
            seen = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([counts[0][f] for f in seen], pa.int64()), pa.array([counts[1][f] for f in seen], pa.int64())], names=["feature", "n0", "n1"])

    with_it = F.col("n0") + F.col("n1")
    expected = with_it * positive / n
    apart = (F.col("n1") - expected) ** 2 / (expected * (n - with_it) / n * (n - positive) / n)
    counts = sample.mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    top = counts.where((with_it >= min_docs) & (with_it < n)).select("feature", apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(n_features)
    return [r["feature"] for r in top.collect()]


def classify(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, memo_size: int = 400_000) -> DataFrame:
    """Rows (id, score, predicted), one per input row, repeated and null ids included; predicted is 1 where score >= threshold.

    Null and empty texts have no words and score as the intercept says. Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, memo = model.weights.get, {}

        def value(word: str) -> float:
            found = memo.get(word)
            if found is None:
                found = sum(weight(f, 0.0) for f in features_of(word))
                if len(memo) < memo_size:
                    memo[word] = found
            return found

        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                words = WORDS.findall(text.lower()) if text else ()
                total = model.intercept + sum(map(value, words)) * SMOOTHING / (len(words) + SMOOTHING)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
