"""The corpus pipeline: from raw documents to a mix, each stage the work of one operator of passages.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
docs, whatever these are. An empty table gives an empty one. Rows with a null id, text, language or source are ordinary rows but
for what a stage says about them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm import decontaminate, line_dedup, ngram_join, quality_model, source_mix
from passages.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among them.

    Null and empty texts are scored like any other, repeated rows alike. Without labels for docs, all score the same half and stay.
    """
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.without_rejected(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts, near copies counting as one document; n_chars follows. No document goes.

    Null and empty texts, texts of nothing but recurring lines and rows with a null id stay as they are; repeated rows are treated alike.
    """
    cleaned = line_dedup.drop_recurring_lines(docs, ngram_join.near_copies(docs), spare_emptied=True)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Of repeated rows one stays. Null, empty and wordless texts are in no group, nor are rows with a null id: all of them stay.
    """
    return ngram_join.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and rows with a null id stay; repeated rows go or stay together."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: one row for each row, of null and empty texts with none. Null sources are one source."""
    return source_mix.mix_sources(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("mix", mix)]

#: Trees, lasso and the cube method are beyond SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
