"""Writing an index works its postings out once."""

from pyspark.sql import functions as F

from passages.sources import corpus


def test_postings_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(pdfs):
        for pdf in pdfs:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(500).select(F.concat(F.lit("w"), F.col("id") % 50).alias("term"), F.col("id").alias("chunk_id"), F.lit(1).alias("tf"))
    corpus.write_index(rows.mapInPandas(count, "term string, chunk_id long, tf int"), str(tmp_path / "i"))
    assert corpus.read_index(spark, str(tmp_path / "i")).count() == 500 and seen.value == 500
