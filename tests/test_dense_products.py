"""Dense search by matrix products: the same rows as scoring pair by pair, ties and odd vectors included, and few rows a query beyond its k."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.operators import dense
from passages.operators.lexical import top_k


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(900, 8)).round(2)
    points[100:400] = points[100]  # more equal scores than k
    rows = [(i, f"m{i % 2}", [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(2000, "m0", [1.0] * 5), (2001, "m1", [float("nan")] * 8), (2002, "m0", None), (2003, "m1", [0.0] * 8), (2004, None, [1.0] * 8), (2005, "m0", [1.0, None] * 4)]
    vectors = spark.createDataFrame(rows, "chunk_id long, model string, embedding array<double>").repartition(3)
    return vectors.where("chunk_id % 30 = 0 OR chunk_id = 2003 OR chunk_id = 2000").withColumnRenamed("chunk_id", "query_id"), vectors


def _pairs(queries, vectors, k):
    q = queries.select("query_id", "model", dense.unit(F.col("embedding")).alias("q"))
    v = vectors.select("chunk_id", "model", dense.unit(F.col("embedding")).alias("v"))
    return top_k(q.join(v, "model").select("query_id", "chunk_id", F.round(dense.dot(F.col("q"), F.col("v")), 6).alias("score")), k)


def test_products_against_pairs(tables):
    queries, vectors = tables
    assert sorted(map(str, dense.dense_search(queries, vectors, 7).collect())) == sorted(map(str, _pairs(queries, vectors, 7).collect()))


def test_all_cells_find_what_pairs_find(tables):
    queries, vectors = (x.where("model IS NOT NULL AND embedding[0] <> 0 AND size(embedding) = 8 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x))") for x in tables)
    cells = dense.fit_cells(vectors, cells=6)
    assert sorted(map(str, dense.dense_search_ann(queries, vectors, 7, cells, probes=1.0).collect())) == sorted(map(str, _pairs(queries, vectors, 7).collect()))


def test_few_rows_leave_a_task(tables):
    vectors = tables[1].where("model = 'm0' AND size(embedding) = 8 AND forall(embedding, x -> x IS NOT NULL)").select("chunk_id", "model", dense.unit(F.col("embedding")).alias("v")).repartition(2)
    asked = vectors.where("chunk_id % 30 = 0").select(F.col("chunk_id").alias("query_id"), "model", F.col("v").alias("q")).collect()
    found = dense._best(vectors, asked, 7, vectors.schema["chunk_id"].dataType, ["model"], scaled=True)
    assert found.count() <= 2 * 8 * len(asked) < vectors.count() * len(asked) / 20
