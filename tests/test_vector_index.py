"""The stored vector index: recall, what is read, and codes against exact products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.adapters import view
from passages.operators import dense, vector_index


def _recall(exact, found):
    return exact.join(found, ["query_id", "chunk_id"]).count() / exact.count()


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Every vec_id divisible by 50 as a query; these vectors have no structure, so half of the cells are looked at."""
    sf, path = "/root/testdata/sf0.01", str(tmp_path / "vectors")
    vectors = view(spark, sf, "vectors")
    vector_index.write_vectors(vectors, vector_index.fit_codes(vectors), path)
    stored = spark.read.parquet(path)
    assert stored.count() == vectors.count() and stored.where(F.octet_length("code") == 16).count() == vectors.count()
    queries = view(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr("concat('m', vec_id % 2)").alias("model"), "embedding")
    exact = dense.dense_search(queries, vectors, 20)
    assert _recall(exact, vector_index.search_vectors(queries, path, 20)) >= 0.9
    everything = vector_index.search_vectors(queries, path, 20, probes=1.0, head=1000)
    assert sorted(map(str, everything.collect())) == sorted(map(str, exact.collect()))
    assert vector_index.search_vectors(queries.limit(0), path, 20).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 3
    return spark.createDataFrame([(i, "m", (centres[i % 40] + rng.standard_normal(16) * 0.4).tolist()) for i in range(4000)], "chunk_id int, model string, embedding array<double>")


def test_clusters_are_pruned(spark, tmp_path, clustered):
    """Where vectors form clusters, few cells are read, and of full vectors none but in these cells."""
    path = str(tmp_path / "vectors")
    codes = vector_index.fit_codes(clustered, parts=8, cells=dense.fit_cells(clustered, 40))
    vector_index.write_vectors(clustered, codes, path)
    queries = clustered.where("chunk_id IN (3, 500, 1777)").withColumnRenamed("chunk_id", "query_id")
    found = vector_index.search_vectors(queries, path, 10, probes=0.1)
    assert _recall(dense.dense_search(queries, clustered, 10), found) >= 0.9
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert any("PartitionFilters: [cell" in line and "ReadSchema: struct<chunk_id:int,model:string,code:binary>" in line for line in scans)
    read = spark.read.parquet(path).where(F.col("cell").isin([r["cell"] for r in found.join(spark.read.parquet(path), "chunk_id").select("cell").distinct().collect()])).count()
    assert read <= 0.4 * 4000


def test_codes_approximate_products(clustered):
    codes = vector_index.fit_codes(clustered, parts=8)
    v = np.array([r["v"] for r in clustered.limit(300).select(dense.unit(F.col("embedding")).alias("v")).collect()])
    cell = (v @ np.array(codes.cells.centres).T).argmax(axis=1)
    code = codes.encode(v, cell)
    back = np.array(codes.cells.centres)[cell] + np.concatenate([codes.books[j][code[:, j]] for j in range(8)], axis=1)
    assert np.abs(back - v).max() < 0.2 and np.linalg.norm(back - v, axis=1).mean() < 0.1
    with pytest.raises(ValueError):
        vector_index.fit_codes(clustered, parts=5)
