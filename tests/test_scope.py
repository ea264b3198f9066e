"""Dense search within scopes: equal to filtering all pairs, and no pair leaves its task before it is ranked."""

import random

from pyspark.sql import functions as F

from passages.operators import dense


def _tables(spark):
    r = random.Random(5)
    vectors = spark.createDataFrame([(i, i % 13, "m", [r.gauss(0, 1) for _ in range(8)]) for i in range(300)], "chunk_id int, source_id int, model string, embedding array<double>")
    queries = spark.createDataFrame([(i, "m", [r.gauss(0, 1) for _ in range(8)]) for i in range(12)], "query_id int, model string, embedding array<double>")
    sets = [range(13), (1, 2), (2, 1), (5,), (5,), (), (99,), (1, 2, 3)]
    asks = [(q, s) for q in range(12) for s in sets[q % len(sets)]]
    return queries, vectors, spark.createDataFrame(asks + asks[:5], "query_id int, source_id int"), asks


def test_scope_by_source(spark):
    queries, vectors, scope, asks = _tables(spark)
    everything = dense.dense_search(queries, vectors, 10_000).collect()
    want = {}
    for r in sorted(everything, key=lambda r: (r.query_id, -r.score, r.chunk_id)):
        if (r.query_id, r.chunk_id % 13) in set(asks) and len(want.setdefault(r.query_id, [])) < 5:
            want[r.query_id].append((r.chunk_id, r.score))
    found = {}
    for r in sorted(dense.dense_search(queries, vectors, 5, scope).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert found == {k: v for k, v in want.items() if v}
    by_chunk = scope.join(vectors.select("chunk_id", "source_id"), "source_id").select("query_id", "chunk_id")
    assert sorted(map(str, dense.dense_search(queries, vectors, 5, by_chunk).collect())) == sorted(map(str, dense.dense_search(queries, vectors, 5, scope).collect()))


def test_groups(spark):
    _, _, scope, asks = _tables(spark)
    members, reach = dense.source_groups(scope)
    groups = {r.query_id: r.grp for r in members.collect()}
    sets = {q: frozenset(s for p, s in asks if p == q) for q in groups}
    assert all((groups[a] == groups[b]) == (sets[a] == sets[b]) for a in groups for b in groups)
    assert {(r.source_id, g) for r in reach.collect() for g in r.grps} == {(s, groups[q]) for q, s in asks}


def test_plan_has_no_exchange_of_pairs(spark):
    queries, vectors, scope, _ = _tables(spark)
    found = dense.dense_search(queries, vectors, 5, scope)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line and "chunk_id" in line.split("ENSURE")[0]]
    assert not exchanges and "LeftSemi" not in plan and "NestedLoop" not in plan


def test_blocks_by_bytes(spark, monkeypatch):
    queries, vectors, scope, _ = _tables(spark)
    whole = sorted(map(str, dense.dense_search(queries, vectors, 5, scope).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 500)
    assert dense._blocks(queries) >= 4 and sorted(map(str, dense.dense_search(queries, vectors, 5, scope).collect())) == whole
    assert dense.dense_search(queries.limit(0), vectors, 5).count() == 0 and dense.dense_search(queries, vectors, 5, scope.where(F.lit(False))).count() == 0
