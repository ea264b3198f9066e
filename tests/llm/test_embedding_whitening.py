"""Whitening against plain eigenvectors and exact integers, the solver's parts, and awkward rows."""

import math

import numpy as np
import pytest
from conftest import SF

from passages import llm
from passages.llm import embedding_whitening as ew


def test_query(spark):
    rows = llm.queries()["op11_whitening"](spark, SF).toPandas()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in given["embedding"]], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    want = (n * x - sums) / n @ vectors[:, :16] / np.sqrt(values[:16])
    assert got.shape == want.shape and np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    first = rows[rows["component"] == 1].set_index("vec_id")
    assert (first["deviation"].loc[given["vec_id"]].to_numpy() == ((n * x - sums) ** 2).sum(axis=1)).all()
    assert set(rows["n"]) == {n} and rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-10
    shares = rows[rows["vec_id"] == given["vec_id"][0]].sort_values("component")["explained"].to_numpy()
    assert shares == pytest.approx(values[:16] / values.sum(), rel=1e-10)


@pytest.mark.parametrize("kind", ["random", "ties", "near", "identity", "low_rank", "graded", "zero", "one"])
def test_singular_directions(kind):
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    made = {
        "random": lambda: np.triu(rng.standard_normal((40, 40))), "ties": lambda: np.diag([5.0] * 10 + [1.0] * 30) @ turn, "near": lambda: np.diag(np.repeat([3, 2.9999999, 1], [8, 8, 24])) @ turn,
        "identity": lambda: np.eye(40), "low_rank": lambda: rng.standard_normal((40, 5)) @ rng.standard_normal((5, 40)), "graded": lambda: np.diag(2.0 ** -np.arange(40)) @ turn, "zero": lambda: np.zeros((40, 40)), "one": lambda: np.array([[3.0]]),
    }
    matrix = np.linalg.qr(made[kind]())[1]
    values, vectors = ew.singular_directions(matrix, 16)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    assert len(values) == {"low_rank": 5, "zero": 0, "one": 1}.get(kind, 16)
    assert values == pytest.approx(want[: len(values)], rel=1e-12)
    if len(values):
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(matrix.T @ (matrix @ vectors) - vectors * values).max() < 1e-13 * want[0]


def test_dqds_small_values_keep_their_digits():
    """A bidiagonal matrix whose least singular value is far below rounding of the largest; its determinant tells what it must be."""
    a, b = [1.0, 1e-3, 1e-6, 1e-9], [0.5, 0.25, 1e-7]
    found = ew.dqds([x * x for x in a], [x * x for x in b])
    assert math.prod(found) == pytest.approx(math.prod(a) ** 2, rel=1e-12)


def test_centred_is_exact_beyond_machine_integers():
    x = np.array([[1 << 40, 5]], np.int64)
    assert ew.centred(x, 1 << 30, np.array([7, 1], object)).tolist() == [[(1 << 70) - 7, 5 * (1 << 30) - 1]]


def test_merges_in_a_tree(spark, monkeypatch):
    """Many tasks and a fan of two: the same model as from one task."""
    vectors = [(i, [float(x) for x in np.random.default_rng(i).standard_normal(5)]) for i in range(300)]
    rows = ew.quantised(spark.createDataFrame(vectors * 2, "vec_id long, embedding array<float>"))
    one = ew.fit(rows.coalesce(1), 4)
    monkeypatch.setattr(ew, "FAN", 2)
    many = ew.fit(rows.repartition(9), 4)
    assert one.n == many.n <= 300 and one.sums == many.sums
    assert many.eigenvalues == pytest.approx(one.eigenvalues, rel=1e-12) and np.abs(many.directions - one.directions).max() < 1e-9


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i % 7), 1.0], "a") for i in range(10)]
    rows = [(20, None, "a"), (21, [], "a"), (22, [1.0, None, 2.0], "a"), (23, [nan, 1.0, 1.0], "a"), (24, [1.0, -inf, 1.0], "a"), (25, [1e30, 1.0, 1.0], "a"), (26, [1.0, 2.0], "a"), (None, [1.0, 1.0, 1.0], None), good[3]]
    table = spark.createDataFrame(good + rows, "vec_id long, embedding array<double>, n string")
    quantised = ew.quantised(table)
    assert sorted((r.id for r in quantised.collect()), key=str) == sorted([*range(10), 26, None, 3], key=str)
    model = ew.fit(quantised)
    found = ew.whiten(quantised, model).collect()
    assert model.n == 10 and len(model.eigenvalues) == 2 and len(found) == 12 * 2  # the third entry is constant, and (1, 1, 1) is there already
    assert model.identity_error < 1e-10 and len({(r.id, r.component) for r in found}) == 11 * 2
    assert ew.fit(quantised.limit(0)) is None and ew.whiten(quantised, None).count() == 0
    alone = quantised.where("id = 5")
    assert ew.whiten(alone, ew.fit(alone)).count() == 0  # one vector has no spread
