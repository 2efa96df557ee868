"""Packed second moments, Gaussian distances of a whole table, and random Fourier features against exact kernels."""

import numpy as np
import pytest

from relyframe.operators import vectors
from relyframe.plans import mapping, queries

SMALL = "/root/testdata/sf0.001"


def test_sums_of_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 2)
    r = np.random.default_rng(0)
    m = r.normal(size=(60, 1024)).astype("f4")
    rows = spark.createDataFrame([("a" if k % 3 else None, v.tolist()) for k, v in enumerate(m)], "g string, vec array<float>").repartition(7)
    parts = vectors.partial_sums(rows, "g").select("k", "slot").collect()
    assert len(parts) == len({tuple(p) for p in parts}) <= 2 * 7  # a row a group and task
    got = {x.g: x for x in vectors.sufficient(rows, "g").collect()}
    for g in ("a", None):
        own = np.array([v for k, v in enumerate(m) if (k % 3 > 0) == (g == "a")], float)
        assert got[g].n == len(own) and np.allclose(np.frombuffer(got[g].s), own.sum(axis=0))
        assert np.allclose(vectors.square(np.frombuffer(got[g].ss), 1024), own.T @ own)
    monkeypatch.setattr(vectors, "HELD_BYTES", 1)
    assert {x.g: x.n for x in vectors.sufficient(rows, "g").collect()} == {"a": 40, None: 20}


@pytest.fixture(scope="module")
def table(spark):
    rows = mapping.vectors(spark, SMALL).toPandas()
    return {k: (np.vstack(g["vec"]).astype(float), np.vstack(g["vec"][g["is_reference"]]).astype(float)) for k, g in rows.groupby("category_id")}


def pool_without(table, k):
    return np.vstack([ref for other, (_, ref) in table.items() if other != k])


def test_frechet_of_a_whole_table(spark, table):
    got = {r.category_id: r.value for r in queries.QUERIES["frechet"](spark, SMALL).collect()}
    assert set(got) == set(table)
    for k, (own, _) in table.items():
        pool, eye = pool_without(table, k), 1e-6 * np.eye(64)
        a, b = np.cov(own, rowvar=False), np.cov(pool, rowvar=False)
        cross = np.sqrt(np.clip(np.linalg.eigvals((a + eye) @ (b + eye)).real, 0, None)).sum()
        assert abs(got[k] - (((own.mean(axis=0) - pool.mean(axis=0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * cross)) < 1e-4


def test_mahalanobis_of_a_whole_table(spark, table):
    got = {r.category_id: r.value for r in queries.QUERIES["mahalanobis"](spark, SMALL).collect()}
    assert set(got) == set(table)
    for k, (own, _) in table.items():
        pool = np.vstack([o for other, (o, _) in table.items() if other != k])
        mean = own.mean(axis=0)
        gap = mean / np.linalg.norm(mean) - pool.mean(axis=0)
        assert abs(got[k] - np.sqrt(gap @ np.linalg.inv(np.cov(pool, rowvar=False) + 1e-6 * np.eye(64)) @ gap)) < 1e-5


def test_features_are_near_the_exact_kernel(spark, table):
    rows = mapping.vectors(spark, SMALL)
    ref = np.vstack([r for _, r in table.values()])
    width = 2 * (ref**2).sum(axis=1).mean() - 2 * (ref.mean(axis=0) ** 2).sum()
    assert abs(vectors.mean_square_distance(rows.filter("is_reference")) - width) < 1e-6 * width
    kernel = lambda a, b: np.exp(-((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T) / (2 * width)).mean()
    for n in (64, 1024):
        got = {r.category_id: r.value for r in vectors.mmd_features(rows, rows.filter("is_reference"), "category_id", True, n).collect()}
        for k, (own, _) in table.items():
            pool = pool_without(table, k)
            assert abs(got[k] - (kernel(own, own) + kernel(pool, pool) - 2 * kernel(own, pool))) < 2 / np.sqrt(n)


def test_features_of_few_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.5, 0.0]), ("b", [0.0, 1.0])], "g string, vec array<double>")
    assert {r.g: r.value for r in vectors.mmd_features(rows, rows, "g", True).collect()} == {"a": None, "b": None}
    assert vectors.mmd_features(rows.limit(0), rows, "g", True).count() == 0
    assert {r.value for r in vectors.mmd_features(rows, rows.limit(0), "g", False).collect()} == {None}
