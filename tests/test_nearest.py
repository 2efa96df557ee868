"""Nearest prototypes through the metric index: exact, and with few pairs compared."""

import numpy as np
import pytest

from relyframe.operators import nearest


def clustered(n_clusters, size, dims, spread, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n_clusters, dims))
    m = np.repeat(centres, size, axis=0) + r.normal(0, spread, (n_clusters * size, dims))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame_of(spark, names, m):
    return spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, m, strict=True)], "g string, proto array<double>").repartition(3)


@pytest.fixture(autouse=True)
def indexed(monkeypatch):
    monkeypatch.setattr(nearest, "DIRECT_ROWS", 0)


def brute(probes, names, refs, ref_names, exclude):
    cosine = probes @ refs.T
    if exclude:
        cosine[np.array(names, object)[:, None] == np.array(ref_names, object)[None, :]] = -np.inf
    best = cosine.max(axis=1, initial=-np.inf)
    return {n: None if not np.isfinite(b) else 1 - b for n, b in zip(names, best, strict=True)}


@pytest.mark.parametrize("block, direct, exclude", [(4096, 0, True), (3, 0, True), (64, 0, False), (64, 4096, True), (64, 4096, False)])
def test_distances_are_exact(spark, monkeypatch, block, direct, exclude):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "DIRECT_ROWS", direct)
    m = np.vstack([clustered(9, 20, 6, 0.05), clustered(1, 40, 6, 3.0, 1)])
    m[:12] = m[0]  # equal prototypes of different groups
    m[30] = 0
    refs, ref_names = m[::2], [f"n{k}" for k in range(len(m))][::2]
    names = [f"n{k}" for k in range(len(m))]
    got = {r.g: r.distance for r in nearest.nearest_prototype(frame_of(spark, names, m), frame_of(spark, ref_names, refs), "g", exclude).collect()}
    want = brute(m, names, refs, ref_names, exclude)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_pairs_are_compared_on_clusters(spark):
    m = clustered(60, 50, 16, 0.02)
    names = [f"n{k}" for k in range(len(m))]
    rows = nearest.nearest_with_counts(frame_of(spark, names, m), frame_of(spark, names, m), "g", True).collect()
    want = brute(m, names, m, names, True)
    assert all(abs(r.distance - want[r.g]) < 1e-9 for r in rows) and len(rows) == len(m)
    assert sum(r.n_compared for r in rows) < 0.1 * len(m) ** 2


def test_one_cell_of_probes_and_references(spark, monkeypatch):
    """A third of all rows in one spot: its references fill rings and parts, and its probes are dealt to several tasks."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    m = np.vstack([clustered(1, 200, 8, 0.001), clustered(20, 20, 8, 0.3, 2)])
    names = [f"n{k}" for k in range(len(m))]
    got = {r.g: r.distance for r in nearest.nearest_prototype(frame_of(spark, names, m), frame_of(spark, names, m), "g", True).collect()}
    want = brute(m, names, m, names, True)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_without_other_references(spark):
    m = clustered(1, 3, 4, 0.1)
    some, none = frame_of(spark, ["a", "b", None], m), frame_of(spark, [], m[:0])
    assert {r.distance for r in nearest.nearest_prototype(some, none, "g", True).collect()} == {None}
    assert nearest.nearest_prototype(none, some, "g", True).count() == 0
    alone = frame_of(spark, ["a"], m[:1])
    got = {r.g: r.distance for r in nearest.nearest_prototype(some, alone, "g", True).collect()}
    assert got["a"] is None and abs(got["b"] - (1 - m[1] @ m[0])) < 1e-9 and abs(got[None] - (1 - m[2] @ m[0])) < 1e-9
    zero = frame_of(spark, ["z", "a"], np.vstack([np.zeros(4), m[0]]))
    got = {r.g: r.distance for r in nearest.nearest_prototype(zero, zero, "g", True).collect()}
    assert abs(got["z"] - 1) < 1e-9 and abs(got["a"] - 1) < 1e-9
