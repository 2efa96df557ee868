"""The model grid: folds against plain fits of each fold, one set of scans whatever the number of designs."""

import numpy as np
import pandas as pd
import pytest

from relyframe.plans import grid, models, studies

NAMES = ["category_id", "species", "location_id", "time", "y", "y2", "n", "a", "b", "gap", "flat", "flag"]


def made(n_groups, rows, hot=0, seed=0):
    """Rows of many species; ``gap`` has missing values, ``hot`` rows more are in the first species, ``flag`` and ``b`` differ by group."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n_groups):
        shift = r.normal()
        for i in range(rows + (hot if k == 0 else 0)):
            a, b = r.normal() + shift / 3, r.uniform() + (3 if k == 0 and hot else 0)
            y = 1 / (1 + np.exp(-(0.4 * a - 0.8 * b + 0.3 * shift + r.normal(0, 0.3))))
            out.append((f"s{k:04d}", f"s{k:04d}", f"l{i % 7}", str(i), float(y), None if i % 5 == 1 else float(1 - y * 0.7), int(r.integers(5, 90)), a, b, None if r.random() < 0.2 else a + r.normal(), 2.0, float(r.random() < 0.4)))
    return out


def plain_folds(pdf, target, design, group):
    """Fully converged fits of each fold, one by one, and their predictions."""
    pdf = pdf[pdf[target].notna()]
    out = {}
    for g in sorted(pdf[group].unique()):
        rest, own = pdf[pdf[group] != g], pdf[pdf[group] == g]

        def columns(rows):
            cols = [np.ones(len(rows))]
            for c in design.continuous:
                m, sd = rest[c].mean(), rest[c].std(ddof=0)
                cols.append(np.nan_to_num((rows[c].to_numpy(float) - m) / sd) if sd > 1e-12 else np.zeros(len(rows)))
            if design.support:
                v = np.log1p(rest["n"].to_numpy(float))
                cols.append((np.log1p(rows["n"].to_numpy(float)) - v.mean()) / v.std())
            return np.column_stack(cols + [rows[c].to_numpy(float) for c in design.binary])

        x, y, w = columns(rest), rest[target].to_numpy(float), rest["n"].to_numpy(float)
        beta = np.zeros(x.shape[1])
        for _ in range(60):
            mu = 1 / (1 + np.exp(-x @ beta))
            beta = beta + np.linalg.pinv((x.T * (w * mu * (1 - mu))) @ x) @ (x.T @ (w * (y - mu)))
        for key, p in zip(zip(own["category_id"], own["time"], strict=True), 1 / (1 + np.exp(-columns(own) @ beta)), strict=True):
            out[key] = p
    return out


DESIGNS = [
    models.Design("plain", ("a", "b")), models.Design("gaps", ("gap", "b", "flat"), ("flag",), support=True), models.Design("none"), models.Design("flags", (), ("flag",), support=True),
]


@pytest.mark.parametrize("n_groups, rows, hot", [(100, 8, 0), (30, 10, 300), (3, 20, 0)])
def test_folds_equal_plain_fits(spark, n_groups, rows, hot):
    table = pd.DataFrame(made(n_groups, rows, hot), columns=NAMES)
    frame = spark.createDataFrame(made(n_groups, rows, hot), "category_id string, species string, location_id string, time string, y double, y2 double, n long, a double, b double, gap double, flat double, flag double").repartition(3)
    oos, fits = grid.oos_grid(frame, DESIGNS, ["y", "y2"], "n", studies.SCHEMES, ["category_id", "time"])
    got = oos.toPandas()
    assert len(fits) == 16
    for d in DESIGNS:
        for target in ("y", "y2"):
            for scheme, group in studies.SCHEMES.items():
                own = got[(got.design == d.name) & (got.target == target) & (got.group_scheme == scheme)]
                want = plain_folds(table, target, d, group)
                assert len(own) == len(want)
                assert all(abs(p - want[c, t]) < 1e-8 for c, t, p in zip(own.category_id, own.time, own.predicted, strict=True)), (d.name, target, scheme)


def test_full_fits_equal_single_ones(spark):
    frame = spark.createDataFrame(made(30, 10), "category_id string, species string, location_id string, time string, y double, y2 double, n long, a double, b double, gap double, flat double, flag double")
    _, fits = grid.oos_grid(frame, DESIGNS, ["y2"], "n", {"species": "category_id"}, ["time"])
    for f in fits:
        one = models.fit_many(models.prepare(frame, "y2", "n", f.item.design, "category_id"), f.item.design)
        assert abs(f.pseudo_r2 - one.pseudo_r2[0]) < 1e-8 and np.allclose(f.coef, np.nan_to_num(one.coef[0]), atol=1e-7)


def jobs_of(spark, name, run):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_designs_share_their_scans(spark):
    frame = spark.createDataFrame(made(60, 10), "category_id string, species string, location_id string, time string, y double, y2 double, n long, a double, b double, gap double, flat double, flag double").cache()
    run = lambda designs, targets: grid.oos_grid(frame, designs, targets, "n", studies.SCHEMES, ["time"])
    one = jobs_of(spark, "one", lambda: run(DESIGNS[1:2], ["y"]))
    all_ = jobs_of(spark, "all", lambda: run(DESIGNS, ["y", "y2"]))
    assert 0 < all_ <= 1.5 * one  # eight times the models; some need an iteration more


def test_work_of_many_folds_is_that_of_few(spark):
    """Rows times folds never arises: with every group light, no fold is iterated over all rows."""
    frame = spark.createDataFrame(made(2000, 3), "category_id string, species string, location_id string, time string, y double, y2 double, n long, a double, b double, gap double, flat double, flag double")
    seen, exact = [], grid._exact_folds
    grid._exact_folds = lambda rows, layout, fits, maps, coefs, folds: seen.append(len(folds)) or exact(rows, layout, fits, maps, coefs, folds)
    try:
        _, fits = grid.oos_grid(frame, DESIGNS[:2], ["y"], "n", {"species": "category_id"}, ["time"])
    finally:
        grid._exact_folds = exact
    assert sum(seen) <= 20 and all(f.ok.all() and len(f.groups) == 2000 for f in fits)


def test_edge_cases(spark):
    names = "category_id string, species string, location_id string, time string, y double, y2 double, n long, a double, b double, gap double, flat double, flag double"
    rows = made(6, 8)
    rows += [(None, None, "", "x", 0.5, None, 3, 1.0, 1.0, None, 2.0, None), ("s0001", "s0001", None, "z", None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, names)
    oos, _ = grid.oos_grid(frame, DESIGNS, ["y", "y2"], "n", studies.SCHEMES, ["time"])
    assert oos.filter("group is null or actual is null").count() == 0 and oos.filter("predicted is null").count() == 0
    nothing, fits = grid.oos_grid(frame.limit(0), DESIGNS, ["y"], "n", studies.SCHEMES, ["time"])
    assert nothing.count() == 0 and all(not f.groups for f in fits)
    folded = grid.oos_predictions(frame, "y", "n", DESIGNS[0], "category_id", "species", ["time"], folds=3)
    assert {r.group for r in folded.select("group").distinct().collect()} <= {"0", "1", "2"} and folded.count() == 48
    with pytest.raises(ValueError):
        limit, grid.MOST_GROUPS = grid.MOST_GROUPS, 3
        try:
            grid.oos_grid(frame, DESIGNS, ["y"], "n", studies.SCHEMES, ["time"])
        finally:
            grid.MOST_GROUPS = limit
