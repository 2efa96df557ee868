"""Vectors, many-model fits, bootstraps, associations and studies against closed forms and planted laws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import nearest, scoring, vectors
from relyframe.plans import association, grid, models, studies


def test_distribution_distances():
    eye = np.eye(2)
    assert abs(vectors.frechet((np.zeros(2), eye), (np.array([3.0, 4.0]), eye)) - 25) < 1e-4
    assert abs(vectors.frechet((np.zeros(2), eye), (np.zeros(2), 4 * eye)) - 2) < 1e-4
    x = np.random.default_rng(0).normal(size=(40, 3))
    assert abs(vectors.mmd_rbf(x, x)) < 1e-12 and vectors.mmd_rbf(x, x + 5) > 0.1
    pool = vectors.gaussian(40, x.sum(axis=0), (x.T @ x).ravel())
    assert np.allclose(pool[1], np.cov(x, rowvar=False)) and vectors.mahalanobis(pool[0] + 9, pool) > vectors.mahalanobis(pool[0], pool)


@pytest.fixture(scope="module")
def species(spark):
    e = np.eye(3)
    r = np.random.default_rng(1)
    rows = [(f"tight{k}", (e[k] + r.normal(0, 0.01, 3)).tolist()) for k in (0, 1) for _ in range(6)]
    rows += [("loose", (e[2] + r.normal(0, 0.9, 3)).tolist()) for _ in range(6)] + [("single", [1.0, 1.0, 0.0])]
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "vec_id long, category_id string, vec array<double>")


def test_familiarity(species):
    got = {r.category_id: r.value for r in vectors.familiarity(species, "category_id", "silhouette").collect()}
    assert got["tight1"] > 0.95 and got["loose"] < got["tight1"] and got["single"] is None
    assert vectors.familiarity(species, "category_id", "mahalanobis").count() == 4
    assert vectors.familiarity(species, "category_id", "prototype").filter("value is null").count() == 0
    with pytest.raises(ValueError):
        vectors.familiarity(species, "category_id", "other")
    with pytest.raises(ValueError):
        vectors.gaussian_distance(species, species, "category_id", True, "other")


def test_gaussian_distance_leaves_the_group_out(species):
    got = {r.category_id: r.value for r in vectors.gaussian_distance(species, species, "category_id", True, "frechet").collect()}
    rows = species.toPandas()
    stats = lambda v: (v.mean(axis=0), np.cov(v, rowvar=False))
    own = np.vstack(rows[rows.category_id == "loose"].vec)
    rest = np.vstack(rows[rows.category_id != "loose"].vec)
    assert abs(got["loose"] - vectors.frechet(stats(own), stats(rest))) < 1e-8 and got["single"] is None
    assert vectors.mmd_distance(species, species, "category_id", "vec_id", True).filter("value is null").count() == 1


def test_nearest_prototype_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(str(i), r.normal(size=4).tolist()) for i in range(25)]
    protos = nearest.prototypes(spark.createDataFrame(rows, "g string, vec array<double>"), "g")
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 6)
    got = {x.g: x.distance for x in nearest.nearest_prototype(protos, protos, "g", True).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = m @ m.T
    np.fill_diagonal(c, -2)
    assert all(abs(got[str(i)] - (1 - c[i].max())) < 1e-9 for i in range(25))
    alone = protos.filter("g = '0'")
    assert nearest.nearest_prototype(alone, alone, "g", True).first().distance is None


def logit(x):
    return 1 / (1 + np.exp(-x))


@pytest.fixture(scope="module")
def law(spark):
    """12 sites of 12 rows, 8 species: a planted law with noise."""
    r = np.random.default_rng(4)
    rows = []
    for site in range(12):
        env = r.uniform()
        for k in range(12):
            sp = int(r.integers(8))
            vis = sp / 8 + 0.1
            rows.append((f"sp{sp}", f"sp{sp}", f"site{site}", "2001", float(logit(1.5 - 4 * vis + r.normal(0, 0.25))), float(logit(2.5 - 4 * env + r.normal(0, 0.25))), int(r.integers(20, 300)), vis, env, float(site % 2), 7.0, None if k == 0 else vis))
    names = "category_id string, species string, location_id string, time string, pDetA double, pAssA double, n_frames long, vis double, env double, night double, flat double, gap double"
    return spark.createDataFrame(rows, names).cache()


FULL = models.Design("full", ("vis", "env", "flat", "gap"), ("night",), support=True)


def numpy_fit(pdf, target, design, weights=None):
    """Plain IRLS of one model."""
    pdf = pdf.loc[pdf.index.repeat(weights)] if weights is not None else pdf
    cols = [np.ones(len(pdf))]
    for c in design.continuous:
        v = pdf[c].to_numpy(float)
        sd = np.nanstd(v)
        cols.append(np.nan_to_num((v - np.nanmean(v)) / sd) if sd > 1e-12 else np.zeros(len(v)))
    if design.support:
        v = np.log1p(pdf["n_frames"].to_numpy(float))
        cols.append((v - v.mean()) / v.std())
    cols += [pdf[c].to_numpy(float) for c in design.binary]
    x, y, w, b = np.column_stack(cols), pdf[target].to_numpy(float), pdf["n_frames"].to_numpy(float), np.zeros(len(cols))
    for _ in range(60):
        mu = logit(x @ b)
        b = b + np.linalg.pinv((x.T * (w * mu * (1 - mu))) @ x) @ (x.T @ (w * (y - mu)))
    return b


def test_fit_matches_numpy_and_spark_ml(law):
    fits = models.fit_many(models.prepare(law, "pDetA", "n_frames", FULL, "category_id"), FULL)
    want = numpy_fit(law.toPandas(), "pDetA", FULL)
    assert math.isnan(fits.coef[0, 3]) and np.allclose(np.delete(fits.coef[0], 3), np.delete(want, 3), atol=1e-6)
    assert 0 < fits.pseudo_r2[0] < 1
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    d = models.Design("two", ("vis", "env"))
    own = models.fit_many(models.prepare(law, "pDetA", "n_frames", d, "category_id"), d)
    rows = VectorAssembler(inputCols=["vis", "env"], outputCol="features").transform(law)
    ml = GeneralizedLinearRegression(family="binomial", labelCol="pDetA", weightCol="n_frames", tol=1e-12, maxIter=50).fit(rows)
    assert np.allclose(own.coef[0, 1:] / own.scale[0], ml.coefficients.toArray(), atol=1e-6) and abs(own.deviance[0] - ml.summary.deviance) < 1e-6
    table = {r.term: r for r in models.coefficient_table(law.sparkSession, "pDetA", fits).collect()}
    assert "flat" not in table and table["vis"].coef < 0


def test_folds_and_draws_match_single_fits(law):
    ready = models.prepare(law, "pAssA", "n_frames", FULL, "location_id")
    groups = sorted({r.location_id for r in law.select("location_id").collect()})
    counts = np.column_stack([1 - np.eye(12, dtype=int)[:, :2], models.draw_counts(3, 2, 12)])
    fits = models.fit_many(ready, FULL, models.Counts(counts))
    folds = models.fit_many(ready, FULL, models.LeaveOut(np.arange(2)))
    assert np.allclose(folds.coef, fits.coef[:2], equal_nan=True) and np.allclose(folds.mean, fits.mean[:2], equal_nan=True) and np.allclose(folds.null_deviance, fits.null_deviance[:2])
    pdf = law.toPandas()
    for b in range(4):
        weights = pdf["location_id"].map({g: counts[k, b] for k, g in enumerate(groups)})
        want = numpy_fit(pdf, "pAssA", FULL, weights)
        assert np.allclose(np.delete(fits.coef[b], 3), np.delete(want, 3), atol=1e-5)


def test_draw_counts_match_spark(spark):
    got = np.zeros((9, 7), int)
    for r in models.bootstrap_draws(spark, 5, 7, 9).collect():
        got[r.g, r.b] = r.m
    assert np.array_equal(got, models.draw_counts(5, 7, 9))


def test_out_of_sample_gain(law):
    oos = grid.oos_predictions(law, "pAssA", "n_frames", models.Design("env", ("env",), support=True), "location_id", "location", ["category_id", "location_id"])
    summary = models.cv_summary(oos, ["group_scheme", "target"], 200).first()
    assert summary.n == 144 and summary.delta > 0 and summary.significant and summary.p_value < 0.05
    rows = oos.toPandas()
    delta = np.abs(rows.actual - rows.actual.mean()) - np.abs(rows.actual - rows.predicted)
    assert abs(delta.mean() - summary.delta) < 1e-9
    groups, counts = sorted(rows.group.unique()), models.draw_counts(0, 200, 12)
    boots = [np.concatenate([np.repeat(delta[rows.group == g].to_numpy(), 1) for k, g in enumerate(groups) for _ in range(counts[k, b])]).mean() for b in range(200)]
    assert abs(np.percentile(boots, 2.5) - summary.delta_lo) < 1e-9
    one = grid.oos_predictions(law.filter("location_id = 'site1'"), "pAssA", "n_frames", FULL, "location_id", "location", ["category_id"])
    assert one.count() == 0


def test_cluster_interval_is_wider_on_average(law):
    d = models.Design("env", ("env", "vis"), support=True)
    ci = {r.term: r for r in models.cluster_bootstrap(law, "pAssA", "n_frames", d, ["category_id", "location_id"], 60).collect()}
    naive = {r.term: r for r in models.coefficient_table(law.sparkSession, "pAssA", models.fit_many(models.prepare(law, "pAssA", "n_frames", d, "category_id"), d)).collect()}
    wide = np.mean([ci[t].ci_hi - ci[t].ci_lo for t in d.terms])
    assert wide >= np.mean([naive[t].ci_hi_naive - naive[t].ci_lo_naive for t in d.terms]) and ci["env"].ci_hi < 0


def test_shapley_shares_sum_to_r2(law):
    got = models.shapley_r2(law, "pAssA", ["env", "vis", "flat"]).collect()
    assert got[0].factor == "env" and got[-1].vif is None
    pdf = law.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.env, pdf.vis])
    fit = x @ np.linalg.lstsq(x, pdf.pAssA, rcond=None)[0]
    assert abs(sum(r.r2_share for r in got) - np.corrcoef(fit, pdf.pAssA)[0, 1] ** 2) < 1e-9


def test_associations(spark):
    rows = spark.createDataFrame([(f"s{k}", 0.1 * k, 0.05 + 0.11 * k + 0.01 * (k % 3), 12, float(k % 4)) for k in range(8)], "g string, x double, y double, w long, z double")
    r = association.bootstrap_corr(rows, "g", "x", "y", "w", 100).first()
    assert r.r > 0.9 and r.significant and r.ci_lo <= r.r and r.n == 8
    assert association.bootstrap_partial(rows, "g", "x", "y", "z", "w", 100).first().r > 0.9
    v = association.line_validation(rows, "g", "x", "y", "w", 100).first()
    assert v.n == 8 and v.delta > 0 and v.significant
    pdf = rows.toPandas()
    held = {x.g: x for x in association.leave_one_out_line(rows, "x", "y", "w").collect()}
    rest = pdf[pdf.g != "s3"]
    slope, cut = np.polyfit(rest.x, rest.y, 1)
    assert abs(held["s3"].predicted - (cut + slope * 0.3)) < 1e-9 and abs(held["s3"].base - rest.y.mean()) < 1e-9
    assert association.leave_one_out_line(rows.limit(4), "x", "y", "w").count() == 0
    band = association.calibration_band(rows, "g", "x", "y", points=5, draws=50).orderBy("x").collect()
    assert len(band) == 5 and all(b.lo <= b.fit + 0.05 and b.fit - 0.05 <= b.hi for b in band)
    few = association.bootstrap_corr(rows.limit(2), "g", "x", "y", "w", 20).first()
    assert few.r is None and not few.significant


def test_studies(law):
    designs = [models.Design("env", ("env",), support=True), models.Design("noise", ("flat",), support=True)]
    summary = studies.run_designs(law, designs, ["pAssA"], "n_frames", 100).cache()
    held = {r.design: r for r in studies.verdicts(summary, 2).collect()}
    assert held["env"].both_positive and not held["noise"].both_significant
    assert not studies.verdicts(summary.filter("group_scheme = 'species'"), 2).filter("both_positive").count()
    assert studies.size_carries(summary, "env", "noise").first().size_carries == held["env"].both_significant
    assert studies.head_to_head(summary, "env", "noise").filter("gain > 0").count() == 2
    assert studies.roll_up(summary, law, ["gap"]).filter("section = 'coverage'").first().value == 132.0


def test_false_positive_study(spark):
    r = np.random.default_rng(6)
    rows = [(f"s{s}", float(s), float(s % 3), int(r.uniform() < 0.05 + 0.11 * s), 1) for s in range(8) for _ in range(60)]
    fp = spark.createDataFrame(rows, "category_id string, d double, size double, fp int, n_pred long")
    out = studies.false_positive_study(fp, "d", "size", 50)
    assert out["species"].count() == 8 and out["correlation"].first().r > 0.8 and out["predictor"].first().n == 8
    assert out["terciles"].count() == 3 and out["partial"].first().r > 0.5 and 0 < out["overall"].first().fp_rate < 1


def test_reliability_scores(law):
    d = models.Design("env", ("env",), support=True)
    got = models.score_reliability(law.limit(5), law, "pAssA", "n_frames", d, "location_id", 20, ["category_id"]).collect()
    assert len(got) == 5 and all(r.lo <= r.hi and 0 < r.predicted < 1 for r in got)


def test_weighted_moments(spark):
    r = np.random.default_rng(7)
    x, w = r.normal(size=30), r.integers(1, 9, 30)
    y = 2 * x + r.normal(size=30)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w, strict=True)], "x double, y double, w long")
    cov = np.cov(x, y, aweights=w)
    assert abs(scoring.weighted_pearson(rows, "x", "y", "w").first().r - cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1])) < 1e-9
    slope, cut = np.polyfit(x, y, 1, w=np.sqrt(w))
    line = scoring.weighted_line(rows, "x", "y", "w").first()
    assert abs(line.slope - slope) < 1e-9 and abs(line.intercept - cut) < 1e-9
    assert scoring.agreement(rows.withColumn("z", F.col("x")), "x", "z").first().n_equal == 30
