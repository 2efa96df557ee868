"""Bootstraps of records by splitting, features joined by one job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.plans import association, models, studies


def test_slots_of_ranges_are_multinomial():
    sizes = np.array([700, 1, 300, 999, 50])
    upto = np.append(0, np.cumsum(sizes))
    got = np.array([association.range_slots(3, 4000, upto, k) for k in range(len(sizes))])
    assert (got.sum(axis=0) == upto[-1]).all() and (got >= 0).all()
    share = sizes / upto[-1]
    assert np.allclose(got.mean(axis=1), sizes, rtol=0.03, atol=0.1)
    assert np.allclose(np.cov(got), upto[-1] * (np.diag(share) - np.outer(share, share)), atol=0.08 * upto[-1] * share.max())


def split(spark, rows, width, **how):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    try:
        return sorted(tuple(r) for r in association.split_draws(rows, **how).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_draws_of_records(spark, monkeypatch):
    monkeypatch.setattr(association, "RANGE_ROWS", 100)
    rows = spark.range(0, 5000, numPartitions=3).select(F.lit(1.0).alias("one"), F.when(F.col("id") % 2 == 0, 1.0).alias("even"), (F.col("id") * 0 + F.col("id")).alias("x")).filter("x <> 17")
    got = split(spark, rows, "128m", draws=300, seed=4)
    assert [r[0] for r in got] == list(range(300)) and all(r[1] == r[4] == 4999 for r in got)
    even, x = np.array([r[2] for r in got]), np.array([r[3] for r in got]) / 4999
    assert abs(even.mean() - 2500) < 8 and 25 < even.std() < 46  # sqrt(n / 4) = 35
    assert abs(x.mean() - 2500) < 6 and 15 < x.std() < 27  # 1443 / sqrt(n) = 20
    assert association.split_draws(rows.limit(0), 5).count() == 0


def test_band_of_records_is_near_that_of_rows(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, float(p), float(0.2 + 0.5 * p + r.normal(0, 0.2))) for k, p in enumerate(r.uniform(size=400))], "k long, p double, a double")
    one, other = (association.calibration_band(rows, key, "p", "a", 5, 200).orderBy("x").collect() for key in ("k", None))
    for a, b in zip(one, other, strict=True):
        assert abs(a.x - b.x) < 1e-12 and abs(a.fit - b.fit) < 1e-12 and abs(a.lo - b.lo) < 0.02 and abs(a.hi - b.hi) < 0.02


def test_many_draws_are_counted_by_spark(spark, monkeypatch):
    want = models.draw_counts(2, 6, 11)
    monkeypatch.setattr(models, "LOCAL_SLOTS", 0)
    assert np.array_equal(models.counted_draws(spark, 2, 6, 11), want)


def test_features_are_joined_by_one_job(spark):
    cells = spark.createDataFrame([("s1", "s1", "l1", "1"), ("s2", "s2", "l1", "2"), (None, None, "l2", "3")], "category_id string, species string, location_id string, time string")
    a = spark.createDataFrame([("s1", 1.0, [1]), ("s3", 3.0, None)], "category_id string, a double, list array<int>")
    b = spark.createDataFrame([("l1", 5)], "location_id string, b int")
    got = {r.time: (r.a, r.list, r.b) for r in studies.merge_features(cells, [a], [b]).collect()}
    assert got == {"1": (1.0, [1], 5), "2": (None, None, 5), "3": (None, None, None)}
    for twice in (a.union(a), a.union(spark.createDataFrame([("s1", None, None)], a.schema))):
        with pytest.raises(ValueError, match="more than one row"):
            studies.merge_features(cells, [twice], [b])
