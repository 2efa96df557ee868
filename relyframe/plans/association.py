"""Bootstrapped associations: correlations, a leave-one-out line, and a calibration band.

Over group rows, draws are made by row: slot j of draw b takes row md5(seed:b:j) mod n of the rows in the order of their key, and the
drawn (b, row) pairs are joined and summed. Over records (``split_draws``) no pair is ever made: the n slots of a draw are
split down a tree of row ranges by binomial draws, each task derives how often its rows are taken, and hands on a row a draw.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.functions.scalars import ratio
from relyframe.operators.scoring import corr_of_moments, moments, partial_corr, weighted_pearson
from relyframe.plans.models import bootstrap_draws
from relyframe.sources.scratch import stored

#: Rows of a range whose draws are made together.
RANGE_ROWS = 16_384
_PAIR_NAMES = ("w", "wx", "wy", "wxx", "wyy", "wxy")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``g``, their place in the order of the key, which is unique.

    Rows are dealt to ranges of the key and written; each range is numbered from the count of those before it, so no window
    holds more than a range.
    """
    ranged = stored(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy(key)).cast("long") - 1
    return ranged.withColumn("g", place).join(F.broadcast(starts), "range").withColumn("g", F.col("g") + F.col("before")).drop("range", "before")


def _drawn(rows: DataFrame, key: str, draws: int, seed: int) -> tuple[DataFrame, int]:
    ranked = stored(numbered(rows, key))
    n = ranked.count()
    return bootstrap_draws(rows.sparkSession, seed, draws, n).join(ranked, "g"), n


def range_slots(seed: int, draws: int, upto: np.ndarray, leaf: int) -> np.ndarray:
    """How many of a draw's slots fall on a range, for all draws; ``upto`` has the number of rows before each range, and of all.

    Each node of the tree splits its slots in proportion to its children's rows by a generator of its own, so all tasks that pass
    it see the same numbers, and the ranges' slots are multinomial.
    """
    low, high, n = 0, len(upto) - 1, np.full(draws, upto[-1])
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(n, (upto[middle] - upto[low]) / (upto[high] - upto[low]))
        low, high, n = (low, middle, left) if leaf < middle else (middle, high, n - left)
    return n


def split_draws(rows: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(b, columns, m): of each draw of n of the n rows with replacement, the sums of all (numeric) columns and the number of rows.

    The rows are written once; a range is RANGE_ROWS rows of a file in their order, so the draws are those of the written table,
    however it is split among tasks. What is shuffled is a row a draw and task. The driver holds a number a file. Nulls count as
    zero; no rows give no draws.
    """
    names = rows.columns
    kept = stored(rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names)))
    placed = kept.select(*names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = {r["_file"]: r["count"] for r in placed.groupBy("_file").count().collect()}
    first, sizes = {}, []
    for name in sorted(files):
        first[name] = len(sizes)
        sizes += [min(RANGE_ROWS, files[name] - at) for at in range(0, files[name], RANGE_ROWS)]
    upto = np.append(0, np.cumsum(sizes)).astype(np.int64)

    def add(total: np.ndarray, leaf: int, places: np.ndarray, values: np.ndarray) -> None:
        n = int(upto[leaf + 1] - upto[leaf])
        generator = np.random.default_rng([seed, leaf])
        for b, slots in enumerate(range_slots(seed, draws, upto, leaf)):
            taken = np.bincount(generator.integers(0, n, slots), minlength=n)[places]
            total[b, :-1] += taken @ values
            total[b, -1] += taken.sum()

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = np.zeros((draws, len(names) + 1)), []

        def flush() -> None:
            if held:
                add(total, held[0][0], np.concatenate([h[1] for h in held]), np.vstack([h[2] for h in held]))
                held.clear()

        for pdf in batches:
            leaves = pdf["_file"].map(first).to_numpy(np.int64) + pdf["_row"].to_numpy() // RANGE_ROWS
            edges = np.append(np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])), len(pdf))
            values, places = pdf[names].to_numpy(float), pdf["_row"].to_numpy() % RANGE_ROWS
            for a, z in zip(edges, edges[1:], strict=False):
                if held and held[0][0] != leaves[a]:
                    flush()
                held.append((int(leaves[a]), places[a:z], values[a:z]))
        flush()
        if total[:, -1].any():
            yield pd.DataFrame(total, columns=[*names, "m"]).assign(b=np.arange(draws))[["b", *names, "m"]]

    parts = placed.mapInPandas(each, ", ".join(["b long", *(f"`{c}` double" for c in names), "m double"]))
    return parts.groupBy("b").agg(*(F.sum(c).alias(c) for c in names), F.sum("m").cast("long").alias("m"))


def bootstrap_corr(rows: DataFrame, key: str, x: str, y: str, w: str, draws: int, seed: int = 0) -> DataFrame:
    """(r, ci_lo, ci_hi, n, significant): weighted correlation and its interval over draws; nulls below 3 rows or without spread."""
    rows = rows.select(key, x, y, w).dropna()
    point = weighted_pearson(rows, x, y, w)
    drawn, n = _drawn(rows, key, draws, seed)
    weight = F.col(w).cast("double") * F.col("m")
    boots = drawn.groupBy("b").agg(*moments(F.col(x).cast("double"), F.col(y).cast("double"), weight)).select(corr_of_moments().alias("r"))
    ends = boots.agg(F.percentile("r", F.lit(0.025)).alias("ci_lo"), F.percentile("r", F.lit(0.975)).alias("ci_hi"))
    fit = F.lit(n >= 3) & F.col("r").isNotNull()
    both = point.crossJoin(ends)  # one row each
    lo, hi = F.when(fit, F.col("ci_lo")), F.when(fit, F.col("ci_hi"))
    return both.select(F.when(fit, F.col("r")).alias("r"), lo.alias("ci_lo"), hi.alias("ci_hi"), F.lit(n).cast("long").alias("n"), F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("significant"))


def bootstrap_partial(rows: DataFrame, key: str, x: str, y: str, z: str, w: str, draws: int, seed: int = 0) -> DataFrame:
    """The same for the partial correlation of x and y given z; nulls below 4 rows."""
    rows = rows.select(key, x, y, z, w).dropna()
    point = partial_corr(rows, x, y, z, w)
    drawn, n = _drawn(rows, key, draws, seed)
    weight, pairs, each = F.col(w).cast("double") * F.col("m"), {"xy": (x, y), "xz": (x, z), "yz": (y, z)}, []
    for name, (a, b) in pairs.items():
        each += [m.alias(f"{name}_{k}") for k, m in zip(_PAIR_NAMES, moments(F.col(a).cast("double"), F.col(b).cast("double"), weight), strict=True)]
    boots = drawn.groupBy("b").agg(*each)
    for name in pairs:
        boots = boots.withColumns({f"s_{k}": F.col(f"{name}_{k}") for k in _PAIR_NAMES}).withColumn(f"r_{name}", corr_of_moments())
    below = F.sqrt(F.greatest((1 - F.col("r_xz") * F.col("r_xz")) * (1 - F.col("r_yz") * F.col("r_yz")), F.lit(0.0)))
    boots = boots.select(((F.col("r_xy") - F.col("r_xz") * F.col("r_yz")) / F.nullif(below, F.lit(0.0))).alias("r"))
    ends = boots.agg(F.percentile("r", F.lit(0.025)).alias("ci_lo"), F.percentile("r", F.lit(0.975)).alias("ci_hi"))
    fit = F.lit(n >= 4) & F.col("r").isNotNull()
    lo, hi = F.when(fit, F.col("ci_lo")), F.when(fit, F.col("ci_hi"))
    return point.crossJoin(ends).select(F.when(fit, F.col("r")).alias("r"), lo.alias("ci_lo"), hi.alias("ci_hi"), F.lit(n).cast("long").alias("n"), F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("significant"))


def leave_one_out_line(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Rows (at least 5, with spread in x) with ``predicted`` by the weighted line of all others and ``base``, their weighted mean.

    Moments without a row are the total less the row's own, so there is one pass and no refit.
    """
    rows = rows.dropna(subset=[x, y, w])
    ok = rows.agg((F.count("*") >= 5) & (F.min(x) != F.max(x))).first()[0]
    rows = rows if ok else rows.limit(0)
    cx, cy, cw = (F.col(c).cast("double") for c in (x, y, w))
    total = rows.agg(*moments(cx, cy, cw))
    own = {"w": cw, "wx": cw * cx, "wy": cw * cy, "wxx": cw * cx * cx, "wxy": cw * cx * cy}
    left = rows.crossJoin(F.broadcast(total))  # one row of sums
    left = left.withColumns({f"l_{k}": F.col(f"s_{k}") - e for k, e in own.items()})
    det = F.col("l_w") * F.col("l_wxx") - F.col("l_wx") * F.col("l_wx")
    slope = F.coalesce((F.col("l_w") * F.col("l_wxy") - F.col("l_wx") * F.col("l_wy")) / F.nullif(F.when(det > 1e-12, det), F.lit(0.0)), F.lit(0.0))
    base = ratio(F.col("l_wy"), F.col("l_w"))
    return left.select(*rows.columns, (base + slope * (cx - ratio(F.col("l_wx"), F.col("l_w")))).alias("predicted"), base.alias("base"))


def line_validation(rows: DataFrame, key: str, x: str, y: str, w: str, draws: int, seed: int = 0) -> DataFrame:
    """(mae, baseline_mae, delta, ci_lo, ci_hi, p_value, significant, n): weighted gain of the leave-one-out line over the mean."""
    held = leave_one_out_line(rows.select(key, x, y, w), x, y, w)
    held = held.withColumns({"e": F.abs(F.col(y) - F.col("predicted")), "e0": F.abs(F.col(y) - F.col("base"))}).withColumn("d", F.col("e0") - F.col("e"))
    mean = lambda c: ratio(F.sum(F.col(w) * F.col(c)), F.sum(w))
    point = held.agg(mean("e").alias("mae"), mean("e0").alias("baseline_mae"), mean("d").alias("delta"), F.count("*").alias("n"))
    drawn, _ = _drawn(held.select(key, w, "d"), key, draws, seed)
    boots = drawn.groupBy("b").agg(ratio(F.sum(F.col("m") * F.col(w) * F.col("d")), F.sum(F.col("m") * F.col(w))).alias("d"))
    ends = boots.agg(F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi"), F.avg((F.col("d") <= 0).cast("double")).alias("p_value"))
    return point.crossJoin(ends).withColumn("significant", F.coalesce(F.col("ci_lo") > 0, F.lit(False)))


def calibration_band(rows: DataFrame, key: str | None, predicted: str, actual: str, points: int = 50, draws: int = 500, seed: int = 0) -> DataFrame:
    """(x, fit, lo, hi): least-squares line of actual on predicted over a grid, with its 5 to 95 % band over draws of rows.

    With a ``key`` the rows are few (groups) and draws follow their order; without, they are records and drawn by ``split_draws``.
    """
    rows = rows.select(*([key] if key else []), predicted, actual).dropna()
    one = F.lit(1.0)
    px, py = F.col(predicted).cast("double"), F.col(actual).cast("double")
    det = F.col("s_w") * F.col("s_wxx") - F.col("s_wx") * F.col("s_wx")
    slope = (F.col("s_w") * F.col("s_wxy") - F.col("s_wx") * F.col("s_wy")) / F.nullif(det, F.lit(0.0))
    line = lambda df: df.withColumn("slope", slope).withColumn("cut", (F.col("s_wy") - F.col("slope") * F.col("s_wx")) / F.col("s_w"))
    if key:
        drawn, _ = _drawn(rows, key, draws, seed)
        boots = line(drawn.groupBy("b").agg(*moments(px, py, F.col("m").cast("double"))))
    else:
        own = {"w": one, "wx": px, "wy": py, "wxx": px * px, "wxy": px * py}
        boots = line(split_draws(rows.select(*(c.alias(f"s_{k}") for k, c in own.items())), draws, seed))
    grid = rows.agg(F.min(predicted).alias("a"), F.max(predicted).alias("z")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("a") + (F.col("z") - F.col("a")) * k / (points - 1))).alias("x")
    )
    at = boots.select("slope", "cut").crossJoin(F.broadcast(grid)).withColumn("v", F.col("cut") + F.col("slope") * F.col("x"))  # draws times points
    band = at.groupBy("x").agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"))
    fit = line(rows.agg(*moments(px, py, one))).select("slope", "cut")
    return band.crossJoin(fit).select("x", (F.col("cut") + F.col("slope") * F.col("x")).alias("fit"), "lo", "hi")
