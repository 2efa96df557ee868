"""Probe, cell and dataset aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.functions.scalars import ratio, safe_corr
from relyframe.sources.scratch import stored

CELL = ["category_id", "species", "location_id", "time"]
METRICS = ["pDetA", "pAssA", "pHOTA"]


def probe_support(probes: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with ``n_frames`` (distinct annotated frames) and ``n_masklets``; zeros without any masklet.

    ``frames`` has a row a masklet and frame: keys, ann_id, frame_idx, and present (whether there is a mask).
    """
    counted = frames.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("present"), F.col("frame_idx"))).alias("n_frames"),
        F.count_distinct("ann_id").alias("n_masklets"),
    )
    joined = probes.join(counted, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_frames", "n_masklets")})


def with_metrics(probes: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with the evaluator's metrics of their keys; null where it has no row. ``metrics`` has a row a key."""
    return probes.join(metrics.select(*keys, *METRICS), keys, "left")


def score_cells(probes: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Cells: means of the metrics that exist, sums of support, and the number of probes, hard negatives included."""
    means = [F.avg(m).alias(m) for m in METRICS]
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_frames", "num_masklets")]
    return probes.groupBy(*cell).agg(*means, *sums, F.count("*").alias("n_videos"))


def weighted_means(cells: DataFrame, weight: str = "n_frames") -> DataFrame:
    """One row: weighted means of the metrics over scored cells (plain means where weights sum to zero), and counts."""
    scored = cells.filter("pDetA is not null")
    mean = lambda m: F.coalesce(ratio(F.sum(F.col(weight) * F.col(m)), F.sum(weight)), F.avg(m)).alias(m)
    means = scored.agg(*(mean(m) for m in METRICS), F.count("*").alias("n_scored"))
    return means.crossJoin(cells.agg(F.count("*").alias("n_cells")))  # one row each


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_real, n_rows) in one pass."""
    counts = rows.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"c_{c}") for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("n_real"), F.col("n_rows").alias("n_rows")) for c in columns))
    return counts.select(F.inline(each))


def score_counts(entries: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, score, n): how often each score occurs; a null score ran and found nothing. Counts of parts of the rows can be added."""
    return entries.groupBy(*cell, "score").agg(F.count("*").alias("n"))


def frame_sums(entries: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, covered, total): frames of the distinct probes. Sums of parts can be added where no probe is in two of them."""
    frames = entries.select(*cell, "probe", "covered", "total").distinct().groupBy(*cell)
    return frames.agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))


def confidence_cells(entries: DataFrame, threshold: float | Column, cell: list[str]) -> DataFrame:
    """Confidence of cells from prediction rows (cell, probe, score, covered, total; null score: ran and found nothing).

    ``conf_share`` of masklets at or above the threshold, mean, exact median, and covered over total frames; an
    inferred cell without masklets gives zeros.
    """
    return confidence_of_counts(score_counts(entries, cell), frame_sums(entries, cell), threshold, cell)


def confidence_of_counts(counts: DataFrame, frames: DataFrame, threshold: float | Column, cell: list[str]) -> DataFrame:
    """``confidence_cells`` from sums of ``score_counts`` and ``frame_sums``; several rows of one score or cell are added."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    counts = stored(counts.groupBy(*cell, "score").agg(F.sum("n").alias("n")))
    real = F.when(F.col("score").isNotNull(), F.col("n"))
    scores = counts.groupBy(*cell).agg(
        ratio(F.sum(F.when(F.col("score") >= threshold, F.col("n"))), F.sum(real)).alias("conf_share"),
        ratio(F.sum(F.col("score") * F.col("n")), F.sum(real)).alias("conf_mean"),
    )
    medians = grouped_quantile(counts, cell, "score", 0.5).withColumnRenamed("quantile", "conf_median")
    frames = frames.groupBy(*cell).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    joined = scores.join(frames, cell).join(medians, cell, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *cell, zero(F.col("conf_share")).alias("conf_share"), zero(F.col("conf_mean")).alias("conf_mean"),
        zero(F.col("conf_median")).alias("conf_median"), zero(ratio(F.col("covered"), F.col("total"))).alias("conf_coverage"),
    )


#: Distinct values of a group up to which one aggregate holds them, and parts into which a larger group's range is cut in each pass.
GROUP_VALUES, RANGE_PARTS = 65_536, 4_096


def grouped_quantile(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, quantile): the exact interpolated quantile of each group of (keys, value, n) rows, nulls left out.

    ``counts`` has a row a group and value, and should be stored. Groups with more than GROUP_VALUES values are never brought
    together: all of them are narrowed at once, by counts of RANGE_PARTS parts of the range in which the asked rank lies, until
    that range is one value. A part is a map-side sum, and each pass divides the range.
    """
    counts = counts.select(*keys, F.col(value).cast("double").alias("v"), "n").filter("v is not null")
    sizes = stored(counts.groupBy(*keys).agg(F.count("*").alias("values"), F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")))
    large = sizes.filter(F.col("values") > GROUP_VALUES)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    if large.isEmpty():
        return counts.groupBy(*keys).agg(F.percentile("v", F.lit(share), F.col("n")).alias("quantile"))
    small = counts.join(large, same(counts, large), "left_anti").groupBy(*keys).agg(F.percentile("v", F.lit(share), F.col("n")).alias("quantile"))
    place = F.lit(share) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    zero = F.lit(0).cast("long")
    asked = stored(large.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(ranks).alias("rank"), "low", "high", zero.alias("before"), place.alias("place")))
    of = [f"_{k}" for k in keys]
    while not asked.filter("low < high").isEmpty():
        done = asked.filter("low >= high")
        met = counts.join(asked.filter("low < high"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).filter("v between low and high")
        # Halves first, so that a range of all doubles doesn't overflow.
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGE_PARTS), F.lit(RANGE_PARTS - 1))
        parts = met.groupBy(*of, "rank", "before", "place", part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*of, "rank").orderBy("part")) + F.col("before")
        found = parts.withColumn("upto", upto).filter("rank < upto and rank >= upto - n")
        asked = stored(done.union(found.select(*of, "rank", "low", "high", (F.col("upto") - F.col("n")).alias("before"), "place")))
    first, last = F.min_by("low", "rank"), F.max_by("low", "rank")
    share_of = F.max("place") - F.min("rank")
    ends = asked.groupBy(*of).agg((first + (last - first) * share_of).alias("quantile"))
    return small.union(ends.select(*(F.col(f"_{k}").alias(k) for k in keys), "quantile"))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Exact interpolated quantiles of a column's values, nulls left out; None without any value.

    Equal values are counted first, then dealt to ranges; only the ranges that hold an asked rank are numbered. The driver
    gets two numbers a share.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranged = stored(values.repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    sizes = {r.range: r.n for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()}
    total, starts, before = sum(sizes.values()), {}, 0
    for k, n in sizes.items():
        starts[k], before = before, before + n
    if not total:
        return None
    asked = [s * (total - 1) for s in shares]
    ranks = sorted({r for a in asked for r in (math.floor(a), math.ceil(a))})
    held = sorted({k for r in ranks for k in sizes if starts[k] <= r < starts[k] + sizes[k]})
    start = F.element_at(F.create_map(*(F.lit(x) for k in held for x in (k, starts[k]))), F.col("range"))
    ends = ranged.filter(F.col("range").isin(held)).withColumn("end", F.sum("n").over(Window.partitionBy("range").orderBy("v")) + start)
    wanted = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))
    at = {r.rank: r.v for r in ends.select("v", F.explode(wanted).alias("rank")).collect()}
    return [at[math.floor(a)] + (at[math.ceil(a)] - at[math.floor(a)]) * (a - math.floor(a)) for a in asked]


def atc_threshold(reference_scores: DataFrame, anchor: float | None) -> DataFrame:
    """(threshold): the (1 - anchor) quantile of reference scores; 0.5 without scores or anchor."""
    if anchor is None:
        return reference_scores.agg(F.lit(0.5).alias("threshold"))
    found = quantiles(reference_scores, "score", [1 - min(max(anchor, 0.0), 1.0)])
    return reference_scores.sparkSession.range(1).select(F.lit(found[0] if found else 0.5).alias("threshold"))


def false_positives(negatives: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """Hard negatives that were run: ``max_score``, ``n_pred`` and ``fp``; a probe without a prediction row is left out.

    ``predictions`` has (probe, scores), an array that is empty where nothing was found.
    """
    joined = negatives.join(predictions, "probe")
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    return joined.select(negatives["*"], top.alias("max_score"), F.size("scores").cast("long").alias("n_pred"), (top >= threshold).cast("int").alias("fp"))


def fp_by_species(fp: DataFrame) -> DataFrame:
    return fp.groupBy("category_id").agg(F.avg("fp").alias("fp_rate"), F.count("*").alias("n"), F.min("distance").alias("distance"))


def fp_overall(fp: DataFrame) -> DataFrame:
    return fp.agg(F.avg("fp").alias("fp_rate"), F.avg((F.col("n_pred") > 0).cast("int")).alias("any_rate"), F.count("*").alias("n"))


def quantile_bins(rows: DataFrame, x: str, y: str, q: int = 3) -> DataFrame:
    """(bin, n, y mean) by quantiles of x, right-closed, the lowest included; equal edges are one. No rows below q rows or two values."""
    rows = rows.filter(F.col(x).isNotNull())
    edges = list(dict.fromkeys(quantiles(rows, x, [k / q for k in range(q + 1)]) or []))
    if len(edges) < 2 or rows.limit(q).count() < q:
        rows, edges = rows.limit(0), [0.0, 0.0]
    binned = rows.withColumn("bin", sum((F.col(x) > e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias(y))


def moments(x: Column, y: Column, w: Column) -> list[Column]:
    """Aggregates of weighted moments, over rows where all are present."""
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull()
    sums = {"w": w, "wx": w * x, "wy": w * y, "wxx": w * x * x, "wyy": w * y * y, "wxy": w * x * y}
    return [F.sum(F.when(ok, e)).alias(f"s_{k}") for k, e in sums.items()]


def corr_of_moments() -> Column:
    """Weighted Pearson from the moment columns; null without spread."""
    s = {k: F.col(f"s_{k}") for k in ("w", "wx", "wy", "wxx", "wyy", "wxy")}
    mx, my = ratio(s["wx"], s["w"]), ratio(s["wy"], s["w"])
    vx, vy = ratio(s["wxx"], s["w"]) - mx * mx, ratio(s["wyy"], s["w"]) - my * my
    return F.when((vx > 1e-15) & (vy > 1e-15), (ratio(s["wxy"], s["w"]) - mx * my) / F.sqrt(vx * vy))


def weighted_pearson(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    return rows.agg(*moments(*(F.col(c).cast("double") for c in (x, y, w)))).select(corr_of_moments().alias("r"))


def weighted_line(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """(slope, intercept) of the weighted least-squares line; nulls without spread in x."""
    s = rows.agg(*moments(*(F.col(c).cast("double") for c in (x, y, w))))
    below = F.nullif(F.col("s_w") * F.col("s_wxx") - F.col("s_wx") * F.col("s_wx"), F.lit(0.0))
    slope = (F.col("s_w") * F.col("s_wxy") - F.col("s_wx") * F.col("s_wy")) / below
    return s.select(slope.alias("slope"), ((F.col("s_wy") - slope * F.col("s_wx")) / F.nullif(F.col("s_w"), F.lit(0.0))).alias("intercept"))


def partial_corr(rows: DataFrame, x: str, y: str, z: str, w: str) -> DataFrame:
    """Weighted partial correlation of x and y given z, from three weighted correlations over rows with all of them."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull() & F.col(w).isNotNull())
    pairs = {"xy": (x, y), "xz": (x, z), "yz": (y, z)}
    each = []
    for name, (a, b) in pairs.items():
        each += [m.alias(f"{name}_{k}") for k, m in zip(("w", "wx", "wy", "wxx", "wyy", "wxy"), moments(*(F.col(c).cast("double") for c in (a, b, w))), strict=True)]
    s = rows.agg(*each)
    for name in pairs:
        part = s
        for k in ("w", "wx", "wy", "wxx", "wyy", "wxy"):
            part = part.withColumn(f"s_{k}", F.col(f"{name}_{k}"))
        s = part.withColumn(f"r_{name}", corr_of_moments())
    below = F.sqrt((1 - F.col("r_xz") * F.col("r_xz")) * (1 - F.col("r_yz") * F.col("r_yz")))
    return s.select(((F.col("r_xy") - F.col("r_xz") * F.col("r_yz")) / F.nullif(below, F.lit(0.0))).alias("r"))


def correlations(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, target, r, n) for each pair, in one aggregate."""
    pairs = [(f, t) for f in features for t in targets]
    both = lambda f, t: F.count(F.when(F.col(f).isNotNull() & F.col(t).isNotNull(), 1))
    wide = rows.agg(*(F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), safe_corr(f, t).alias("r"), both(f, t).alias("n")).alias(f"p{k}") for k, (f, t) in enumerate(pairs)))
    return wide.select(F.inline(F.array(*(F.col(f"p{k}") for k in range(len(pairs))))))


def group_mean_corr(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Correlation of the group means of x and y."""
    return rows.groupBy(group).agg(F.avg(x).alias(x), F.avg(y).alias(y)).agg(safe_corr(x, y).alias("r"))


def within_fraction(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Share of x's variance that is left within groups; null without spread."""
    rows = rows.filter(F.col(x).isNotNull())
    means = rows.groupBy(group).agg(F.avg(x).alias("_mean"))
    left = rows.join(means, group).withColumn("_left", F.col(x) - F.col("_mean"))
    return left.agg(F.when(F.min(x) != F.max(x), F.var_samp("_left") / F.nullif(F.var_samp(x), F.lit(0.0))).alias("fraction"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, mean absolute difference, and rows that are equal within 1e-8 + 1e-5 |b|."""
    gap = F.abs(F.col(a) - F.col(b))
    near = F.count_if(gap <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(b)))
    return rows.agg(safe_corr(a, b).alias("r"), F.avg(gap).alias("mean_gap"), near.alias("n_equal"), F.count("*").alias("n"))
