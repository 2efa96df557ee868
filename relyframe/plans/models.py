"""Many weighted fractional-logit models over one table, in shared scans.

A model is a design and a multiplicity for each group: all but one group for a fold, counts for a bootstrap draw. The
prepared rows are written once; each iteration is one scan of them in which every batch adds its part of X'WX, X'Wz and the
deviance for all models, summed by map-side aggregates. The driver holds coefficients, a row a group, the draws' counts, and
p-by-p sums: its bounds are MOST_GROUPS groups and the number of models, not rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.functions.scalars import number, unit, weight
from relyframe.sources.scratch import stored

#: Groups whose sums and coefficients the driver holds; for more, a caller folds whole groups by hash.
MOST_GROUPS = 20_000
#: Models that one scan handles.
MODEL_BLOCK = 256
MAX_ITERATIONS, TOLERANCE = 25, 1e-8


@dataclass(frozen=True)
class Design:
    """Predictors of a model: standardized columns, 0/1 columns, and log support."""

    name: str
    continuous: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    support: bool = False

    @property
    def terms(self) -> list[str]:
        return ["const", *self.continuous, *(["log_support"] if self.support else []), *self.binary]


@dataclass
class Fits:
    """Results by model (axis 0) and term (axis 1); a term that a model lacks is NaN in ``coef``."""

    design: Design
    coef: np.ndarray
    cov: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    deviance: np.ndarray
    null_deviance: np.ndarray
    ok: np.ndarray
    groups: list[str] = field(default_factory=list)

    @property
    def pseudo_r2(self) -> np.ndarray:
        return np.where(self.null_deviance > 0, 1 - self.deviance / np.where(self.null_deviance > 0, self.null_deviance, 1), 0.0)


@dataclass(frozen=True)
class Counts:
    """How often each model (axis 1) takes each group (axis 0)."""

    matrix: np.ndarray

    @property
    def n_models(self) -> int:
        return self.matrix.shape[1]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The groups' sums of each model."""
        return self.matrix.T @ x

    def take(self, models: np.ndarray | slice) -> Counts:
        return Counts(self.matrix[:, models])

    def of(self, group: np.ndarray, model: int) -> np.ndarray:
        return self.matrix[group, model]


@dataclass(frozen=True)
class LeaveOut:
    """Models that take every group once but one: the index that each holds out, and no matrix."""

    held: np.ndarray

    @property
    def n_models(self) -> int:
        return len(self.held)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return x.sum() - x[self.held]

    def take(self, models: np.ndarray | slice) -> LeaveOut:
        return LeaveOut(self.held[models])

    def of(self, group: np.ndarray, model: int) -> np.ndarray:
        return (group != self.held[model]).astype(np.int64)


def draw_counts(seed: int, draws: int, n_groups: int) -> np.ndarray:
    """How often each draw (axis 1) takes each group (axis 0); slot j of draw b takes group md5(seed:b:j) mod n_groups."""
    out = np.zeros((n_groups, draws), np.int64)
    for b in range(draws):
        taken = [int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) % n_groups for j in range(n_groups)]
        np.add.at(out[:, b], taken, 1)
    return out


#: Slots of all draws up to which the driver counts them itself.
LOCAL_SLOTS = 200_000


def counted_draws(spark: SparkSession, seed: int, draws: int, n_groups: int) -> np.ndarray:
    """``draw_counts``, made by Spark where they are many: a number for each group and draw comes back."""
    if draws * n_groups <= LOCAL_SLOTS:
        return draw_counts(seed, draws, n_groups)
    out, made = np.zeros((n_groups, draws), np.int64), bootstrap_draws(spark, seed, draws, n_groups).toPandas()
    out[made["g"].to_numpy(int), made["b"].to_numpy(int)] = made["m"].to_numpy(int)
    return out


def bootstrap_draws(spark: SparkSession, seed: int, draws: int, n_groups: int) -> DataFrame:
    """(b, g, m): the same counts as a table, made by Spark."""
    slots = spark.range(draws * n_groups).select(
        (F.col("id") / n_groups).cast("long").alias("b"), F.pmod("id", F.lit(n_groups)).alias("j")
    )
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "j")), 1, 8)
    slots = slots.withColumn("g", F.conv(hexed, 16, 10).cast("long") % n_groups)
    return slots.groupBy("b", "g").agg(F.count("*").alias("m"))


def prepare(rows: DataFrame, target: str, support: str | None, design: Design, group: str, extra: list[str] = ()) -> DataFrame:
    """Scored rows with y (clipped), w, predictors as doubles x0.. (support logged), and the group as text ``grp``."""
    raw = [number(F.col(c)) for c in design.continuous]
    raw += [F.log1p(number(F.col(support)))] if design.support else []
    raw += [F.coalesce(number(F.col(c).cast("double")), F.lit(0.0)) for c in design.binary]
    w = weight(F.col(support)) if support else F.lit(1.0)
    y = unit(number(F.col(target)))
    out = rows.select(*extra, y.alias("y"), w.alias("w"), *(c.alias(f"x{k}") for k, c in enumerate(raw)), F.col(group).cast("string").alias("grp"))
    return out.filter("y is not null and coalesce(grp, '') <> ''")


def _moments(rows: DataFrame, design: Design) -> pd.DataFrame:
    """A row a group: counts, sums and squares of each predictor about a common centre, and w, wy."""
    n = len(design.terms) - 1
    centre = rows.agg(*(F.avg(f"x{k}").alias(f"c{k}") for k in range(n)), F.lit(0).alias("_")).first()
    centred = [(F.col(f"x{k}") - F.lit(centre[f"c{k}"] or 0.0)) for k in range(n)]
    sums = [a for k, c in enumerate(centred) for a in (F.count(f"x{k}").alias(f"n{k}"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{k}"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias(f"q{k}"))]
    out = rows.groupBy("grp").agg(*sums, F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count("*").alias("rows")).orderBy("grp").toPandas()
    out.attrs["centre"] = [centre[f"c{k}"] or 0.0 for k in range(n)]
    return out


def _standard(moments: pd.DataFrame, counts: Counts | LeaveOut, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each predictor in each model; a scale of NaN leaves the term out."""
    n_cont, n = len(design.continuous), len(design.terms) - 1
    mean, scale = np.zeros((counts.n_models, n)), np.ones((counts.n_models, n))
    for k in range(n_cont + design.support):
        number_, total, square = (counts.sums(moments[f"{p}{k}"].to_numpy(float)) for p in "nsq")
        with np.errstate(all="ignore"):
            m = np.where(number_ > 0, total / number_, 0.0)
            sd = np.sqrt(np.maximum(np.where(number_ > 0, square / number_, 0.0) - m * m, 0.0))
        flat = sd <= 1e-12 * (1 + np.abs(m))
        mean[:, k] = m + moments.attrs["centre"][k]
        scale[:, k] = np.where(flat, np.nan if k < n_cont else 1.0, sd)
    return mean, scale


def _design_matrix(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Intercept and standardized predictors of one model; missing values at the mean, left-out terms at zero."""
    z = (x - mean) / np.where(np.isnan(scale), np.inf, scale)
    return np.column_stack([np.ones(len(x)), np.nan_to_num(z)])


def fit_many(rows: DataFrame, design: Design, counts: Counts | LeaveOut | None = None) -> Fits:
    """All models of one design over prepared rows; ``counts`` has the groups in their order. The rows should be stored."""
    moments = _moments(rows, design)
    if len(moments) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: fold them by hash first")
    names = moments["grp"].tolist()
    counts = Counts(np.ones((len(names), 1), np.int64)) if counts is None else counts
    mean, scale = _standard(moments, counts, design)
    n_models, p = counts.n_models, len(design.terms)
    coef, cov = np.zeros((n_models, p)), np.zeros((n_models, p, p))
    deviance, ok = np.full(n_models, np.nan), np.ones(n_models, bool)
    weights = counts.sums(moments["w"].to_numpy(float))
    with np.errstate(all="ignore"):
        base = np.where(weights > 0, counts.sums(moments["wy"].to_numpy(float)) / weights, np.nan)
    null_deviance = np.full(n_models, np.nan)
    for at in range(0, n_models, MODEL_BLOCK):
        part = slice(at, at + MODEL_BLOCK)
        got = _newton(rows, names, counts.take(part), mean[part], scale[part], base[part], p)
        coef[part], cov[part], deviance[part], null_deviance[part], ok[part] = got
    coef[:, 1:][np.isnan(scale)] = np.nan
    coef[~ok] = np.nan
    return Fits(design, coef, cov, mean, scale, deviance, null_deviance, ok, names)


def _newton(rows: DataFrame, names: list[str], counts: Counts | LeaveOut, mean: np.ndarray, scale: np.ndarray, base: np.ndarray, p: int):
    n_models = counts.n_models
    coef, open_, last = np.zeros((n_models, p)), np.arange(n_models), np.full(n_models, np.inf)
    info, deviance, null = np.zeros((n_models, p, p)), np.full(n_models, np.nan), np.full(n_models, np.nan)
    place = {g: k for k, g in enumerate(names)}
    for _ in range(MAX_ITERATIONS):
        sums = _scan(rows, place, counts.take(open_), mean[open_], scale[open_], base[open_], coef[open_], p)
        info[open_], grad = sums[:, : p * p].reshape(-1, p, p), sums[:, p * p : p * p + p]
        deviance[open_], null[open_] = sums[:, -2], sums[:, -1]
        for k, m in enumerate(open_):
            if np.isfinite(info[m]).all() and np.isfinite(grad[k]).all():
                coef[m] = coef[m] + np.linalg.pinv(info[m]) @ grad[k]
        settled = np.abs(last[open_] - deviance[open_]) <= TOLERANCE * (np.abs(deviance[open_]) + 0.1)
        last[open_] = deviance[open_]
        open_ = open_[~settled & np.isfinite(deviance[open_])]
        if not len(open_):
            break
    ok = np.isfinite(coef).all(axis=1) & np.isfinite(deviance) & (counts.sums(np.ones(len(names))) > 0)
    cov = np.stack([np.linalg.pinv(i) if np.isfinite(i).all() else np.full((p, p), np.nan) for i in info])
    return coef, cov, deviance, null, ok


def _bernoulli(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        one = np.where(y > 0, y * np.log(y / mu), 0.0)
        return 2 * (one + np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0.0))


def _scan(rows: DataFrame, place: dict, counts: Counts | LeaveOut, mean: np.ndarray, scale: np.ndarray, base: np.ndarray, coef: np.ndarray, p: int) -> np.ndarray:
    """Sums of all models: information, gradient, deviance, null deviance."""
    n_models, width = counts.n_models, p * p + p + 2

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_models, width))
        for pdf in batches:
            y, w = pdf["y"].to_numpy(float), pdf["w"].to_numpy(float)
            x = pdf[[f"x{k}" for k in range(p - 1)]].to_numpy(float) if p > 1 else np.empty((len(y), 0))
            g = pdf["grp"].map(place).to_numpy(int)
            for b in range(n_models):
                own = counts.of(g, b) * w
                used = own > 0
                if not used.any():
                    continue
                z, yy, ww = _design_matrix(x[used], mean[b], scale[b]), y[used], own[used]
                mu = np.clip(1 / (1 + np.exp(-np.clip(z @ coef[b], -700, 700))), 1e-12, 1 - 1e-12)
                v = ww * mu * (1 - mu)
                total[b, : p * p] += (z.T @ (z * v[:, None])).ravel()
                total[b, p * p : -2] += z.T @ (ww * (yy - mu))
                total[b, -2] += (ww * _bernoulli(yy, mu)).sum()
                total[b, -1] += (ww * _bernoulli(yy, np.clip(base[b], 1e-12, 1 - 1e-12))).sum()
        ids = np.arange(n_models * width)
        yield pd.DataFrame({"i": ids, "v": total.ravel()})

    parts = rows.select("y", "w", *(f"x{k}" for k in range(p - 1)), "grp").mapInPandas(partial, "i long, v double")
    got = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(n_models * width)
    out[got["i"].to_numpy(int)] = got["v"].to_numpy(float)
    return out.reshape(n_models, width)


def _p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def coefficient_table(spark: SparkSession, target: str, fits: Fits) -> DataFrame:
    """(target, term, coef, std_err, z, p_value, ci_lo_naive, ci_hi_naive, deviance, null_deviance, pseudo_r2) of one model."""
    rows = []
    for k, term in enumerate(fits.design.terms):
        c, se = float(fits.coef[0, k]), math.sqrt(max(float(fits.cov[0, k, k]), 0.0))
        if not math.isnan(c):
            z = c / se if se else None
            rows.append((target, term, c, se, z, _p_value(z) if z is not None else None, c - 1.959963984540054 * se, c + 1.959963984540054 * se, float(fits.deviance[0]), float(fits.null_deviance[0]), float(fits.pseudo_r2[0])))
    names = "target string, term string, coef double, std_err double, z double, p_value double, ci_lo_naive double, ci_hi_naive double, deviance double, null_deviance double, pseudo_r2 double"
    return spark.createDataFrame(rows, names)


def cluster_bootstrap(rows: DataFrame, target: str, support: str | None, design: Design, group_cols: list[str], draws: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(term, ci_lo, ci_hi): percentile intervals over whole-group draws, refitted with their own standardization.

    Of several grouping columns the widest interval counts; columns with fewer than two groups are skipped; failed
    fits and terms that a draw lacks are ignored.
    """
    found = []
    for col in group_cols:
        ready = stored(prepare(rows, target, support, design, col))
        n = ready.select("grp").distinct().count()
        if n < 2:
            continue
        fits = fit_many(ready, design, Counts(counted_draws(rows.sparkSession, seed, draws, n)))
        with np.errstate(all="ignore"):
            ends = np.nanquantile(fits.coef, [alpha / 2, 1 - alpha / 2], axis=0)
        found.append(ends)
    spark, names = rows.sparkSession, "term string, ci_lo double, ci_hi double"
    if not found:
        return spark.createDataFrame([], names)
    lo, hi = np.nanmin([f[0] for f in found], axis=0), np.nanmax([f[1] for f in found], axis=0)
    clean = lambda x: None if math.isnan(x) else float(x)
    return spark.createDataFrame([(t, clean(a), clean(b)) for t, a, b in zip(design.terms, lo, hi, strict=True)], names)


def cv_summary(oos: DataFrame, by: list[str], draws: int, seed: int = 0) -> DataFrame:
    """(by, n, mae, baseline_mae, delta, delta_lo, delta_hi, p_value, significant) over predicted rows.

    The baseline is the plain mean of all predicted rows' actuals. The gain's interval and one-sided p come from draws
    of whole groups, over one (sum, count) row a group; nulls below two groups.
    """
    done = stored(oos.filter("predicted is not null"))
    means = done.groupBy(*by).agg(F.avg("actual").alias("base"))
    errors = done.join(means, by).withColumns({"e": F.abs(F.col("actual") - F.col("predicted")), "e0": F.abs(F.col("actual") - F.col("base"))})
    summary = errors.groupBy(*by).agg(F.count("*").alias("n"), F.avg("e").alias("mae"), F.avg("e0").alias("baseline_mae"), F.avg(F.col("e0") - F.col("e")).alias("delta"))
    groups = errors.groupBy(*by, "group").agg(F.sum(F.col("e0") - F.col("e")).alias("s"), F.count("*").alias("c"))
    return summary.join(paired_bootstrap(groups, by, draws, seed), by, "left")


def paired_bootstrap(groups: DataFrame, by: list[str], draws: int, seed: int = 0) -> DataFrame:
    """(by, delta_lo, delta_hi, p_value, significant) from (by, group, s, c) rows: draws of whole groups.

    Groups are numbered in their order; slot j of draw b takes group md5(seed:b:j) mod n. The slots of a draw are counted by
    group, joined with the groups and summed, so no task holds more than one of many draws.
    """
    numbered = stored(groups.withColumn("g", F.row_number().over(Window.partitionBy(*by).orderBy("group")).cast("long") - 1))
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    slots = sizes.withColumn("b", each(F.lit(draws).cast("long"))).repartition(*by, "b").withColumn("j", each(F.col("n")))
    slots = slots.withColumn("g", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "j")), 1, 8), 16, 10).cast("long") % F.col("n"))
    taken = slots.groupBy(*by, "b", "g").agg(F.count("*").alias("m")).join(numbered, [*by, "g"])
    boots = taken.groupBy(*by, "b").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("c"))).alias("d"))
    low = F.percentile("d", F.lit(0.025))
    return boots.groupBy(*by).agg(
        low.alias("delta_lo"), F.percentile("d", F.lit(0.975)).alias("delta_hi"),
        F.avg((F.col("d") <= 0).cast("double")).alias("p_value"), (low > 0).alias("significant"),
    )


def gram(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation matrix over rows with all columns: one pass, p-by-p numbers; NaN for constant columns."""
    rows = rows.select(*(number(F.col(c)).alias(f"v{k}") for k, c in enumerate(columns))).dropna()
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(*(F.covar_pop(f"v{i}", f"v{j}").alias(f"s{i}_{j}") for i, j in pairs)).first()
    cov = np.full((p, p), np.nan)
    for i, j in pairs:
        if got[f"s{i}_{j}"] is not None:
            cov[i, j] = cov[j, i] = got[f"s{i}_{j}"]
    sd = np.sqrt(np.where(np.diag(cov) > 1e-15, np.diag(cov), np.nan))
    return cov / np.outer(sd, sd)


def shapley_r2(rows: DataFrame, target: str, factors: list[str]) -> DataFrame:
    """(factor, r2_share, share, vif), largest share first: LMG shares of the R2 of least squares over all subsets.

    A constant factor has share zero and a null vif.
    """
    corr = gram(rows, [*factors, target])
    used = [k for k in range(len(factors)) if np.isfinite(corr[k, k])]
    r2: dict[frozenset, float] = {}
    for mask in range(1 << len(used)):
        chosen = [used[k] for k in range(len(used)) if mask >> k & 1]
        a, b = corr[np.ix_(chosen, chosen)], corr[chosen, -1]
        r2[frozenset(chosen)] = float(b @ np.linalg.pinv(a) @ b) if chosen and np.isfinite(b).all() else 0.0
    shares = np.zeros(len(factors))
    for k in used:
        rest = [u for u in used if u != k]
        for mask in range(1 << len(rest)):
            s = frozenset(rest[i] for i in range(len(rest)) if mask >> i & 1)
            share = math.factorial(len(s)) * math.factorial(len(used) - len(s) - 1) / math.factorial(len(used))
            shares[k] += share * (r2[s | {k}] - r2[s])
    inverse = np.linalg.pinv(corr[np.ix_(used, used)]) if used else np.empty((0, 0))
    vif = {k: float(inverse[i, i]) for i, k in enumerate(used)}
    total = shares.sum()
    out = [(f, float(shares[k]), float(shares[k] / total) if total > 0 else None, vif.get(k)) for k, f in enumerate(factors)]
    out.sort(key=lambda r: (-r[1], r[0]))
    return rows.sparkSession.createDataFrame(out, "factor string, r2_share double, share double, vif double")


def contrast(spark: SparkSession, by_target: dict[str, Fits]) -> DataFrame:
    """(term, one column a target): coefficients side by side."""
    long = [(t, term, float(f.coef[0, k])) for t, f in by_target.items() for k, term in enumerate(f.design.terms) if np.isfinite(f.coef[0, k])]
    return spark.createDataFrame(long, "target string, term string, coef double").groupBy("term").pivot("target", list(by_target)).agg(F.first("coef"))


def score_reliability(queries: DataFrame, table: DataFrame, target: str, support: str | None, design: Design, group: str, draws: int, keep: list[str], seed: int = 0) -> DataFrame:
    """(keep, predicted, lo, hi) of each query row: the fitted score and a 95 % range over whole-group draws."""
    ready = stored(prepare(table, target, support, design, group))
    point = fit_many(ready, design)
    spread = fit_many(ready, design, Counts(counted_draws(table.sparkSession, seed, draws, len(point.groups))))
    asked = queries.withColumn("_y", F.lit(0.0)).withColumn("_g", F.lit("query"))
    asked = prepare(asked, "_y", support, design, "_g", keep)
    p, good = len(design.terms), np.flatnonzero(spread.ok)

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"x{k}" for k in range(p - 1)]].to_numpy(float)
            at = lambda f, b: 1 / (1 + np.exp(-_design_matrix(x, f.mean[b], f.scale[b]) @ np.nan_to_num(f.coef[b])))
            many = np.stack([at(spread, b) for b in good]) if len(good) else np.full((1, len(x)), np.nan)
            lo, hi = np.quantile(many, [0.025, 0.975], axis=0)
            yield pdf[keep].assign(predicted=at(point, 0), lo=lo, hi=hi)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keep).schema.fields)
    return asked.mapInPandas(each, f"{schema}, predicted double, lo double, hi double")
