"""A grid of models over one table: designs, targets and whole-group hold-outs share every scan.

An item of the grid is a design, a target and a group scheme. Items are ragged: each has its own predictors, rows (those with its
target and group) and number of groups. All items' sums come from the same scans, under one index.

Folds aren't fitted row by row. A fold is the whole table less one group, so its optimum is near the full fit's. The full fit's
scan also gives the second, third and fourth derivatives of the likelihood at its optimum, which are fixed numbers; the sums
of the whole table at a fold's coefficients follow from them. The held-out group's own sums are taken off, and these are
exact: each row is evaluated at the coefficients of its own group's fold, which is one evaluation a row, whatever the number of
groups. Where a group weighs so much that the fourth derivative still moves the result, the fold is iterated over all rows;
groups of such a weight can't be many.

A fold standardizes its predictors without its group, and puts missing values at its own mean. Both are linear in the columns
"value" and "is present", so all sums are held in these columns and mapped to each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.functions.scalars import number, unit, weight
from relyframe.plans.models import MAX_ITERATIONS, MOST_GROUPS, TOLERANCE, Counts, Design, LeaveOut, _bernoulli, _standard
from relyframe.sources.scratch import stored

#: A fold is settled if the fourth derivative changes no coefficient by more than this, and the fold's linear predictor differs from the
#: whole table's by no more than NEAR (root mean square): what the fifth derivative would add is then below 1e-9.
SETTLED, NEAR = 1e-7, 5e-3
#: Numbers that one scan sums at most, and folds that one scan over all rows handles.
MOST_SUMS, FOLD_BLOCK = 4_000_000, 512


@dataclass(frozen=True)
class Item:
    """A model of the grid."""

    design: Design
    target: str
    scheme: str


@dataclass
class Fitted:
    """The fits of an item: ``coef`` of the whole table, and for each group the coefficients ``theta`` of the fold without it.

    ``theta`` belongs to the columns of ``columns``: one, the predictors as the whole table standardizes them, and for
    predictors with missing values whether they are present. ``ok`` says which folds could be fitted.
    """

    item: Item
    places: list[int]
    groups: list[str]
    mean: np.ndarray
    scale: np.ndarray
    gaps: list[int]
    coef: np.ndarray
    deviance: float = np.nan
    null_deviance: float = np.nan
    theta: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    ok: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance > 0 else 0.0

    @property
    def width(self) -> int:
        return 1 + len(self.places) + len(self.gaps)

    def columns(self, x: np.ndarray) -> np.ndarray:
        own = x[:, self.places]
        z = np.nan_to_num((own - self.mean) / np.where(np.isnan(self.scale), np.inf, self.scale))
        return np.column_stack([np.ones(len(x)), z, ~np.isnan(own[:, self.gaps])])


@dataclass(frozen=True)
class Layout:
    """Where the prepared rows have targets (y0..), groups (g0..) and predictors (x0..)."""

    items: tuple[Item, ...]
    targets: tuple[str, ...]
    schemes: tuple[str, ...]
    predictors: tuple[tuple[str, str], ...]

    def places(self, design: Design) -> list[int]:
        return [self.predictors.index(p) for p in _predictors(design)]


def _predictors(design: Design) -> list[tuple[str, str]]:
    return [*(("value", c) for c in design.continuous), *([("log", "")] if design.support else []), *(("flag", c) for c in design.binary)]


def prepare_grid(rows: DataFrame, designs: list[Design], targets: list[str], support: str | None, schemes: dict[str, str], keep: list[str], folds: int | None = None) -> tuple[DataFrame, Layout]:
    """Stored rows with all targets, groups and predictors of the grid, each column once, and their layout.

    With ``folds``, whole groups are dealt by hash to that many, which then are the groups.
    """
    predictors = tuple(dict.fromkeys(p for d in designs for p in _predictors(d)))
    value = {
        "value": lambda c: number(F.col(c)),
        "log": lambda _: F.log1p(number(F.col(support))),
        "flag": lambda c: F.coalesce(number(F.col(c).cast("double")), F.lit(0.0)),
    }
    groups = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in schemes.values()]
    if folds is not None:
        groups = [F.when(g.isNotNull(), F.pmod(F.xxhash64(g), F.lit(folds)).cast("string")) for g in groups]
    out = rows.select(
        *keep, *(unit(number(F.col(t))).alias(f"y{k}") for k, t in enumerate(targets)), (weight(F.col(support)) if support else F.lit(1.0)).alias("w"),
        *(value[kind](c).alias(f"x{k}") for k, (kind, c) in enumerate(predictors)), *(g.alias(f"g{k}") for k, g in enumerate(groups)),
    )
    scored = F.coalesce(*(F.col(f"y{k}") for k in range(len(targets)))).isNotNull()
    items = tuple(Item(d, t, s) for d in designs for t in targets for s in schemes)
    return stored(out.filter(scored)), Layout(items, tuple(targets), tuple(schemes), predictors)


def _moments(rows: DataFrame, layout: Layout) -> dict[tuple[str, str], pd.DataFrame]:
    """For each target and scheme a row a group: counts, sums and squares of all predictors about a common centre, and w, wy.

    One job for the centres and one a scheme.
    """
    n = len(layout.predictors)
    first = rows.agg(*(F.avg(f"x{k}").alias(f"c{k}") for k in range(n)), F.lit(0).alias("_")).first()
    centre = [first[f"c{k}"] or 0.0 for k in range(n)]
    out = {}
    for s, scheme in enumerate(layout.schemes):
        sums = []
        for t in range(len(layout.targets)):
            y = F.col(f"y{t}")
            own = lambda c, y=y: F.when(y.isNotNull(), c)
            total = lambda c, own=own: F.coalesce(F.sum(own(c)), F.lit(0.0))
            sums += [F.count(y).alias(f"rows_{t}"), total(F.col("w")).alias(f"w_{t}"), total(F.col("w") * y).alias(f"wy_{t}")]
            for k in range(n):
                x = F.col(f"x{k}") - F.lit(centre[k])
                sums += [F.count(own(x)).alias(f"n{k}_{t}"), total(x).alias(f"s{k}_{t}"), total(x * x).alias(f"q{k}_{t}")]
        table = rows.filter(F.col(f"g{s}").isNotNull()).groupBy(F.col(f"g{s}").alias("grp")).agg(*sums).orderBy("grp").toPandas()
        for t, target in enumerate(layout.targets):
            own = table[table[f"rows_{t}"] > 0]
            own = own[["grp", *(c for c in table.columns if c.endswith(f"_{t}"))]].rename(columns=lambda c: c.rsplit("_", 1)[0] if c != "grp" else c).reset_index(drop=True)
            own.attrs["centre"] = centre
            out[target, scheme] = own
    return out


def _of_item(moments: pd.DataFrame, places: list[int]) -> pd.DataFrame:
    """An item's moments with its predictors in its own order."""
    own = pd.DataFrame({"grp": moments["grp"], "w": moments["w"], "wy": moments["wy"], "rows": moments["rows"]} | {f"{c}{k}": moments[f"{c}{p}"] for k, p in enumerate(places) for c in "nsq"})
    own.attrs["centre"] = [moments.attrs["centre"][p] for p in places]
    return own


def _summed(rows: DataFrame, layout: Layout, n: int, add: Callable[[dict, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """n sums over all rows: ``add(arrays, x, total)`` adds a batch. A task hands on the sums that aren't zero."""
    t, s, p = len(layout.targets), len(layout.schemes), len(layout.predictors)

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for pdf in batches:
            arrays = {"w": pdf["w"].to_numpy(float), "y": [pdf[f"y{k}"].to_numpy(float) for k in range(t)], "g": [pdf[f"g{k}"] for k in range(s)]}
            add(arrays, pdf[[f"x{k}" for k in range(p)]].to_numpy(float) if p else np.empty((len(pdf), 0)), total)
        i = np.flatnonzero(total)
        yield pd.DataFrame({"i": i, "v": total[i]})

    columns = ["w", *(f"y{k}" for k in range(t)), *(f"x{k}" for k in range(p)), *(f"g{k}" for k in range(s))]
    got = rows.select(*columns).mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(n)
    out[got["i"].to_numpy(int)] = got["v"].to_numpy(float)
    return out


class _Rows:
    """The rows of a batch that an item uses, with the places of their groups."""

    def __init__(self, fit: Fitted, layout: Layout, arrays: dict, x: np.ndarray, cache: dict):
        t, s = layout.targets.index(fit.item.target), layout.schemes.index(fit.item.scheme)
        key = (t, s)
        if key not in cache:
            y = arrays["y"][t]
            used = ~np.isnan(y) & arrays["g"][s].notna().to_numpy()
            place = {g: k for k, g in enumerate(fit.groups)}
            cache[key] = used, arrays["g"][s][used].map(place).to_numpy(int), y[used], arrays["w"][used]
        used, self.group, self.y, self.w = cache[key]
        self.a = fit.columns(x[used])

    def at(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, variance) at one row of coefficients, or at one for each row."""
        eta = (self.a * theta).sum(axis=1) if theta.ndim == 2 else self.a @ theta
        mu = np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), 1e-12, 1 - 1e-12)
        return mu, mu * (1 - mu)


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.append(0, np.cumsum(sizes)).astype(int)


def _full_fits(rows: DataFrame, layout: Layout, fits: list[Fitted], base: list[float]) -> None:
    """Newton steps of all items on their whole tables, in shared scans; the columns of missing values have no part in it."""
    open_, last = list(range(len(fits))), [np.inf] * len(fits)
    for _ in range(MAX_ITERATIONS):
        at = _offsets([(f.width - len(f.gaps)) ** 2 + f.width - len(f.gaps) + 2 for f in (fits[k] for k in open_)])

        def add(arrays: dict, x: np.ndarray, total: np.ndarray, open_=tuple(open_), at=at) -> None:
            cache: dict = {}
            for n, k in enumerate(open_):
                r, p = _Rows(fits[k], layout, arrays, x, cache), fits[k].width - len(fits[k].gaps)
                z = r.a[:, :p]
                r.a = z
                mu, v = r.at(fits[k].coef)
                own = total[at[n] : at[n + 1]]
                own[: p * p] += (z.T @ (z * (r.w * v)[:, None])).ravel()
                own[p * p : -2] += z.T @ (r.w * (r.y - mu))
                own[-2] += (r.w * _bernoulli(r.y, mu)).sum()
                own[-1] += (r.w * _bernoulli(r.y, np.clip(base[k], 1e-12, 1 - 1e-12))).sum()

        sums = _summed(rows, layout, int(at[-1]), add)
        left = []
        for n, k in enumerate(open_):
            f, own, p = fits[k], sums[at[n] : at[n + 1]], fits[k].width - len(fits[k].gaps)
            f.deviance, f.null_deviance = own[-2], own[-1]
            if np.isfinite(own).all():
                f.coef = f.coef + np.linalg.pinv(own[: p * p].reshape(p, p)) @ own[p * p : -2]
            if not abs(last[k] - f.deviance) <= TOLERANCE * (abs(f.deviance) + 0.1) and np.isfinite(f.deviance):
                left.append(k)
            last[k] = f.deviance
        open_ = left
        if not open_:
            break


def _monomials(a: np.ndarray) -> np.ndarray:
    """Products of two columns, i <= j."""
    i, j = np.triu_indices(a.shape[1])
    return a[:, i] * a[:, j]


class _Taylor:
    """Gradient and information of an item's whole table near its fit, from derivatives at the fit."""

    def __init__(self, sums: np.ndarray, q: int):
        self.q, m = q, q * (q + 1) // 2
        self.grad, self.second = sums[:q], sums[q : q + m]
        self.third = sums[q + m : q + m + q * m].reshape(q, m)
        self.fourth = sums[q + m + q * m :].reshape(m, m)
        self.i, self.j = np.triu_indices(q)

    @staticmethod
    def size(q: int) -> int:
        m = q * (q + 1) // 2
        return q + m + q * m + m * m

    @staticmethod
    def of(r: _Rows, theta: np.ndarray) -> np.ndarray:
        mu, v = r.at(theta)
        pairs = _monomials(r.a)
        second = pairs.T @ (r.w * v)
        third = r.a.T @ (pairs * (r.w * v * (1 - 2 * mu))[:, None])
        fourth = pairs.T @ (pairs * (r.w * v * (1 - 6 * v))[:, None])
        return np.concatenate([r.a.T @ (r.w * (r.y - mu)), second, third.ravel(), fourth.ravel()])

    def square(self, packed: np.ndarray) -> np.ndarray:
        """(.., q, q) symmetric matrices of packed upper triangles."""
        out = np.zeros((*packed.shape[:-1], self.q, self.q))
        out[..., self.i, self.j] = packed
        out[..., self.j, self.i] = packed
        return out

    def near(self, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gradients, informations, the fourth derivative's part of the gradients) at rows of differences from the fit."""
        twice = _monomials(delta) * np.where(self.i == self.j, 1.0, 2.0)
        bent = self.square(twice @ self.fourth.T)
        fourth = (bent @ delta[:, :, None])[:, :, 0] / 6
        grad = self.grad - delta @ self.square(self.second) - twice @ self.third.T / 2 - fourth
        info = self.square(self.second) + self.square(delta @ self.third) + bent / 2
        return grad, info, fourth


def _maps(f: Fitted, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(fold, q, p): how a fold's own standardized predictors are made of the item's columns."""
    n, p = len(mean), 1 + len(f.places)
    out = np.zeros((n, f.width, p))
    out[:, 0, 0] = 1
    for k in range(len(f.places)):
        with np.errstate(all="ignore"):
            used = ~np.isnan(scale[:, k]) & ~np.isnan(f.scale[k])
            present = p + f.gaps.index(k) if k in f.gaps else 0
            out[:, 1 + k, 1 + k] = np.where(used, f.scale[k] / scale[:, k], 0.0)
            out[:, present, 1 + k] += np.where(used, (f.mean[k] - mean[:, k]) / scale[:, k], 0.0)
    return out


def _fit_folds(rows: DataFrame, layout: Layout, fits: list[Fitted], standard: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """The folds of all items: derivatives and own sums in one scan, then exact own sums, then what has not settled."""
    starts, whole = [], []
    for f, (mean, scale) in zip(fits, standard, strict=True):
        maps = _maps(f, mean, scale)
        with np.errstate(all="ignore"):
            coef = np.nan_to_num(f.coef[1:] * scale / f.scale)
        coef = np.column_stack([np.full(len(mean), f.coef[0]), coef])
        coef[:, 0] -= (maps[:, 0, 1:] * coef[:, 1:]).sum(axis=1)
        starts.append((maps, coef))
        whole.append(np.append(f.coef, np.zeros(len(f.gaps))))
    widths = [f.width + f.width * (f.width + 1) // 2 for f in fits]
    grads, taylors, infos = [None] * len(fits), [None] * len(fits), [None] * len(fits)
    for block in _blocks([_Taylor.size(f.width) + len(f.groups) * w for f, w in zip(fits, widths, strict=True)]):
        at = _offsets([_Taylor.size(fits[k].width) + len(fits[k].groups) * widths[k] for k in block])

        def add(arrays: dict, x: np.ndarray, total: np.ndarray, block=block, at=at) -> None:
            cache: dict = {}
            for n, k in enumerate(block):
                r, size = _Rows(fits[k], layout, arrays, x, cache), _Taylor.size(fits[k].width)
                own = total[at[n] : at[n + 1]]
                own[:size] += _Taylor.of(r, whole[k])
                mu, v = r.at(whole[k])
                _by_group(own[size:].reshape(-1, widths[k]), r.group, np.column_stack([r.a * (r.w * (r.y - mu))[:, None], _monomials(r.a) * (r.w * v)[:, None]]))

        sums = _summed(rows, layout, int(at[-1]), add)
        for n, k in enumerate(block):
            q, size = fits[k].width, _Taylor.size(fits[k].width)
            own = sums[at[n] : at[n + 1]]
            taylors[k] = _Taylor(own[:size], q)
            by_group = own[size:].reshape(-1, widths[k])
            grads[k], infos[k] = by_group[:, :q], taylors[k].square(by_group[:, q:])
    thetas = [np.repeat(w[None, :], len(f.groups), axis=0) for f, w in zip(fits, whole, strict=True)]  # where own gradients are known
    coefs, errors, moved = [c for _, c in starts], [None] * len(fits), [np.inf] * len(fits)
    for _ in range(MAX_ITERATIONS):
        for k, f in enumerate(fits):
            if moved[k] > 1e-11:
                before = coefs[k]
                coefs[k], errors[k] = _inner(taylors[k], starts[k][0], coefs[k], whole[k], grads[k], infos[k], thetas[k])
                thetas[k] = np.einsum("gqp,gp->gq", starts[k][0], coefs[k])
                still = errors[k] <= SETTLED
                moved[k] = np.abs(coefs[k] - before)[still].max(initial=0.0)
        open_ = [k for k in range(len(fits)) if moved[k] > 1e-11]
        if not open_:
            break
        for block in _blocks([len(fits[k].groups) * fits[k].width for k in open_]):
            chosen = [open_[b] for b in block]
            at = _offsets([len(fits[k].groups) * fits[k].width for k in chosen])

            def add(arrays: dict, x: np.ndarray, total: np.ndarray, chosen=tuple(chosen), at=at, now=tuple(thetas)) -> None:
                cache: dict = {}
                for n, k in enumerate(chosen):
                    r = _Rows(fits[k], layout, arrays, x, cache)
                    mu, _ = r.at(now[k][r.group])
                    _by_group(total[at[n] : at[n + 1]].reshape(-1, fits[k].width), r.group, r.a * (r.w * (r.y - mu))[:, None])

            sums = _summed(rows, layout, int(at[-1]), add)
            for n, k in enumerate(chosen):
                grads[k] = sums[at[n] : at[n + 1]].reshape(-1, fits[k].width)
    unsettled = [(k, g) for k in range(len(fits)) for g in np.flatnonzero(~(errors[k] <= SETTLED))]
    for begin in range(0, len(unsettled), FOLD_BLOCK):
        _exact_folds(rows, layout, fits, [s[0] for s in starts], coefs, unsettled[begin : begin + FOLD_BLOCK])
    for k, f in enumerate(fits):
        f.theta = np.einsum("gqp,gp->gq", starts[k][0], coefs[k])
        f.ok = np.isfinite(f.theta).all(axis=1) & (len(f.groups) > 1)


def _blocks(sizes: list[int]) -> list[list[int]]:
    """Places in runs of at most MOST_SUMS numbers, or one place."""
    out, total = [[]], 0
    for k, n in enumerate(sizes):
        if out[-1] and total + n > MOST_SUMS:
            out.append([])
            total = 0
        out[-1].append(k)
        total += n
    return out


def _by_group(total: np.ndarray, group: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the rows of their groups."""
    if len(group):
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
        total[group[order][first]] += np.add.reduceat(values[order], first, axis=0)


def _inner(taylor: _Taylor, maps: np.ndarray, coef: np.ndarray, whole: np.ndarray, grad: np.ndarray, info: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all folds, what the fourth derivative changes in them), with the held-out groups' gradients known ``at``."""
    change = np.full(len(coef), np.inf)
    for _ in range(MAX_ITERATIONS):
        theta = np.einsum("gqp,gp->gq", maps, coef)
        all_grad, all_info, fourth = taylor.near(theta - whole)
        own = grad - np.einsum("gqr,gr->gq", info, theta - at)
        down = maps.transpose(0, 2, 1)
        left = down @ (all_info - info) @ maps
        with np.errstate(all="ignore"):
            inverse = np.linalg.pinv(np.where(np.isfinite(left), left, 0.0), hermitian=True)
        step = np.einsum("gpr,gr->gp", inverse, np.einsum("gpq,gq->gp", down, all_grad - own))
        change = np.abs(np.einsum("gpr,gr->gp", inverse, np.einsum("gpq,gq->gp", down, fourth))).max(axis=1)
        step = np.where((change <= 1)[:, None] & np.isfinite(step), np.clip(step, -1, 1), 0.0)
        coef = coef + step
        if np.abs(step).max(initial=0.0) < 1e-13:
            break
    delta = np.einsum("gqp,gp->gq", maps, coef) - whole
    apart = np.einsum("gq,qr,gr->g", delta, taylor.square(taylor.second), delta) / max(float(taylor.second[0]), 1e-300)
    return coef, np.where(apart <= NEAR**2, change, np.inf)


def _exact_folds(rows: DataFrame, layout: Layout, fits: list[Fitted], maps: list[np.ndarray], coefs: list[np.ndarray], folds: list[tuple[int, int]]) -> None:
    """Newton steps of some folds over all rows, from the coefficients that they have."""
    start = {k: np.append(f.coef, np.zeros(len(f.gaps))) for k, f in enumerate(fits)}
    for k, g in folds:  # far off: begin as the whole table
        if not np.isfinite(coefs[k][g]).all():
            coefs[k][g] = 0.0
    open_ = list(folds)
    for _ in range(MAX_ITERATIONS):
        at = _offsets([start[k].size ** 2 + start[k].size for k, _ in open_])
        thetas = [maps[k][g] @ coefs[k][g] for k, g in open_]

        def add(arrays: dict, x: np.ndarray, total: np.ndarray, open_=tuple(open_), at=at, thetas=tuple(thetas)) -> None:
            cache: dict = {}
            held: dict[int, _Rows] = {}
            for n, (k, g) in enumerate(open_):
                r = held.setdefault(k, _Rows(fits[k], layout, arrays, x, cache)) if k not in held else held[k]
                q, (mu, v) = fits[k].width, r.at(thetas[n])
                w = r.w * (r.group != g)
                own = total[at[n] : at[n + 1]]
                own[: q * q] += (r.a.T @ (r.a * (w * v)[:, None])).ravel()
                own[q * q :] += r.a.T @ (w * (r.y - mu))

        sums, left = _summed(rows, layout, int(at[-1]), add), []
        for n, (k, g) in enumerate(open_):
            q, own = fits[k].width, sums[at[n] : at[n + 1]]
            info, grad = maps[k][g].T @ own[: q * q].reshape(q, q) @ maps[k][g], maps[k][g].T @ own[q * q :]
            if not np.isfinite(own).all():
                coefs[k][g] = np.nan
                continue
            step = np.linalg.pinv(info) @ grad
            coefs[k][g] += step
            if np.abs(step).max(initial=0.0) > 1e-10 * (1 + np.abs(coefs[k][g]).max(initial=0.0)):
                left.append((k, g))
        open_ = left
        if not open_:
            break


def fit_grid(rows: DataFrame, layout: Layout, folds: bool = True) -> list[Fitted]:
    """The fits of all items over prepared rows, in their order; items without two groups have no folds.

    Raises ValueError beyond MOST_GROUPS groups of a scheme, since the driver holds a row a group.
    """
    moments = _moments(rows, layout)
    most = max((len(m) for m in moments.values()), default=0)
    if most > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: fold them by hash first")
    fits, standard, base = [], [], []
    for item in layout.items:
        places = layout.places(item.design)
        own = _of_item(moments[item.target, item.scheme], places)
        mean, scale = _standard(own, Counts(np.ones((len(own), 1), np.int64)), item.design)
        n_values = len(item.design.continuous) + item.design.support
        gaps = [k for k in range(n_values) if own[f"n{k}"].sum() < own["rows"].sum()]
        fits.append(Fitted(item, places, own["grp"].tolist(), mean[0], scale[0], gaps, np.zeros(1 + len(places))))
        standard.append(_standard(own, LeaveOut(np.arange(len(own))), item.design))
        base.append(own["wy"].sum() / own["w"].sum() if own["w"].sum() > 0 else np.nan)
    used = [k for k, f in enumerate(fits) if f.groups]
    _full_fits(rows, layout, [fits[k] for k in used], [base[k] for k in used])
    many = [k for k in used if len(fits[k].groups) > 1 and np.isfinite(fits[k].coef).all()]
    if folds and many:
        _fit_folds(rows, layout, [fits[k] for k in many], [standard[k] for k in many])
    return fits


def grid_predictions(rows: DataFrame, layout: Layout, fits: list[Fitted], keep: list[str]) -> DataFrame:
    """(keep, design, target, group_scheme, group, actual, predicted): each row of each item by the fold without its group.

    One scan for all items. ``predicted`` is null where that fold failed; items without two groups have no rows.
    """
    fits = [f for f in fits if len(f.groups) > 1]
    t, s, p = len(layout.targets), len(layout.schemes), len(layout.predictors)
    fields = rows.select(*keep).schema.fields
    made = "design string, target string, group_scheme string, group string, actual double, predicted double"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = {"w": pdf["w"].to_numpy(float), "y": [pdf[f"y{k}"].to_numpy(float) for k in range(t)], "g": [pdf[f"g{k}"] for k in range(s)]}
            x, cache = pdf[[f"x{k}" for k in range(p)]].to_numpy(float) if p else np.empty((len(pdf), 0)), {}
            for f in fits:
                r = _Rows(f, layout, arrays, x, cache)
                used = cache[layout.targets.index(f.item.target), layout.schemes.index(f.item.scheme)][0]
                ok = f.ok[r.group] if len(f.ok) else np.zeros(len(r.group), bool)
                mu = np.full(len(r.group), np.nan)
                if ok.any():
                    eta = (r.a[ok] * f.theta[r.group[ok]]).sum(axis=1)
                    mu[ok] = 1 / (1 + np.exp(-eta))
                own = pdf.loc[used, keep].assign(design=f.item.design.name, target=f.item.target, group_scheme=f.item.scheme)
                own["group"], own["actual"] = arrays["g"][layout.schemes.index(f.item.scheme)][used], r.y
                yield own.assign(predicted=pd.Series(mu, index=own.index).astype(object).where(~np.isnan(mu), None).astype("Float64"))

    return rows.mapInPandas(each, schema)


def oos_grid(rows: DataFrame, designs: list[Design], targets: list[str], support: str | None, schemes: dict[str, str], keep: list[str], folds: int | None = None) -> tuple[DataFrame, list[Fitted]]:
    """(out-of-sample predictions of all items, their fits)."""
    ready, layout = prepare_grid(rows, designs, targets, support, schemes, keep, folds)
    fits = fit_grid(ready, layout)
    return grid_predictions(ready, layout, fits, keep), fits


def oos_predictions(rows: DataFrame, target: str, support: str | None, design: Design, group: str, scheme: str, cell: list[str], folds: int | None = None) -> DataFrame:
    """(cell, target, group_scheme, group, actual, predicted): each group predicted by a model without it.

    Null targets and empty groups are left out; below two groups there are no rows. With ``folds``, whole groups are dealt by
    hash to that many, which then are the groups; without, more than MOST_GROUPS groups raise.
    """
    out, _ = oos_grid(rows, [design], [target], support, {scheme: group}, cell, folds)
    return out.drop("design")
