"""Distribution distances and familiarity over an embedding table.

A group's vectors are reduced to (n, sum, upper triangle of the sum of outer products) where they are read, one packed row a group
and task. These rows are added in a tree: no task adds more than FAN of them at a time, so neither a group's vectors nor its partial
sums meet in one place, whatever the number of tasks. The pool without a group is the pool's sums less the group's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.functions.scalars import l2_normal
from relyframe.operators.nearest import nearest_prototype, prototypes
from relyframe.sources.scratch import stored

EPS = 1e-6


#: Partial sums that one task adds.
FAN = 16
#: Bytes of partial sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
_SUMS = "k string, slot long, n long, s binary, ss binary"


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def _upper(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def square(packed: np.ndarray, d: int) -> np.ndarray:
    """The symmetric matrix of a packed upper triangle."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = packed
    return out + np.triu(out, 1).T


def partial_sums(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(k, slot, n, s, ss): sums of each group in each task, packed; ``slot`` is the task's number."""

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, sums, held = TaskContext.get().partitionId(), {}, 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, slot, n, _bytes(s), _bytes(_upper(ss))) for k, (n, s, ss) in sums.items()], columns=["k", "slot", "n", "s", "ss"])

        for pdf in batches:
            for k, rows in pdf.groupby("k", dropna=False):
                x, k = np.vstack(rows["v"].to_numpy()).astype(float), None if pd.isna(k) else k
                if k not in sums:
                    sums[k] = [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))]
                    held += 8 * x.shape[1] * (x.shape[1] + 1)
                own = sums[k]
                own[0] += len(x)
                own[1] += x.sum(axis=0)
                own[2] += x.T @ x
                if held > HELD_BYTES:
                    yield out()
                    sums, held = {}, 0
        yield out()

    return vectors.select(F.col(key).cast("string").alias("k"), F.col(vec).alias("v")).mapInPandas(partial, _SUMS)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    add = lambda c: _bytes(sum(np.frombuffer(b, "<f8") for b in rows[c]))
    return pd.DataFrame({"k": [rows["k"].iloc[0]], "slot": [rows["slot"].iloc[0] // FAN], "n": [rows["n"].sum()], "s": [add("s")], "ss": [add("ss")]})


def merged(parts: DataFrame) -> DataFrame:
    """(k, n, s, ss) of stored partial sums, added FAN slots at a time."""
    slots = (parts.agg(F.max("slot").alias("m")).first().m or 0) + 1
    while True:
        parts = parts.groupBy("k", F.floor(F.col("slot") / FAN).alias("_group")).applyInPandas(_added, _SUMS)
        slots = -(-slots // FAN)
        if slots <= 1:
            return parts.drop("slot")
        parts = stored(parts)


def sufficient(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, n, s, ss): count, sum, and packed upper triangle of the sum of outer products of each group, both as bytes of doubles."""
    return merged(stored(partial_sums(vectors, key, vec))).withColumnRenamed("k", key)


def gaussian(n: float, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unbiased covariance (zeros below two vectors)."""
    d = len(s)
    mean = s / n
    return mean, (ss.reshape(d, d) - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.zeros((d, d))


def _root(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T


def frechet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float = EPS) -> float:
    """Squared Frechet distance of two Gaussians."""
    eye = eps * np.eye(len(a[0]))
    ca, cb = a[1] + eye, b[1] + eye
    root = _root(ca)
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cb @ root), 0, None)).sum()
    return float(((a[0] - b[0]) ** 2).sum() + np.trace(a[1]) + np.trace(b[1]) - 2 * cross)


def mmd_rbf(x: np.ndarray, y: np.ndarray) -> float:
    """Biased squared MMD with a Gaussian kernel; its width is twice the median of all pooled squared distances."""
    both = np.vstack([x, y])
    squares = (both**2).sum(axis=1)
    d2 = np.clip(squares[:, None] + squares[None, :] - 2 * both @ both.T, 0, None)
    kernel, n = np.exp(-d2 / (2 * float(np.median(d2)) + 1e-12)), len(x)
    return float(kernel[:n, :n].mean() + kernel[n:, n:].mean() - 2 * kernel[:n, n:].mean())


def mahalanobis(mean: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> float:
    """Distance of a vector from a pool; low is typical."""
    gap = mean - pool[0]
    return float(np.sqrt(max(0.0, gap @ np.linalg.pinv(pool[1] + EPS * np.eye(len(gap))) @ gap)))


def _pool_row(pool: DataFrame, key: str) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Sums of all groups: one row of a fixed size."""

    def whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = TaskContext.get().partitionId()
        for pdf in batches:
            if len(pdf):
                yield _added(pdf.assign(slot=slot * FAN, k=""))

    row = merged(stored(pool.withColumnRenamed(key, "k").mapInPandas(whole, _SUMS))).first()
    return (row.n, np.frombuffer(row.s, "<f8"), np.frombuffer(row.ss, "<f8")) if row else None


def _per_group(stats: DataFrame, key: str, rule) -> DataFrame:
    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [rule(r) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"k": pdf["k"], "value": pd.Series(values, dtype="float64")})

    return stats.withColumnRenamed(key, "k").mapInPandas(each, "k string, value double").withColumnRenamed("k", key)


def gaussian_distance(probe: DataFrame, reference: DataFrame, key: str, loso: bool, variant: str) -> DataFrame:
    """(key, value) of each probe group against the reference pool, less the group itself with ``loso``.

    ``frechet`` compares Gaussians, ``mahalanobis`` the group's unit mean with the pool. Null below two vectors on a side.
    """
    if variant not in ("frechet", "mahalanobis"):
        raise ValueError(f"unknown variant {variant}")
    ref = stored(sufficient(reference, key))
    total = _pool_row(ref, key)
    own = ref.select(key, F.col("n").alias("rn"), F.col("s").alias("rs"), F.col("ss").alias("rss"))
    joined = sufficient(probe, key).join(own, key, "left")

    def rule(r) -> float | None:
        if total is None:
            return None
        n, s, ss = total
        if loso and r.rn is not None and not pd.isna(r.rn):
            n, s, ss = n - int(r.rn), s - np.frombuffer(r.rs, "<f8"), ss - np.frombuffer(r.rss, "<f8")
        if n < 2 or (variant == "frechet" and r.n < 2):
            return None
        d = len(s)
        pool, mine = gaussian(n, s, square(ss, d)), gaussian(r.n, np.frombuffer(r.s, "<f8"), square(np.frombuffer(r.ss, "<f8"), d))
        if variant == "frechet":
            return frechet(mine, pool)
        return mahalanobis(mine[0] / max(np.linalg.norm(mine[0]), 1e-12), pool)

    return _per_group(joined, key, rule)


def _drawn(order: str):
    return F.md5(F.col(order).cast("string"))


def hash_sample(vectors: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """n rows of each key by the rank of a hash: a sample that does not depend on partitions."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(_drawn(order), order))
    return vectors.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def mmd_distance(probe: DataFrame, reference: DataFrame, key: str, order: str, loso: bool, side: int = 512) -> DataFrame:
    """(key, value): MMD of samples of at most ``side`` vectors of the group and of the pool; null below two on a side.

    Samples are the first rows in the order of a hash of ``order``. The pool's is taken once, 8 times as large, by merging
    small tops, and each group takes the first that are not its own, so it is small enough to be in a task.
    """
    pool = reference.orderBy(_drawn(order), order).limit(8 * side).select(F.col(key).cast("string").alias("k"), "vec").toPandas()
    names, matrix = pool["k"].to_numpy(), np.vstack(pool["vec"].to_numpy()).astype(float) if len(pool) else np.empty((0, 1))
    mine = hash_sample(probe, [key], order, side).groupBy(F.col(key).cast("string").alias("k")).agg(F.collect_list("vec").alias("vs"))

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for k, vs in zip(pdf["k"], pdf["vs"], strict=True):
                other = (matrix[names != k] if loso else matrix)[:side]
                x = np.vstack(vs).astype(float)
                values.append(mmd_rbf(x, other) if len(x) > 1 and len(other) > 1 else None)
            yield pd.DataFrame({"k": pdf["k"], "value": pd.Series(values, dtype="float64")})

    return mine.mapInPandas(each, "k string, value double").withColumnRenamed("k", key)


def mean_square_distance(vectors: DataFrame, vec: str = "vec") -> float:
    """The mean squared distance of two vectors of the table: twice the mean square less twice the square of the mean."""
    x = F.col("x").cast("double")
    by_place = vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg((F.avg(x * x) - F.avg(x) * F.avg(x)).alias("v"))
    return 2 * float(by_place.agg(F.sum("v")).first()[0] or 0.0)


def frequencies(n: int, d: int, seed: int) -> np.ndarray:
    """n by d standard normal numbers from md5(seed:feature:place), by the Box-Muller law on its first two 32-bit words."""
    words = [hashlib.md5(f"{seed}:{j}:{i}".encode()).digest()[:8] for j in range(n) for i in range(d)]
    u = (np.frombuffer(b"".join(words), ">u4").reshape(n, d, 2).astype(float) + 1) / 2**32
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


def mmd_features(probe: DataFrame, reference: DataFrame, key: str, loso: bool, features: int = 256, seed: int = 0) -> DataFrame:
    """(key, value): squared MMD of each group and the pool (less the group with ``loso``) by random Fourier features.

    The kernel is exp(-d2 / (2 m)) with m the mean squared distance over the reference. A vector becomes the cosines and sines of
    seeded frequencies, so that products of two are the kernel up to an error of 1 / sqrt(features); a group is the mean of its
    vectors, and all vectors count. Only sums of fixed size are shuffled. Null below two vectors on a side.
    """
    width = max(mean_square_distance(reference), 1e-12)

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega, sums = None, {}
        for pdf in batches:
            for (k, side), rows in pdf.groupby(["k", "side"], dropna=False):
                x = np.vstack(rows["v"].to_numpy()).astype(float)
                omega = frequencies(features, x.shape[1], seed) / math.sqrt(width) if omega is None else omega
                angle, k = x @ omega.T, None if pd.isna(k) else k
                own = sums.setdefault((k, side), [0, np.zeros(2 * features)])
                own[0] += len(x)
                own[1] += np.concatenate([np.cos(angle).sum(axis=0), np.sin(angle).sum(axis=0)])
        yield pd.DataFrame([(k, side, i, v, n) for (k, side), (n, own) in sums.items() for i, v in enumerate(own)], columns=["k", "side", "i", "v", "n"])

    both = probe.select(F.col(key).cast("string").alias("k"), F.lit("p").alias("side"), F.col("vec").alias("v"))
    both = both.union(reference.select(F.col(key).cast("string").alias("k"), F.lit("r").alias("side"), F.col("vec").alias("v")))
    sums = both.mapInPandas(partial, "k string, side string, i int, v double, n long").groupBy("k", "side", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    sums = stored(sums)
    pool = sums.filter("side = 'r'").groupBy("i").agg(F.sum("v").alias("pv"), F.sum("n").alias("pn"))  # a row a feature
    wide = sums.groupBy("k", "i").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0)).alias(f"{s}{c}") for s in "pr" for c in "vn"))
    joined = wide.withColumnsRenamed({"pv": "v", "pn": "n"}).filter("n > 0").join(F.broadcast(pool), "i", "left")
    left = (lambda c: F.col(f"p{c}") - F.col(f"r{c}")) if loso else (lambda c: F.col(f"p{c}"))
    gap = F.col("v") / F.col("n") - left("v") / F.nullif(left("n"), F.lit(0))
    fit = (F.min("n") > 1) & (F.min(F.coalesce(left("n"), F.lit(0))) > 1)
    return joined.groupBy("k").agg(F.when(fit, F.sum(gap * gap) / features).alias("value")).withColumnRenamed("k", key)


def distribution_distance(probe: DataFrame, reference: DataFrame, key: str, order: str, loso: bool, variant: str) -> DataFrame:
    """(key, value) by variant: ``frechet``, ``mmd`` of samples, or ``mmd_features`` of all vectors; null below two vectors on a side.

    Raises ValueError for other variants.
    """
    if variant == "frechet":
        return gaussian_distance(probe, reference, key, loso, "frechet")
    if variant == "mmd":
        return mmd_distance(probe, reference, key, order, loso)
    if variant == "mmd_features":
        return mmd_features(probe, reference, key, loso)
    raise ValueError(f"unknown variant {variant}")


def silhouette(vectors: DataFrame, key: str) -> DataFrame:
    """(key, value): (inter - intra) / the larger; null below two vectors or without another group."""
    protos = prototypes(vectors, key)
    near = nearest_prototype(protos, protos, key, exclude_self=True)
    joined = vectors.select(F.col(key).cast("string").alias(key), "vec").join(protos.withColumn(key, F.col(key).cast("string")), key)
    dot = F.aggregate(F.zip_with(l2_normal(F.col("vec")), "proto", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    intra = joined.groupBy(key).agg(F.avg(1 - dot).alias("intra"), F.max("n").alias("n"))
    both = intra.join(near, key, "left")
    top = F.nullif(F.greatest("intra", "distance"), F.lit(0.0))
    return both.select(key, F.when((F.col("n") > 1) & F.col("distance").isNotNull(), F.coalesce((F.col("distance") - F.col("intra")) / top, F.lit(0.0))).alias("value"))


def familiarity(vectors: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, value) by metric: silhouette, mahalanobis, or prototype (nearest other prototype)."""
    if metric == "silhouette":
        return silhouette(vectors, key)
    if metric == "mahalanobis":
        return gaussian_distance(vectors, vectors, key, loso=True, variant="mahalanobis")
    if metric == "prototype":
        protos = prototypes(vectors, key)
        return nearest_prototype(protos, protos, key, exclude_self=True).withColumnRenamed("distance", "value")
    raise ValueError(f"unknown metric {metric}")
