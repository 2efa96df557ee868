"""Nearest joins without all pairs: taxonomy prefixes, years, and prototype vectors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.sources.scratch import stored

#: Distinct reference prototypes up to which tasks get them all; beyond, they are indexed.
DIRECT_ROWS = 4_096
#: Reference vectors of a ring of the index on average, and probes that one task compares with a ring.
BLOCK_ROWS = 4_096
#: Reference vectors, first by a hash, among which the pivots are chosen, and pivots at most.
SAMPLE_ROWS, MOST_PIVOTS = 4_096, 1_024
#: Slack of distances against rounding: a square root near zero loses half of the digits.
_SLACK = 1e-6


def taxonomic_distance(probe: DataFrame, reference: DataFrame, loso: bool, levels: int = 7) -> DataFrame:
    """(category_id, distance) of (category_id, path) rows: fewest tree steps to any reference path.

    Each path is unnested into its prefixes; a reference prefix keeps its least and greatest id, probes join by (depth, prefix),
    and the deepest one that holds an id (with ``loso``, another one than the probe's) gives the distance; the root is one row for
    all. A category has one row, the nearest over its paths. Without a complete path, or with nothing left in the reference, it is null.
    """

    def prefixes(rows: DataFrame) -> DataFrame:
        depth = F.sequence(F.lit(1), F.lit(levels))
        each = F.transform(depth, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice("path", F.lit(1), d), "\x1f").alias("prefix")))
        return rows.select("category_id", F.inline(each))

    reference = reference.filter("path is not null").select("category_id", "path").distinct()
    probe = probe.select("category_id", "path").distinct()
    ends = F.min("category_id").alias("least"), F.max("category_id").alias("most")
    held = (F.col("least") != F.col("category_id")) | (F.col("most") != F.col("category_id")) if loso else F.lit(True)
    whole = reference.agg(*ends, F.count("*").alias("n"))
    # Written first, so that Spark splits a prefix that many probes share. Packed, prefixes look small enough for a broadcast, which the
    # driver would have to hold: the join is a merge whatever their size.
    known = stored(prefixes(reference).groupBy("depth", "prefix").agg(*ends))
    asked = prefixes(probe.filter("path is not null")).join(known.hint("merge"), ["depth", "prefix"]).filter(held)
    at_root = F.when(F.col("path").isNotNull() & (F.col("n") > 0) & held, F.lit(0))
    found = asked.select("category_id", "depth").unionByName(probe.crossJoin(F.broadcast(whole)).select("category_id", at_root.alias("depth")))  # one row
    return found.groupBy("category_id").agg((F.lit(levels) - F.max("depth")).cast("double").alias("distance"))


def temporal_gap(cells: DataFrame, years: DataFrame) -> DataFrame:
    """Cells with ``temporal_gap``, the least distance of their year to a reference year; cells without a year are left out.

    The neighbours on either side come from two running windows over the distinct years of both sides.
    """
    asked = cells.withColumn("year", F.col("time").try_cast("int")).filter("year is not null")
    marks = years.select(F.col("year").cast("int").alias("year")).filter("year is not null").distinct().withColumn("mark", F.col("year"))
    all_years = asked.select("year").distinct().join(marks, "year", "full")
    # Years are few: the distinct ones of a calendar.
    down = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.last("mark", ignorenulls=True).over(down), F.last("mark", ignorenulls=True).over(up)
    gaps = all_years.select("year", F.least(F.col("year") - low, high - F.col("year")).cast("double").alias("temporal_gap"))
    return asked.join(gaps, "year").drop("year")


def prototypes(vectors: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """(key, proto, n): the mean of each group's vectors, scaled to unit length, by a map-side aggregate per dimension."""
    each = vectors.select(key, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("n"))
    values = F.transform("v", lambda s: s.x)
    length = F.greatest(F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(1e-12))
    return packed.select(key, F.transform(values, lambda x: x / length).alias("proto"), "n")


class Rings:
    """A metric index over unit vectors: each belongs to its nearest pivot, at a distance within one of that pivot's rings.

    A vector at distance x from a pivot is at least |x - y| from one at distance y (triangle inequality), so a ring whose range of
    distances is further away than the best that is known can't hold anything better.
    """

    def __init__(self, pivots: np.ndarray, firsts: list[str], lasts: list[str]):
        self.pivots, self.firsts, self.lasts = pivots, np.array(firsts, object), np.array(lasts, object)
        self.pivot = self.low = self.high = self.parts = np.empty(0, np.int64)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.clip(2 - 2 * (a @ b.T), 0, None))

    def fit(self, rings: pd.DataFrame) -> None:
        """Rows (pivot, ring, n, low, high); a ring of far too many vectors at one distance is dealt to parts."""
        rings = rings.sort_values(["pivot", "ring"])
        self.pivot, self.low, self.high = (rings[c].to_numpy() for c in ("pivot", "low", "high"))
        self.parts = np.where(rings["n"] > 2 * BLOCK_ROWS, -(-rings["n"] // BLOCK_ROWS), 1).astype(np.int64)

    def bounds(self, to_pivot: np.ndarray) -> np.ndarray:
        """Least distance of vectors (rows) to anything in each ring, from their distances to the pivots."""
        x = to_pivot[:, self.pivot]
        return np.maximum(np.maximum(x - self.high, self.low - x), 0)


def _pivots(sample: np.ndarray, n: int) -> list[int]:
    """Places of n vectors, each the furthest from those before it."""
    chosen, apart = [0], Rings.distances(sample, sample[:1])[:, 0]
    while len(chosen) < n:
        far = int(apart.argmax())
        if apart[far] <= _SLACK:
            break
        chosen.append(far)
        apart = np.minimum(apart, Rings.distances(sample, sample[far : far + 1])[:, 0])
    return chosen


def _index(vectors: DataFrame) -> tuple[Rings, DataFrame]:
    """The index of distinct unit vectors (proto, first, last), and its rows (unit, part, d, proto, first, last).

    The pivots come from SAMPLE_ROWS vectors; all vectors are in the index. The driver holds the pivots and a row a ring, of
    which there is one for each BLOCK_ROWS vectors besides the pivots.
    """
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("proto"), "first").limit(SAMPLE_ROWS).toPandas()
    matrix = np.array(sample["proto"].tolist(), float)
    chosen = _pivots(matrix, min(MOST_PIVOTS, math.ceil(math.sqrt(n)))) if n else []
    index = Rings(matrix[chosen], sample["first"].iloc[chosen].tolist(), sample["last"].iloc[chosen].tolist())

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = Rings.distances(np.array(pdf["proto"].tolist(), float), index.pivots)
            near = apart.argmin(axis=1)
            yield pdf.assign(pivot=near, d=apart[np.arange(len(pdf)), near])

    kind = vectors.schema["proto"].dataType.simpleString()
    placed = stored(vectors.mapInPandas(assign, f"proto {kind}, first string, last string, pivot long, d double"))
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("size"), F.min("d").alias("least"), F.max("d").alias("most"))
    rings = F.ceil(F.col("size") / BLOCK_ROWS)
    step = F.nullif(F.col("most") - F.col("least"), F.lit(0.0))
    ring = F.least(F.coalesce(F.floor((F.col("d") - F.col("least")) / step * rings), F.lit(0)), rings - 1)
    placed = placed.join(F.broadcast(sizes), "pivot").withColumn("ring", ring)  # a row a pivot
    table = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).toPandas()
    index.fit(table)
    table = table.sort_values(["pivot", "ring"]).reset_index(drop=True)
    units = vectors.sparkSession.createDataFrame(
        list(zip(table["pivot"].tolist(), table["ring"].tolist(), range(len(table)), index.parts.tolist(), strict=True)), "pivot long, ring long, unit long, parts long"
    )
    placed = placed.join(F.broadcast(units), ["pivot", "ring"])  # a row a ring
    return index, placed.select("unit", F.pmod(F.xxhash64("proto"), F.col("parts")).alias("part"), "d", "proto", "first", "last")


def _compared(asked: DataFrame, rows: DataFrame, exclude_self: bool) -> DataFrame:
    """(k, p, unit, part, limit, n_compared) of probes in units, with ``limit`` lowered to the best distance that was found there.

    A unit with many probes is copied for each BLOCK_ROWS of them, so that no task gets them all.
    """
    asked = stored(asked)
    many = asked.groupBy("unit", "part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("salts")).filter("salts > 1")
    many = stored(many)

    def salted(side: DataFrame, salt) -> DataFrame:
        return side.join(many, ["unit", "part"], "left").withColumn("salt", salt).drop("salts")

    salts = F.coalesce("salts", F.lit(1))
    asked = salted(asked, F.pmod(F.xxhash64("k"), salts))
    rows = salted(rows, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        limit, compared = left["limit"].to_numpy(float).copy(), np.zeros(len(left), np.int64)
        if len(right) and len(left):
            right = right.sort_values("d", kind="stable")
            d, matrix = right["d"].to_numpy(float), np.array(right["proto"].tolist(), float)
            first, last = right["first"].to_numpy(object), right["last"].to_numpy(object)
            vectors, x, names = np.array(left["p"].tolist(), float), left["d"].to_numpy(float), left["k"].to_numpy(object)
            low, high = np.searchsorted(d, x - limit - _SLACK, side="left"), np.searchsorted(d, x + limit + _SLACK, side="right")
            for i in np.flatnonzero(high > low):
                part = slice(low[i], high[i])
                cosine = matrix[part] @ vectors[i]
                if exclude_self:
                    cosine[(first[part] == names[i]) & (last[part] == names[i])] = -np.inf
                compared[i] = high[i] - low[i]
                if np.isfinite(most := cosine.max()):
                    limit[i] = min(limit[i], math.sqrt(max(0.0, 2 - 2 * most)))
        return left[["k", "p", "unit", "part"]].assign(limit=limit, n_compared=compared)

    kind = asked.schema["p"].dataType.simpleString()
    keys = ["unit", "part", "salt"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, f"k string, p {kind}, unit long, part long, limit double, n_compared long")


def _direct(probe: DataFrame, key: str, refs: pd.DataFrame, n: int, exclude_self: bool) -> DataFrame:
    """``nearest_with_counts`` of few references: one product a batch of probes."""
    matrix = np.array(refs["proto"].tolist(), float)
    first, last = refs["first"].to_numpy(object), refs["last"].to_numpy(object)

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            distance = np.full(len(pdf), np.nan)
            if n and len(pdf):
                names = pdf[key].to_numpy(object)[:, None]
                cosine = np.array(pdf["proto"].tolist(), float) @ matrix.T
                if exclude_self:
                    cosine[(first[None, :] == names) & (last[None, :] == names)] = -np.inf
                most = cosine.max(axis=1)
                distance[np.isfinite(most)] = 1 - most[np.isfinite(most)]
            yield pd.DataFrame({key: pdf[key], "distance": pd.Series(distance, index=pdf.index).astype("Float64"), "n_compared": n})

    return probe.mapInPandas(each, f"`{key}` string, distance double, n_compared long")


def nearest_with_counts(probe: DataFrame, reference: DataFrame, key: str, exclude_self: bool) -> DataFrame:
    """(key, distance, n_compared): 1 - the greatest cosine of a probe's prototype to any reference prototype, its own group
    excluded, and with how many distinct prototypes it was compared.

    Prototypes are unit vectors, or zero. Equal reference prototypes are one, which remembers two of its groups. They are held by
    a metric index of pivots and rings (``Rings``). Each probe is compared inside the ring that looks nearest; then with every
    other ring that the triangle inequality can't exclude, and there with those that are at a fitting distance from the pivot.
    A reference row is in one ring, and a probe's is sent only to rings that may be better than what it has. Up to DIRECT_ROWS
    distinct references are compared as a whole. Without any reference the distance is null.
    """
    refs = reference.select(F.col(key).cast("string").alias("ref"), "proto")
    own = lambda a, b: F.col(a).eqNullSafe(F.col("k")) & F.col(b).eqNullSafe(F.col("k")) if exclude_self else F.lit(False)
    distinct = stored(refs.groupBy("proto").agg(F.min("ref").alias("first"), F.max("ref").alias("last")))
    if (n := distinct.count()) <= DIRECT_ROWS:
        return _direct(probe.select(F.col(key).cast("string").alias(key), "proto"), key, distinct.toPandas(), n, exclude_self)
    is_zero = lambda c: F.forall(c, lambda x: x == 0)
    # Every cosine with a zero vector is zero.
    ends = distinct.agg(F.min("first").alias("low"), F.max("last").alias("high"), *(F.max(F.when(is_zero("proto"), F.col(c))).alias(f"zero_{c}") for c in ("first", "last")))
    index, rows = _index(distinct.filter(~is_zero("proto")))
    rows = stored(rows)
    asked = probe.select(F.col(key).cast("string").alias("k"), F.col("proto").alias("p")).crossJoin(F.broadcast(ends))  # one row
    flat = (F.col("zero_first").isNotNull() & ~own("zero_first", "zero_last")) | (is_zero("p") & F.col("low").isNotNull() & ~own("low", "high"))
    asked = stored(asked.select("k", "p", F.when(flat, F.sqrt(F.lit(2.0))).alias("flat"), is_zero("p").alias("zero")))
    kind = asked.schema["p"].dataType.simpleString()

    def visits(batches: Iterable[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        """Where probes go first (``home``), or all other units that may hold something better than ``limit``."""
        for pdf in batches:
            to_pivot = Rings.distances(np.array(pdf["p"].tolist(), float), index.pivots)
            bounds, names = index.bounds(to_pivot), pdf["k"].to_numpy(object)
            if home:
                # Pivots are references, too: the nearest of another group is a first limit.
                barred = (index.firsts[None, :] == names[:, None]) & (index.lasts[None, :] == names[:, None]) & exclude_self
                limit = np.fmin(np.where(barred, np.inf, to_pivot).min(axis=1), pdf["flat"].to_numpy(float))
                middle = np.abs(to_pivot[:, index.pivot] - (index.low + index.high) / 2)
                unit = np.lexsort((middle, bounds), axis=1)[:, 0] if len(pdf) else np.empty(0, np.int64)
                i, part = np.arange(len(pdf)), pd.util.hash_array(names.astype(str)).astype(np.int64) % index.parts[unit]
            else:
                limit = pdf["limit"].to_numpy(float)
                i, unit = np.nonzero(bounds <= limit[:, None] + _SLACK)
                n = index.parts[unit]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                i, unit = np.repeat(i, n), np.repeat(unit, n)
                seen = (pdf["unit"].to_numpy()[i] == unit) & (pdf["part"].to_numpy()[i] == part)
                i, unit, part = i[~seen], unit[~seen], part[~seen]
            yield pd.DataFrame({"k": names[i], "p": pdf["p"].to_numpy(object)[i], "unit": unit, "part": part, "d": to_pivot[i, index.pivot[unit]], "limit": limit[i]})

    schema = f"k string, p {kind}, unit long, part long, d double, limit double"
    answers = asked.select("k", F.col("flat").alias("limit"), F.lit(0).cast("long").alias("n_compared"))
    if len(index.pivots):
        homes = asked.filter("not zero").mapInPandas(lambda b: visits(b, True), schema)
        first = stored(_compared(homes, rows, exclude_self))
        second = _compared(first.mapInPandas(lambda b: visits(b, False), schema), rows, exclude_self)
        answers = answers.union(first.select("k", "limit", "n_compared")).union(second.select("k", "limit", "n_compared"))
    limit = F.min(F.when(F.col("limit") < float("inf"), F.col("limit")))
    found = answers.groupBy("k").agg((limit * limit / 2).alias("distance"), F.sum("n_compared").alias("n_compared"))
    return found.withColumnRenamed("k", key)


def nearest_prototype(probe: DataFrame, reference: DataFrame, key: str, exclude_self: bool) -> DataFrame:
    """(key, distance): 1 - the greatest cosine of a probe's prototype to any reference prototype, its own group excluded; null
    without any reference. Through the pruned index of ``nearest_with_counts``."""
    return nearest_with_counts(probe, reference, key, exclude_self).select(key, "distance")


def encode_missing(backlog: DataFrame, done: DataFrame, encoder, schema: str, key: str = "key") -> DataFrame:
    """Rows of the backlog whose key has no vector yet, through a user's encoder of pandas batches."""
    missing = backlog.join(done.select(key).distinct(), key, "left_anti")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from encoder(batches)

    return missing.mapInPandas(run, schema)
