"""Ranked caps: the first rows of each key in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(rows: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark limits each key's rows before the shuffle, so a hot key costs n rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def capped_masklets(masklets: DataFrame, n: int, need_mask: bool = False) -> DataFrame:
    """First n masklets of a species; with ``need_mask`` those with any mask count only."""
    rows = masklets.filter(F.exists("segments", lambda s: s.isNotNull())) if need_mask else masklets
    return first_n(rows, ["category_id"], ["record_ord", "masklet_ord"], n)


def capped_frames(frames: DataFrame, n: int) -> DataFrame:
    """First n frames of a location over its probes; a video prompted twice gives its frames twice."""
    return first_n(frames, ["location_id"], ["record_ord", "frame_idx"], n)


def capped_probes(probes: DataFrame, per_species: int, limit: int | None = None) -> DataFrame:
    """First positive probes of each species, hard negatives dropped; then the first ``limit`` of all."""
    rows = first_n(probes.filter("num_masklets > 0"), ["category_id"], ["record_ord"], per_species)
    return rows if limit is None else rows.orderBy("record_ord").limit(limit)


def capped_sequences(sequences: DataFrame, categories: DataFrame, per_category: int, min_frames: int) -> DataFrame:
    """First sequences of each wanted category among those with enough frames and any mask."""
    rows = sequences.filter((F.col("n_frames") >= min_frames) & (F.col("n_masks") > 0))
    rows = rows.join(categories.select("category_id").distinct(), "category_id", "left_semi")
    return first_n(rows, ["category_id"], ["record_ord"], per_category)


def top_detections(detections: DataFrame, k: int, threshold: float) -> DataFrame:
    """Top k detections of each frame above a score; ties go to the smaller id."""
    rows = detections.filter(F.col("score") > threshold)
    return first_n(rows, ["video_id", "frame_idx"], [F.desc("score"), "det_id"], k)


def species_mean(rows: DataFrame, column: str, key: str = "category_id") -> DataFrame:
    """The column replaced by its mean over the key, joined from a map-side aggregate."""
    means = rows.groupBy(key).agg(F.avg(column).alias("_mean"))
    return rows.join(means, key, "left").withColumn(column, F.col("_mean")).drop("_mean")
