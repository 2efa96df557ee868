"""Masks and pixels: run-length masks and scene measures in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([T.StructField("area", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in "xywh")])


def run_lengths(counts: str) -> list[int]:
    """Run lengths of a compressed COCO string: 5-bit groups, low first, signed, the third and later as differences."""
    runs, at, data = [], 0, counts.encode()
    while at < len(data):
        value, shift, more = 0, 0, True
        while more:
            c = data[at] - 48
            value |= (c & 31) << shift
            more, at, shift = bool(c & 32), at + 1, shift + 5
            if not more and c & 16:
                value |= -1 << shift
        runs.append(value + runs[-2] if len(runs) > 2 else value)
    return runs


def decode_mask(height: int, width: int, counts: str) -> np.ndarray:
    """Boolean mask of a run-length text; runs go down the columns, background first."""
    runs = run_lengths(counts)
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    flat = np.pad(flat, (0, max(0, height * width - len(flat))))[: height * width]
    return flat.reshape(width, height).T


def _measure(height: int, width: int, counts: str | None) -> tuple:
    if not counts:
        return 0, None, None, None, None
    mask = decode_mask(height, width, counts)
    if not mask.any():
        return 0, 0, 0, 0, 0
    ys, xs = np.nonzero(mask)
    return int(mask.sum()), int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)


@F.pandas_udf(METRICS)
def mask_metrics(height: pd.Series, width: pd.Series, counts: pd.Series) -> pd.DataFrame:
    rows = [_measure(int(h), int(w), c) for h, w, c in zip(height, width, counts, strict=True)]
    return pd.DataFrame(rows, columns=["area", "x", "y", "w", "h"]).astype({"area": "int64", **dict.fromkeys("xywh", "Int32")})


def with_metrics(frames: DataFrame, height: Column, width: Column, counts: Column) -> DataFrame:
    """Rows with area and box of their masks; zero area and null boxes without one."""
    return frames.withColumn("m", mask_metrics(height, width, counts)).select("*", "m.*").drop("m")


def log_area(frames: DataFrame, species: DataFrame, cap: int = 40) -> DataFrame:
    """(category_id, log_area): log1p of the mean area over the first ``cap`` masklets with a mask; null without any."""
    from relyframe.operators.caps import first_n

    masklets = frames.filter("area > 0").select("category_id", "ann_id", "record_ord", "masklet_ord").distinct()
    kept = first_n(masklets, ["category_id"], ["record_ord", "masklet_ord"], cap)
    areas = frames.filter("area > 0").join(kept.select("ann_id"), "ann_id", "left_semi").groupBy("category_id").agg(F.log1p(F.avg("area")).alias("log_area"))
    return species.select("category_id").distinct().join(areas, "category_id", "left")


def achromatic(rgb: np.ndarray, threshold: float = 12.0) -> bool:
    spread = rgb.max(axis=2).astype(int) - rgb.min(axis=2)
    return float(spread.mean()) < threshold


def clutter(rgb: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian inside; zero below three pixels a side."""
    if min(rgb.shape[:2]) < 3:
        return 0.0
    grey = (rgb.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000
    g = grey.astype(float)
    inner = g[2:, 1:-1] + g[:-2, 1:-1] + g[1:-1, 2:] + g[1:-1, :-2] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def scene_pass(pixels: DataFrame) -> DataFrame:
    """(key, location_id, is_achromatic, clutter) of (key, location_id, height, width, rgb) rows."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [np.frombuffer(rgb, np.uint8).reshape(h, w, 3) for h, w, rgb in zip(pdf["height"], pdf["width"], pdf["rgb"], strict=True)]
            yield pdf[["key", "location_id"]].assign(is_achromatic=[achromatic(x) for x in images], clutter=[clutter(x) for x in images])

    return pixels.mapInPandas(each, "key string, location_id string, is_achromatic boolean, clutter double")


def location_scene(frames: DataFrame, flag: str = "is_achromatic", clutter_col: str = "clutter") -> DataFrame:
    """(location_id, achromatic_fraction, clutter, is_night_ir): means over frames, and whether most are achromatic."""
    share = F.avg(F.col(flag).cast("double"))
    return frames.groupBy("location_id").agg(share.alias("achromatic_fraction"), F.avg(clutter_col).alias("clutter"), (share > 0.5).alias("is_night_ir"))
