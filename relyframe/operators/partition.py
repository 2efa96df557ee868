"""Experiment partitions as membership tables, their firewall, and structural reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.scalars import is_real, year_text
from relyframe.operators.nearest import taxonomic_distance


class LeakageError(ValueError):
    """The held-out axis of a partition overlaps, or its species split keeps a probe in its own reference."""


def pool(splits: dict[str, DataFrame]) -> DataFrame:
    """Probes of all splits with their origin and a namespaced video id, training first in the order."""
    out = None
    for rank, (origin, rows) in enumerate(splits.items()):
        tagged = rows.withColumn("origin", F.lit(origin)).withColumn("origin_rank", F.lit(rank))
        tagged = tagged.withColumn("video_key", F.concat_ws(":", F.lit(origin), F.col("video_id").cast("string")))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def present(probes: DataFrame) -> DataFrame:
    return probes.filter("num_masklets > 0")


def members(probes: DataFrame, side: str) -> DataFrame:
    """(axis, side, value) of the present probes: species, real locations, years."""
    rows = present(probes)
    year = year_text(F.col("creation_datetime"))
    each = F.array(
        F.struct(F.lit("species").alias("axis"), F.col("category_id").alias("value")),
        F.struct(F.lit("location").alias("axis"), F.when(is_real(F.col("location_id")), F.col("location_id")).alias("value")),
        F.struct(F.lit("year").alias("axis"), F.when(year != "", year).alias("value")),
    )
    return rows.select(F.inline(each)).filter("value is not null").distinct().select("axis", F.lit(side).alias("side"), "value")


def species_partition(probes: DataFrame, origins: list[str]) -> DataFrame:
    """Leave-one-species-out: both sides are the present probes of the origins."""
    rows = probes.filter(F.col("origin").isin(origins))
    return members(rows, "reference").unionByName(members(rows, "probe"))


def location_partition(probes: DataFrame) -> DataFrame:
    """Training probes are the reference, test probes the probe side."""
    return members(probes.filter("origin = 'train'"), "reference").unionByName(members(probes.filter("origin = 'test'"), "probe"))


def side_of(probes: DataFrame, partition: DataFrame, side: str, origins: list[str]) -> DataFrame:
    """Present probes of the origins whose species is on a side (semi-join)."""
    wanted = partition.filter((F.col("axis") == "species") & (F.col("side") == side)).select(F.col("value").alias("category_id"))
    return present(probes).filter(F.col("origin").isin(origins)).join(wanted, "category_id", "left_semi")


def overlaps(partition: DataFrame) -> DataFrame:
    """(axis, n_reference, n_probe, n_both)."""
    sides = partition.groupBy("axis", "value").agg(F.bool_or(F.col("side") == "reference").alias("r"), F.bool_or(F.col("side") == "probe").alias("p"))
    n = lambda c: F.count_if(c)
    return sides.groupBy("axis").agg(n(F.col("r")).alias("n_reference"), n(F.col("p")).alias("n_probe"), n(F.col("r") & F.col("p")).alias("n_both"))


def assert_no_leakage(partition: DataFrame, held_axis: str, loso: bool) -> DataFrame:
    """The overlaps; raises LeakageError for overlapping held-out locations, or a species split that is not leave-one-out."""
    report = overlaps(partition)
    if held_axis == "location" and report.filter("axis = 'location' and n_both > 0").count():
        raise LeakageError("reference and probe locations overlap")
    if held_axis == "species" and not loso:
        raise LeakageError("a species split must leave the probe's species out")
    return report


def manifest(probes: DataFrame) -> DataFrame:
    """Probe cells with their number of videos."""
    rows = probes.withColumn("time", year_text(F.col("creation_datetime")))
    return rows.groupBy("category_id", "location_id", "time").agg(F.min("species").alias("species"), F.count("*").alias("n_videos"))


def structural_report(probes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nearest-distance histogram over species, mean share of a species' locations that it shares)."""
    species = present(probes).select("category_id").distinct().join(paths, "category_id")
    histogram = taxonomic_distance(species, species, loso=True).groupBy("distance").agg(F.count("*").alias("n_species"))
    pairs = present(probes).filter(is_real(F.col("location_id"))).select("category_id", "location_id").distinct()
    shared = pairs.groupBy("location_id").agg((F.count("*") > 1).cast("double").alias("shared"))
    share = pairs.join(shared, "location_id").groupBy("category_id").agg(F.avg("shared").alias("share"))
    return histogram, share.agg(F.round(F.avg("share"), 3).alias("shared_locations"))


def save(partition: DataFrame, path: str, cells: DataFrame | None = None) -> None:
    """Freeze a partition, and the manifest of its probe cells, as tables under a path."""
    partition.write.mode("overwrite").parquet(f"{path}/members")
    if cells is not None:
        cells.write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The members of a frozen partition."""
    return spark.read.parquet(f"{path}/members")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a frozen partition."""
    return spark.read.parquet(f"{path}/manifest")


def variants_missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Variants that were asked for and not found."""
    return wanted.select("variant").exceptAll(found.select("variant").distinct())
