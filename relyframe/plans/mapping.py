"""The given tables in the roles of the analytics: probes, cells, taxonomy, vectors, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same roles as SQL, for both engines.
PROBE_SQL = """
probe AS (
  SELECT l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS k5, p_brand AS category_id, p_brand AS species, n_name AS location_id,
    CAST(year(l_shipdate) AS VARCHAR) AS time, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'train' ELSE 'test' END AS origin,
    CASE WHEN s_nationkey % 5 = 0 THEN 'test' ELSE 'train' END AS origin_loc,
    CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END AS BIGINT) AS num_masklets,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 10 END AS pDetA,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax * 12.5 END AS pAssA,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE (l_discount * 10 + l_tax * 12.5) / 2 END AS pHOTA,
    CAST(l_quantity AS BIGINT) AS n_frames, l_extendedprice AS x_price, CAST(p_size AS DOUBLE) AS x_size,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_night_ir, p_partkey, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
CELLS_SQL = """
cells AS (
  SELECT category_id, species, location_id, time, avg(pDetA) AS pDetA, avg(pAssA) AS pAssA, avg(pHOTA) AS pHOTA,
    CAST(sum(n_frames) AS BIGINT) AS n_frames, CAST(sum(num_masklets) AS BIGINT) AS num_masklets, count(*) AS n_videos
  FROM probe GROUP BY category_id, species, location_id, time
)"""
#: Order of records in the probe table.
ORDER = ["k1", "k2", "k3", "k4", "k5"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe a line item; its columns are those of PROBE_SQL, and ``creation_datetime``."""
    items, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    rows = items.join(part, items.l_partkey == part.p_partkey).join(supplier, items.l_suppkey == supplier.s_suppkey)
    rows = rows.join(nation, supplier.s_nationkey == nation.n_nationkey)
    scored = F.col("l_returnflag") != "N"
    det, assoc = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    return rows.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("long").alias("k2"), F.col("l_partkey").alias("k3"),
        F.col("l_suppkey").alias("k4"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("k5"),
        F.col("p_brand").alias("category_id"), F.col("p_brand").alias("species"), F.col("n_name").alias("location_id"),
        F.year("l_shipdate").cast("string").alias("time"), F.col("l_shipdate").cast("string").alias("creation_datetime"),
        F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp"), "train").otherwise("test").alias("origin"),
        F.when(F.col("s_nationkey") % 5 == 0, "test").otherwise("train").alias("origin_loc"),
        F.when(scored, F.col("l_linenumber")).otherwise(0).cast("long").alias("num_masklets"),
        F.when(scored, det).alias("pDetA"), F.when(scored, assoc).alias("pAssA"), F.when(scored, (det + assoc) / 2).alias("pHOTA"),
        F.col("l_quantity").cast("long").alias("n_frames"), F.col("l_extendedprice").alias("x_price"),
        F.col("p_size").cast("double").alias("x_size"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_night_ir"),
        "p_partkey", "p_size",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relyframe.operators.scoring import score_cells

    return score_cells(probes(spark, sf_dir))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category_id, path): a seven-level path a part."""
    word = lambda k: F.split("p_name", " ")[k]
    levels = [F.col("p_type"), F.col("p_brand"), word(0), word(1), F.col("p_size") % 5, F.col("p_size"), F.col("p_partkey")]
    path = F.array(*(c.cast("string") for c in levels))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("category_id"), path.alias("path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, category_id, location_id, is_reference, vec)."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id", F.col("label").cast("string").alias("category_id"), (F.col("vec_id") % 20).cast("string").alias("location_id"),
        (F.col("vec_id") % 4 != 0).alias("is_reference"), F.col("embedding").alias("vec"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One masklet an event; a probe is a user's day."""
    rows = read(spark, sf_dir, "events")
    return rows.select(
        "event_id", F.col("user_id").cast("string").alias("user_id"), F.to_date("ts").cast("string").alias("day"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), F.get_json_object("props", "$.k").cast("int").alias("frame_idx"),
        (F.col("event_type") == "error").alias("is_error"), (F.col("user_id") % 2 == 1).alias("is_reference"),
        (F.col("user_id") % 8).cast("string").alias("location_id"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, det_id, track_id, score): one detection a line item."""
    rows = read(spark, sf_dir, "lineitem")
    det = F.concat_ws(":", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return rows.select(
        F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("frame_idx"), det.alias("det_id"),
        F.col("l_suppkey").alias("track_id"), (F.col("l_discount") * 10).alias("score"),
    )
