"""Operator 7: proportional stratified interleaving into shards, with DataFrame functions only.

Rows of each source are put into a seeded random order. A row's fractional rank is its place in that
order, less a phase of its source, over the source's row count. Sorting by it interleaves the sources in
proportion, so any contiguous cut matches the mixture to within one row a source; cutting the sorted rows
at equal counts gives shards whose sizes differ by one row at most (law ``rows``).

No source is ever sorted in one task. Both rankings split their key range into buckets, count rows per
bucket first (map-side), turn the counts into offsets, and number rows inside each bucket only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, table

N_SHARDS = 24
SEED = 7
#: Rows that one ranking bucket holds on average.
ROWS_PER_BUCKET = 500
#: 2**63, to map a signed 64-bit hash to [0, 1).
_HALF = float(2**63)


def _unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.least((hashed.cast("double") + F.lit(_HALF)) / F.lit(2 * _HALF), F.lit(1 - 2.0**-53))


def _offsets(counts: DataFrame, keys: list[str], per: int) -> DataFrame:
    """Rows in the buckets before each bucket; counts has one row a (keys, bucket).

    Two levels, so that no window holds more than about ``per`` rows: blocks of buckets, then inside blocks.
    """
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("block", F.floor(F.col("bucket") / F.lit(per)))
    blocks = counts.groupBy(*keys, "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_before"))
    return (
        counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(blocks, [*keys, "block"])
        .select(*keys, "bucket", (F.col("inside") + F.col("block_before")).alias("before"))
    )


def stratified_interleave(
    rows: DataFrame, id_col: str, source_col: str, n_shards: int = N_SHARDS, seed: int = SEED
) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Every shard holds floor or ceil of rows / n_shards rows, and of each source as near to its share as whole
    rows allow. Order depends on the id, source and seed only. A null source is a source of its own; a null id
    or repeated rows are ranked like others (equal rows may swap places, which leaves equal results). Of an
    empty table the result is empty. Other columns are kept, whatever their names; columns of the input that
    are named ``shard`` or ``slot`` are replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    work = rows.select(
        F.struct(*(rows[c] for c in kept)).alias("row"),
        F.coalesce(F.concat(F.lit("="), rows[source_col].cast("string")), F.lit("null")).alias("src"),
        F.xxhash64(F.lit(seed), rows[id_col], rows[source_col]).alias("h"),
        F.xxhash64(F.lit(seed + 1), rows[id_col]).alias("tie"),
    )
    total = rows.count()
    n_buckets = max(16, math.ceil(total / ROWS_PER_BUCKET))
    per = max(16, math.isqrt(n_buckets))
    # A source of a third of all rows spreads over all buckets; a small one fills few, thin ones.
    work = work.withColumn("bucket", F.floor(_unit(F.col("h")) * F.lit(n_buckets)))
    counts = materialize(work.groupBy("src", "bucket").agg(F.count("*").alias("n")))
    totals = counts.groupBy("src").agg(F.sum("n").alias("src_n"))
    places = _offsets(counts, ["src"], per).join(totals, "src")
    # The phase spreads sources of one row over the whole range.
    phase = _unit(F.xxhash64("src", F.lit(seed)))
    ranked = materialize(
        work.withColumn("r", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "tie")))
        .join(places, ["src", "bucket"])
        .withColumn("f", (F.col("before") + F.col("r") - phase) / F.col("src_n"))
        .withColumn("bucket", F.least(F.floor(F.col("f") * F.lit(n_buckets)), F.lit(n_buckets - 1)))
        .select("row", "src", "f", "h", "tie", "bucket")
    )
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    within = Window.partitionBy("bucket").orderBy("f", "src", "h", "tie")
    return (
        ranked.withColumn("r", F.row_number().over(within))
        .join(_offsets(counts, [], per), "bucket")
        .withColumn("place", F.col("before") + F.col("r") - 1)
        .withColumn("shard", F.expr(f"cast(place * {n_shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"place - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
        .select("row.*", "shard", "slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law ``rows``, with the digests of the contract."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return stratified_interleave(sized, "doc_id", "source").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
