"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: ASCII only.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"

#: Bits of the table by which rows that may be wanted are told before they are shuffled (2 MB at most).
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names the folder in spark.checkpoint.dir. Where that is unset, a temporary folder is made and set, on a local
    master only: on a cluster each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/relyframe-{uuid.uuid4().hex}"


class _Blocks(threading.local):
    """The open ``temporary`` blocks of a thread, with the paths and tables that each has made: queries of other threads have their own."""

    def __init__(self) -> None:
        self.made: list[list[tuple[str, str | None]]] = []

    def note(self, path: str, table: str | None = None, kept: bool = False) -> None:
        if len(self.made) > kept:
            self.made[-1 - kept].append((path, table))


_blocks = _Blocks()


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends at files that outlive executors.

    The files go with the ``temporary`` block that they are written in, or, with ``kept``, the block around that; outside any
    block they go when the application ends.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    system, place = _folder(spark, path)
    system.deleteOnExit(place)
    _blocks.note(path, kept=kept)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``materialize`` for a frame that is joined by ``keys`` several times: ``n`` buckets, so that only the other side is shuffled.

    ``df`` must be partitioned by ``repartition(n, *keys)``: each task then writes one bucket. The files and the
    table's entry in the catalog go like kept ones.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    system, place = _folder(spark, path)
    system.deleteOnExit(place)
    _blocks.note(path, name, kept=True)
    return spark.table(name)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A block whose written frames, but for kept ones, are deleted behind it: none of them may be read later."""
    _blocks.made.append([])
    try:
        yield
    finally:
        for path, name in _blocks.made.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            system, place = _folder(spark, path)
            system.delete(place, True)


def split_words(text: Column) -> Column:
    """Words between runs of ASCII white space, unchanged; none for an empty text."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES, -1))


def mark_members(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with ``maybe``: whether their key may be in ``keys``; false is certain.

    The keys become a bit table of bounded size, which is broadcast, so rows that are surely not among them need no
    shuffle. Where the table fills up, more rows are marked and the result stays right.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(bit, 6).alias("cell"), mask.alias("bits"))
    words = materialize(words.groupBy("cell").agg(F.bit_or("bits").alias("bits")))
    joined = rows.withColumn("cell", F.shiftright(bit, 6)).join(F.broadcast(words), "cell", "left")
    return joined.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask) != 0, F.lit(False))).drop("cell", "bits")
