"""Incremental forms: prediction files into confidence cells, and embedding of what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relyframe.operators.nearest import encode_missing
from relyframe.operators.scoring import confidence_of_counts, score_counts
from relyframe.sources.tables import probe_rows, read_predictions


PROBE = ["video_id", "category_id"]


def ingest_probes(probes: DataFrame, table_path: str, checkpoint: str, keys: list[str] = PROBE, cell: list[str] = ("category_id",)) -> StreamingQuery:
    """Add the confidence sums of a stream of probes to a table; ends when all that is present is read.

    ``probes`` has a row a probe: keys, cell, covered, total, scores. A state store holds the keys, so a probe that comes again,
    in any batch or under another file name, counts once; its first row stands. A batch adds a row a cell and score, and a row a
    cell, and overwrites its own folder if it is run again.
    """

    def batch(new: DataFrame, batch_id: int) -> None:
        cells = list(cell)
        scores = new.select(*cells, F.explode_outer("scores").alias("score"))
        score_counts(scores, cells).write.mode("overwrite").parquet(f"{table_path}/scores/batch={batch_id}")
        frames = new.groupBy(*cells).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
        frames.write.mode("overwrite").parquet(f"{table_path}/frames/batch={batch_id}")

    return probes.dropDuplicates(keys).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_predictions(spark: SparkSession, source: str, table_path: str, checkpoint: str, tracker: str) -> StreamingQuery:
    """Add new prediction files; a file is a probe, told by its name without the folder."""
    probes = probe_rows(read_predictions(spark, source, tracker, stream=True))
    return ingest_probes(probes, table_path, checkpoint, ["tracker", *PROBE])


def confidence_of(spark: SparkSession, table_path: str, threshold: float, cell: list[str] = ("category_id",)) -> DataFrame:
    """Confidence cells of what has been ingested, from the batches' sums."""
    counts, frames = (spark.read.parquet(f"{table_path}/{name}").drop("batch") for name in ("scores", "frames"))
    return confidence_of_counts(counts, frames, threshold, list(cell))


def ingest_embeddings(spark: SparkSession, source: str, schema: str, table_path: str, checkpoint: str, encoder, out_schema: str, known: DataFrame | None = None) -> StreamingQuery:
    """Encode the keys of a Parquet source that have not come before; ends when all present files are read.

    A state store holds the keys that have come, so no batch reads the table that it adds to; ``known`` are keys that were encoded
    elsewhere. A batch overwrites its own folder if it is run again.
    """
    backlog = spark.readStream.schema(schema).parquet(source).dropDuplicates(["key"])
    done = spark.createDataFrame([], out_schema) if known is None else known

    def batch(new: DataFrame, batch_id: int) -> None:
        encode_missing(new, done, encoder, out_schema).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return backlog.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
