"""A training corpus from raw documents in five stages; each calls one operator of ``relyframe.llm``.

All stages take an empty table (and give one), rows with nulls in any column, texts without words and very long ones, repeated
rows, and extra columns of any name, which are dropped: only COLUMNS are read, and all but the last stage return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm import decontaminate, packing, quality, simhash, substring
from relyframe.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy of the rule ledger.

    Null and empty texts have no words and go. Each row is judged alone, so repeated rows stay or go together.
    """
    return quality.keep(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Repeated rows of an id and text are one document, of which one row stays; unlike texts with one id, or without, are documents
    of their own. A null id counts as larger than all others. Texts without words are copies of each other.
    """
    return simhash.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long passages that a document with a smaller id has, too.

    Rows of the same id never cut each other; a null id counts as larger than all others; null texts stay null. ``n_chars``
    is counted anew.
    """
    cut = substring.remove_repeats(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a null text has none. Repeated rows stay or go together."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens, a row a piece.

    Null and empty texts are a piece of the end id; null ids are kept; repeated rows are packed each.
    """
    packed = packing.pack_documents(docs)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither fingerprints nor packing; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if k + 1 < len(STAGES) else docs
    return docs
