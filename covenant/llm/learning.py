"""Bounded samples of labelled rows, gathered by Spark for models that the driver fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import remainder

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE, held_out: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` of at most ``rows`` labelled documents, with their label as ``y`` (double).

    Documents whose crc32(doc_id) mod 3 is ``held_out`` are never in it. The sample is the rows of least
    hash, so it doesn't depend on how the tables are dealt. Null ids and null labels are left out; labels
    that repeat an id count once (their greatest value), and so do documents (their least text), so the sample is ``rows``
    texts at most. The labels that are sent to every task are as many ids.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("y"))
        .where(F.col("__id").isNotNull() & F.col("y").isNotNull() & (remainder("__id", 3) != held_out))
        .groupBy("__id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__id"])
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
