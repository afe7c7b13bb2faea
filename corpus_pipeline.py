"""The corpus pipeline: raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covenant.llm import decontaminate, near_dedup, packing, substrings, toxicity
from covenant.llm.cluster import discard, documents, materialised


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7, by a model fitted on the labelled ones among them.

    Null and empty texts are judged as texts without words, rows with a null or a repeated id each by itself. Without labels
    of both classes the model says the same of every text.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Texts without words (null ones too) stay, each by itself. Of rows that repeat an id one stays; a row without an id
    stays where no row with an id, and no earlier row, has its text.
    """
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 40 words or more that an earlier document has; ``n_chars`` follows.

    All rows stay. A null id counts as greater than all others; null, empty and short texts lose nothing.
    """
    return substrings.remove_repeats(docs, width=40)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; without a benchmark all stay. Each row is judged by itself."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. A null or empty text is its end alone; rows that repeat an id are packed each by itself, those without an id first."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model, minimum hashes and a tokenizer stand behind the rows; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder, read by the next and deleted when that is written.

    Empty tables give no rows; columns that ``documents`` has besides its own pass through to the last stage.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        kept = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = kept
    return docs
