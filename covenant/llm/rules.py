"""Quality rules: gradient-boosted trees over statistics of whole documents, with monotonic constraints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm import textstats as ts
from covenant.llm import trees
from covenant.llm.cluster import prepare, tidy
from covenant.llm.learning import SAMPLE, labelled_sample
from covenant.llm.words import Words, slices

MIN_WORDS = 50
#: The features of the trees, and which way the verdict may go with each: -1 only worse, 1 only better.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "duplicate_lines": -1, "repeated_words": -1, "upper": -1, "bangs": -1, "pipes": -1, "digits": 0, "distinct": 0, "stops": 0, "commas": 0, "words_per_line": 0, "same_word_again": -1, "longest_line": 0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x ``BASE``) and the features (rows x ``FEATURES``) of whole texts."""
    words = Words(texts)
    data, starts = ts.text_bytes(texts)
    counts = ts.kind_counts(data, starts)
    n = words.counts
    base = np.stack((n, ts.word_chars(counts), ts.symbol_count(counts), ts.duplicate_lines(texts), ts.repeated_windows(words)), axis=1)
    kind = {k: counts[:, j].astype(float) for j, k in enumerate(ts.KINDS)}
    per_word, chars, line_count = np.maximum(n, 1), np.maximum(base[:, 1], 1), kind["newline"] + 1
    again = np.zeros(len(words.codes), np.int64)
    again[1:] = words.codes[1:] == words.codes[:-1]
    again[words.starts[:-1][n > 0]] = 0
    features = np.stack(
        (np.log1p(n), base[:, 1] / per_word, base[:, 2] / chars, base[:, 3] / line_count, base[:, 4] / per_word, kind["upper"] / chars, kind["bang"] / per_word, kind["pipe"] / per_word, kind["digit"] / chars, ts.distinct_words(words) / per_word, kind["stop"] / per_word, kind["comma"] / per_word, n / line_count, ts.sums(again, words.starts) / per_word, chars / line_count), axis=1
    )
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> trees.Forest:
    """Trees fitted on at most ``sample`` labelled documents whose crc32(doc_id) mod 3 isn't 1 (see ``labelled_sample``)."""
    prepare(docs.sparkSession)

    def gather(batches):
        for batch in slices(batches):
            features = statistics(batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(features), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, label, sample).mapInArrow(tidy(gather), "doc_id long, y double, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), float).reshape(len(rows), len(FEATURES))
    return trees.fit(x, rows["y"].to_numpy(), np.array(list(FEATURES.values())))


OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def apply_rules(docs: DataFrame, forest: trees.Forest, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept, score.

    ``score`` is the trees' probability of good quality. ``kept`` is false where the base rules fail and
    else whether the score reaches ``threshold``. A null or empty text has no words and fails. Rows that
    repeat an id are judged each by itself.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            base, features = statistics(batch.column(1))
            failed, score = base_failed(base), forest.predict(features)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, j], pa.int64()) for j in range(len(BASE))), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(["doc_id long", *(f"{n} long" for n in BASE), "base_failed boolean, kept boolean, score double"]))
