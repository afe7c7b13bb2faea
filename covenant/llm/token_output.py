"""Token-ID output: texts become files of fixed-width ids, ordered by doc_id, and are read from them again."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm import bitpack
from covenant.llm.cluster import open_file, prepare, shared_folder, tidy, write_file
from covenant.llm.tokens import TEXT_BYTES, encoder, tokenizer_path, with_end
from covenant.llm.words import slices

VOCABULARY = 49_408
END = 1
FILE_IDS = 8 << 20
READ_IDS = 1 << 20


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, vocabulary: int = VOCABULARY, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``docs(doc_id, text)`` as token files below ``folder`` and returns a row for each file.

    Files and the documents in them go by ascending doc_id (nulls first, written as the least 64-bit
    integer; equal ids by text). A null or empty text gives the end id alone. Texts are dealt by ranges of
    doc_id, so no task holds more than its range, and a file closes at about ``file_ids`` ids. A task that
    runs again writes the same files. The rows (number, file, n_docs, n_ids, start) are as few as the
    files; ``start`` counts the ids of all files before.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    prepare(spark)

    def write(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, doc_ids, sizes, held = [], [], [], 0

        def close():
            name = f"{folder}/part-{part:08d}-{made:06d}.bits"
            flat = np.concatenate(ids)
            write_file(name, bitpack.encode(flat, np.concatenate(doc_ids), np.cumsum(np.concatenate(sizes)), vocabulary))
            return pa.RecordBatch.from_pydict({"number": [part << 32 | made], "file": [name], "n_docs": [sum(map(len, doc_ids))], "n_ids": [len(flat)]}, FILES)

        for batch in slices(batches, TEXT_BYTES):
            flat, starts, _, _ = encoder(path).encode(batch.column(1))
            flat, starts = with_end(flat, starts, end)
            ids.append(flat)
            doc_ids.append(batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy())
            sizes.append(np.diff(starts))
            held += len(flat)
            if held >= file_ids:
                yield close()
                made, held = made + 1, 0
                ids, doc_ids, sizes = [], [], []
        if held:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(dealt.mapInArrow(tidy(write), "number long, file string, n_docs long, n_ids long").collect())
    rows, start = [], 0
    for number, file, n_docs, n_ids in files:
        rows.append((number, file, n_docs, n_ids, start))
        start += n_ids
    return spark.createDataFrame(rows, "number long, file string, n_docs long, n_ids long, start long")


FILES = pa.schema([("number", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(files: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(name) as file:
                    tokens = bitpack.TokenFile(file)
                    tokens.verify()
                    begins, first = np.concatenate(([0], tokens.ends[:-1])), 0
                    while first < tokens.n_docs:
                        last = max(first + 1, int(np.searchsorted(tokens.ends, begins[first] + READ_IDS, side="right")))
                        base = int(begins[first])
                        data = memoryview(tokens.ids(base, int(tokens.ends[last - 1])).astype("<u4")).cast("B")
                        crc = [zlib.crc32(data[4 * (a - base) : 4 * (b - base)]) for a, b in zip(begins[first:last].tolist(), tokens.ends[first:last].tolist(), strict=True)]
                        ids = tokens.doc_ids[first:last]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), pa.array(start + begins[first:last]), pa.array(tokens.ends[first:last] - begins[first:last]), pa.array(crc, pa.int64())], schema=READ)
                        first = last

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(parts).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the files (below the shared folder unless one is named) and reads them back."""
    return read_tokens(write_tokens(docs, folder or shared_folder(docs.sparkSession, "tokens")))
