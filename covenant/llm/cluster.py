"""Session settings and the shared folder that the operators use."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import weakref
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch, at most: one more row than fits, however long, ends a batch.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few documents at a time. The session keeps these settings: plans are run after operators return."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Gives memory that Python and Arrow have freed back to the machine: a worker waits for its next task with little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run(batches)`` for ``mapInArrow`` that releases memory when a task ends."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='covenant-')}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has none, a local master gets a folder of this machine; on a cluster that is an error,
    since other machines wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialised`` wrote, where nothing that is still to be computed reads it."""
    for df in tables:
        uri = _WRITTEN.pop(df, None)
        if uri:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot from this share of all rows on; fewer than ``HOT`` keys can be, so they can come to the driver and their rows of a table can be broadcast.
HOT = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows.join(table, key)`` for ``table(key, ..., held)`` of one row to a key that ``held`` of ``rows`` have at most; without ``held``. Beside it ``table``, written, from which it is read.

    ``total`` is the number of rows, or more. Rows of hot keys, which hold over a ``HOT``-th of it, stay where they
    are and get the table's rows by broadcast; only the others are shuffled. A filter, not a join, tells them apart.
    """
    table = materialised(table, "looked-up")
    hot = F.col("held") * HOT > total
    keys = [r[0] for r in table.where(hot).select(key).collect()]
    if not keys:
        return rows.join(table, key).drop("held"), table
    among = F.col(key).isin(keys)
    return rows.where(among).join(F.broadcast(table.where(hot)), key).unionByName(rows.where(~among).join(table.where(~hot), key)).drop("held"), table


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ''."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _opened(uri: str):
    import pyarrow.fs as pafs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Whole or not at all: written beside its place under a name of its own and moved there. A repeated task writes the same bytes."""
    fs, path = _opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def open_file(uri: str):
    """A seekable file, opened for reading."""
    fs, path = _opened(uri)
    return fs.open_input_file(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as file:
        return file.read()
