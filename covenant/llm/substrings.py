"""Substring deduplication: passages that an earlier document has are taken out of later ones.

Every window of ``width`` words has a Rabin-Karp hash of 96 bits: 64 that sort it, and 32 of another base that
tell windows of equal 64 apart. Which hashes start in a document of smaller id is
found without moving texts: each task cuts its documents into chunks and sends, for each range of hashes, a
chunk's distinct hashes (sorted, as packed differences) with the smallest document that has each. The range's
task finds each hash's smallest document among all chunks and answers with a bit for each hash of a chunk.
The texts are then read a second time, chunk by chunk, with the chunk's bits from the shared folder.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import materialised, prepare, read_file, release, shared_folder, tidy, write_file
from covenant.llm.words import Words, rolling, slices, windows

WIDTH = 13
#: Text bytes in a chunk and distinct hashes that one range of hashes should hold.
CHUNK_BYTES = 6 << 20
RANGE_HASHES = 2_000_000
NO_ID = np.iinfo(np.int64).max
OTHER_BASE = 0xD1342543DE82EF95


@dataclass
class Chunk:
    """The windows of some documents: each window's first word and row, its number among the chunk's sorted distinct hashes."""

    words: Words
    ids: np.ndarray
    at: np.ndarray
    rows: np.ndarray
    distinct: np.ndarray
    check: np.ndarray  # the other 32 bits of each distinct hash
    number: np.ndarray
    smallest: np.ndarray  # document of smallest id for each distinct hash


def make_chunk(texts: pa.Array, ids: np.ndarray, width: int) -> Chunk:
    words = Words(texts)
    at, rows = windows(words.starts, width)
    hashes, check = window_hashes(words.vocab_hashes()[words.codes], at, width)
    order, first = in_order(hashes, check)
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(first) - 1
    smallest = np.minimum.reduceat(ids[rows][order], np.nonzero(first)[0]) if len(hashes) else np.zeros(0, np.int64)
    return Chunk(words, ids, at, rows, hashes[order][first], check[order][first], number, smallest)


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the window that starts at each of ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return rolling(hashes, at, width), (rolling(hashes, at, width, OTHER_BASE) >> np.uint64(32)).astype(np.uint32)


def in_order(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, then check, and where in it a new one begins. Equal hashes of unequal checks are all but unknown, so the second key is sorted only where there are any."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    other = np.zeros(len(order), bool)
    other[1:] = check[order[1:]] != check[order[:-1]]
    if (other & ~new).any():
        order = np.lexsort((check, hashes))
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    return order, new


def pack_sorted(values: np.ndarray) -> tuple[bytes, int]:
    """Ascending uint64 as differences of as many bytes as the largest needs."""
    if not len(values):
        return b"", 1
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max() if len(steps) > 1 else 0).bit_length() + 7) // 8)
    return values[:1].astype("<u8").tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpack_sorted(data: bytes, width: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    rest = np.frombuffer(data, np.uint8)[8:].reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, :width] = rest
    steps[0] = np.frombuffer(data, np.uint8)[:8]
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_documents(smallest: np.ndarray) -> tuple[bytes, bytes]:
    """Document ids as a sorted table and 16- or 32-bit numbers into it."""
    table, number = np.unique(smallest, return_inverse=True)
    return table.astype("<i8").tobytes(), number.astype("<u2" if len(table) <= 1 << 16 else "<u4").tobytes()


def unpack_documents(table: bytes, number: bytes) -> np.ndarray:
    known = np.frombuffer(table, "<i8")
    return known[np.frombuffer(number, "<u2" if len(known) <= 1 << 16 else "<u4")]


def _chunks(batches, width: int):
    """(name, Chunk, record batch) for the documents of a task. The name holds the task's number, the chunk's and a hash of ids and lengths."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(slices(batches, CHUNK_BYTES)):
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), -1).to_numpy()
        yield f"{part:08d}-{k:06d}-{xxhash.xxh3_64_hexdigest(ids.tobytes() + sizes.tobytes())}", make_chunk(batch.column(1), ids, width), batch


def _bounds(ranges: int) -> np.ndarray:
    """The first hash of each of ``ranges`` equal ranges but the first."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


SENT = pa.schema([("range", pa.int32()), ("chunk", pa.string()), ("bytes_each", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary()), ("doc_of", pa.binary())])


def mark(docs: DataFrame, folder: str, width: int = WIDTH) -> None:
    """Writes below ``folder`` one file for each chunk of ``docs(doc_id, text)``: a byte for each distinct hash, 1 if a smaller document of another chunk has it."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, -(-size // (6 * RANGE_HASHES)))

    def send(batches):
        bounds = _bounds(ranges)
        for name, chunk, _ in _chunks(batches, width):
            cut = np.concatenate(([0], np.searchsorted(chunk.distinct, bounds, side="left"), [len(chunk.distinct)])).tolist()
            for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if a < b:
                    hashes, each = pack_sorted(chunk.distinct[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, name, each, hashes, chunk.check[a:b].astype("<u4").tobytes(), *pack_documents(chunk.smallest[a:b])), SENT, strict=True)], schema=SENT)

    def compare(table: pa.Table) -> pa.Table:
        names, each = table["chunk"].to_pylist(), table["bytes_each"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        hashes = [unpack_sorted(table["hashes"][i].as_py(), each[i]) for i in order]
        owner = [unpack_documents(table["docs"][i].as_py(), table["doc_of"][i].as_py()) for i in order]
        counts = [len(h) for h in hashes]
        every, owner = np.concatenate(hashes), np.concatenate(owner)
        del hashes
        sort, first = in_order(every, np.concatenate([np.frombuffer(table["checks"][i].as_py(), "<u4") for i in order]))
        del every
        groups = np.cumsum(first) - 1
        least = np.minimum.reduceat(owner[sort], np.nonzero(first)[0])[groups]
        later = np.empty(len(owner), bool)
        later[sort] = least < owner[sort]
        cut = np.cumsum([0, *counts]).tolist()
        number = table["range"][0].as_py()
        del sort, first, groups, least, owner
        release()
        return pa.table({"chunk": [names[i] for i in order], "range": pa.array([number] * len(order), pa.int32()), "bits": [np.packbits(later[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)], "n": pa.array(counts, pa.int64())})

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table["bits"].to_pylist(), table["n"].to_pylist(), strict=True)]
        name = table["chunk"][0].as_py()
        write_file(f"{folder}/{name}", np.packbits(np.concatenate(flags)).tobytes())
        return pa.table({"chunk": [name]})

    sent = docs.mapInArrow(tidy(send), "range int, chunk string, bytes_each int, hashes binary, checks binary, docs binary, doc_of binary")
    compared = sent.groupBy("range").applyInArrow(compare, "chunk string, range int, bits binary, n long")
    compared.groupBy("chunk").applyInArrow(keep, "chunk string").write.format("noop").mode("overwrite").save()


def removed_words(name: str, chunk: Chunk, folder: str, width: int) -> np.ndarray:
    """For each word of the chunk whether a window that starts in a smaller document covers it."""
    n = len(chunk.words.codes)
    cover = np.zeros(n + 1, np.int64)
    if len(chunk.distinct):
        data = np.frombuffer(read_file(f"{folder}/{name}"), np.uint8)
        if len(data) != -(-len(chunk.distinct) // 8):
            raise RuntimeError(f"chunk {name} isn't the one that was marked")
        elsewhere = np.unpackbits(data, count=len(chunk.distinct)).astype(bool)
        hit = chunk.at[elsewhere[chunk.number] | (chunk.ids[chunk.rows] > chunk.smallest[chunk.number])]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
    return np.cumsum(cover[:-1]) > 0


def _source(docs: DataFrame) -> DataFrame:
    """Texts that two reads deliver alike: a plain scan of files is one, anything else is written to the shared folder first."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    simple = all(re.match(r"[\s:+-]*(Project|Relation|LogicalRelation)\b", line) for line in plan.strip().split("\n"))
    return docs if simple else materialised(docs, "substrings-input")


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.list_(pa.int64())))])


def find_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, intervals.

    A word goes when a window of ``width`` words that covers it also starts in a document of smaller
    doc_id; windows are those of the input, and equal 96-bit hashes stand for equal windows. ``intervals`` are the maximal runs [first, end) of words that
    go. Null or empty texts, and texts shorter than a window, lose nothing. A null doc_id counts as greater
    than all others; rows that repeat a doc_id aren't smaller than each other, so they keep what only they share.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = _source(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    folder = shared_folder(spark, "substrings")
    mark(texts, folder, width)

    def run(batches):
        for name, chunk, batch in _chunks(batches, width):
            words = chunk.words
            gone = removed_words(name, chunk, folder, width)
            n = words.counts
            total = np.concatenate(([0], np.cumsum(gone)))
            lost = total[words.starts[1:]] - total[words.starts[:-1]]
            left = pa.LargeListArray.from_arrays(pa.array(words.starts - total[words.starts]), words.vocab.take(pa.array(words.codes[~gone])))
            kept = pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
            before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
            before[words.starts[:-1][n > 0]] = False
            after = np.concatenate((gone[1:], [False])) if len(gone) else gone
            after[words.starts[1:][n > 0] - 1] = False
            first, last = np.nonzero(gone & ~before)[0], np.nonzero(gone & ~after)[0]
            rows = words.rows[first]
            runs = np.stack((first - words.starts[rows], last + 1 - words.starts[rows]), axis=1).tolist()
            cut = np.searchsorted(rows, np.arange(len(words) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(lost), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([runs[a:b] for a, b in zip(cut, cut[1:], strict=False)], OUT.field("intervals").type)], schema=OUT)

    return texts.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<array<long>>")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_out(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked ``gone``; each goes with the white space behind it."""
    spans = [m.start() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
    parts, at = [], 0
    for first, end in zip(edges[::2], edges[1::2], strict=True):
        parts.append(text[at : spans[first]])
        at = spans[end] if end < len(spans) else len(text)
    return "".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs``, texts without the words that ``find_repeats`` marks; ``n_chars``, if there, follows the text.

    A text that loses nothing stays as it is, a null text too; null and repeated ids count as in ``find_repeats``. An empty table stays
    empty, and columns of other names pass through.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = _source(docs)
    folder = shared_folder(spark, "substrings")
    plain = source.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mark(plain, folder, width)
    rest = [c for c in source.columns if c not in ("doc_id", "text")]
    fields = {f.name: f for f in source.schema}

    def run(batches):
        for name, chunk, batch in _chunks(batches, width):
            gone = removed_words(name, chunk, folder, width)
            starts = chunk.words.starts
            texts = batch.column(1)
            total = np.concatenate(([0], np.cumsum(gone)))
            changed = np.nonzero(total[starts[1:]] > total[starts[:-1]])[0].tolist()
            if changed:
                values = texts.to_pylist()
                for i in changed:
                    values[i] = cut_out(values[i], gone[starts[i] : starts[i + 1]])
                texts = pa.array(values, batch.schema.field(1).type)
            columns = {"text": texts}
            if "n_chars" in rest:
                columns["n_chars"] = pc.utf8_length(texts).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], schema=batch.schema)

    from pyspark.sql.types import StructType

    ordered = source.select("doc_id", "text", *rest)
    return ordered.mapInArrow(tidy(run), StructType([fields[c] for c in ordered.columns])).select(*docs.columns)
