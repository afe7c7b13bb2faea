"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents go one after another by doc_id. Windows are cut at the ends of documents or sentences (inside a
sentence only if it exceeds a window), so that padding plus the prices of truncating documents is least. A
window that starts at cut i and ends at cut j costs ``capacity - (p[j] - p[i])`` for padding plus the price of
cut j; since only p[i] + best[i] depends on i, the best start is the least value of a sliding window, which a
monotone queue gives in constant time for each cut.

Tasks pack ranges of doc_id. What a range's last window holds isn't padded: it goes on, as ids, to a task
that packs the rests of ``FAN`` neighbouring ranges in their order, whose rest goes on likewise, until one
rest is left. So one sequence of the whole table is short, however the table is dealt.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import materialised, prepare, tidy
from covenant.llm.tokens import TEXT_BYTES, encoder, tokenizer_path, with_end
from covenant.llm.words import slices

CAPACITY = 4096
END = 2
SENTENCE_PRICE = 4.0
INSIDE_PRICE = 12.0
#: Ids between the cut points inside a sentence that exceeds a window.
STRIDE = 32
#: Windows that are planned at once; the last of them is planned again with the next ones.
HORIZON = 256
#: Ranges whose rests are packed together.
FAN = 256
#: How the last word of a sentence ends.
_STOP = r"""[.!?…。！？]["')\]}]*$"""


def plan(cuts: np.ndarray, prices: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indices into ``cuts`` (ascending positions, the first is where packing starts) where windows end.

    Neighbouring cuts must be at most ``capacity`` apart. Least sum of padding and prices; the last cut is
    always an end, and what the last window lacks costs nothing: it is planned again with what follows. Of
    equal costs the earliest start wins.
    """
    p, price = cuts.tolist(), prices.tolist()
    n = len(p)
    best, back = [0.0] * n, [0] * n
    queue = deque([0])
    keys = [0.0] * n
    keys[0] = p[0]
    for j in range(1, n):
        low = p[j] - capacity
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = value = keys[i] + capacity - p[j] + price[j]
        keys[j] = key = value + p[j]
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    ends = []
    j = n - 1
    if j:
        near = range(int(np.searchsorted(cuts, p[j] - capacity)), j)
        back[j] = min(near, key=best.__getitem__)
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class _Packer:
    """Takes documents in order and gives their pieces, a horizon at a time."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids not yet packed, ids packed before, doc_tokens, cuts from the first id of the rest)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, cuts: np.ndarray, before: int = 0, total: int | None = None):
        self.docs.append((doc_id, ids, before, len(ids) if total is None else total, cuts))
        self.held += len(ids)

    def pieces(self, last: bool):
        """Packs what is held, but for its last window unless this is the end."""
        if not self.docs:
            return
        base, cuts, prices = 0, [np.zeros(1, np.int64)], [np.zeros(1)]
        for _, ids, _, _, inner in self.docs:
            ends = np.concatenate((inner, [len(ids)]))
            gaps = np.diff(np.concatenate(([0], ends)))
            price = np.full(len(ends), SENTENCE_PRICE)
            price[-1] = 0.0
            if gaps.max() > self.capacity:  # cut points inside sentences that no window holds
                stride = min(STRIDE, self.capacity)
                long = gaps > self.capacity
                extra = np.concatenate([np.arange(e - g + stride, e, stride) for e, g in zip(ends[long].tolist(), gaps[long].tolist(), strict=True)])
                ends, price = np.concatenate((ends, extra)), np.concatenate((price, np.full(len(extra), INSIDE_PRICE)))
                order = np.argsort(ends, kind="stable")
                ends, price = ends[order], price[order]
            cuts.append(base + ends)
            prices.append(price)
            base += len(ids)
        cuts, prices = np.concatenate(cuts), np.concatenate(prices)
        ends = cuts[plan(cuts, prices, self.capacity)].tolist()
        if not last:
            ends.pop()
        k, used, start = 0, 0, 0
        for end in ends:
            offset = 0
            while start < end:
                doc_id, ids, before, total, _ = self.docs[k]
                take = min(len(ids) - used, end - start)
                piece = ids[used : used + take]
                yield doc_id, before + used, take, zlib.crc32(piece.astype("<u4", copy=False).tobytes()), total, self.sequence, offset
                offset, used, start = offset + take, used + take, start + take
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        self.docs = self.docs[k:]
        if used:
            doc_id, ids, before, total, inner = self.docs[0]
            self.docs[0] = (doc_id, ids[used:], before + used, total, inner[inner > used] - used)
        self.held -= start


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: A packed piece, or (with ``ids``, its cut points, its range and its place in that range's rest) what is still to be packed.
PIECES = pa.schema([*((n, pa.int64()) for n in _COLUMNS), ("range", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()), ("cuts", pa.binary())])
_DDL = ", ".join(f"{n} long" for n in _COLUMNS) + ", range long, place long, ids binary, cuts binary"


def _packed(packer: _Packer, last: bool) -> pa.RecordBatch | None:
    rows = list(packer.pieces(last))
    if rows:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), *(pa.nulls(len(rows), t) for t in PIECES.types[7:])], schema=PIECES)
    return None


def _rest(packer: _Packer, part: int) -> pa.RecordBatch:
    """What is left of a range, to be packed with the rests of others."""
    rows = [(d, before, len(ids), 0, total, None, None, part, k, ids.astype("<u4").tobytes(), cuts.astype("<i8").tobytes()) for k, (d, ids, before, total, cuts) in enumerate(packer.docs)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text)``: doc_id, start (its document's ids before), length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id lies in one piece; pieces of a document keep their order, and documents follow each other by
    doc_id (nulls first; equal ids by text) inside each range of ids that a task packs, and so do the rests of
    ranges. A null or empty text is the end id alone; an empty table gives no rows. Sequences hold ``capacity``
    ids at most, and a shorter one is padded. Sequence ids are unique, not gapless. A task holds one horizon of
    windows and one batch of texts, or ``FAN`` rests of less than a window each. The pieces are written to the
    shared folder.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    prepare(spark)

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = _Packer(capacity, part << 32)
        for batch in slices(batches, TEXT_BYTES):
            flat, starts, words, lengths = encoder(path).encode(batch.column(1))
            stop = pc.match_substring_regex(words.vocab, _STOP).to_numpy(zero_copy_only=False)
            at = np.cumsum(lengths)
            flat, starts = with_end(flat, starts, end)
            rows = words.rows
            is_cut = stop[words.codes] & (lengths > 0) if len(words.codes) else np.zeros(0, bool)
            cut_at, cut_row = (at + rows)[is_cut] - starts[rows[is_cut]], rows[is_cut]
            bounds = np.searchsorted(cut_row, np.arange(len(words) + 1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, flat[starts[k] : starts[k + 1]], cut_at[bounds[k] : bounds[k + 1]])
                if packer.held >= HORIZON * capacity and (out := _packed(packer, False)):
                    yield out
        if out := _packed(packer, False):
            yield out
        if packer.docs:
            yield _rest(packer, part)

    def join_rests(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by([("range", "ascending"), ("place", "ascending")])
            part = group["range"][0].as_py() // FAN
            packer = _Packer(capacity, level << 56 | part << 32)
            for doc_id, start, total, ids, cuts in zip(*(group[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "cuts")), strict=True):
                packer.add(doc_id, np.frombuffer(ids, "<u4"), np.frombuffer(cuts, "<i8"), start, total)
            out = [b for b in (_packed(packer, last),) if b]
            if packer.docs:
                out.append(_rest(packer, part))
            return pa.Table.from_batches(out, PIECES)

        return run

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    pieces = materialised(dealt.mapInArrow(tidy(run), _DDL), "pieces")
    done, level = pieces.where("ids is null"), 0
    while (most := pieces.where("ids is not null").agg(F.max("range")).first()[0]) is not None:
        level += 1
        rests = pieces.where("ids is not null").groupBy(F.floor(F.col("range") / FAN)).applyInArrow(join_rests(level, most < FAN), _DDL)
        pieces = materialised(rests, "pieces")
        done = done.unionAll(pieces.where("ids is null"))
    return done.select(*_COLUMNS)
