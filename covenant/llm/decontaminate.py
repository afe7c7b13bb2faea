"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lowered, and every run of characters that are neither letters nor digits in Unicode becomes one
space. An item of n characters with at most k edits shares n + 1 - q - k * q of its character q-grams with its
occurrence, on diagonals that differ by k at most. So q-grams shared with each item are counted in overlapping bands of diagonals; a band
that reaches the item's bound is aligned with the item (banded edit distance) and reported if k edits do.
Items of fewer than ``LEAST`` characters are searched as they are, at word boundaries: chance would match them with edits.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import prepare, tidy
from covenant.llm.textstats import text_bytes
from covenant.llm.words import slices

Q = 8
EDITS = 0.1
#: Characters of a folded item from which edits are allowed.
LEAST = 32
#: Bytes of benchmark text whose index goes to every task at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 4 << 20
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _in_words() -> np.ndarray:
    """For each code point whether it is a letter, a digit or a mark on one."""
    kept = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x30000)])
    return np.concatenate((kept, np.zeros(0x110000 - len(kept), bool)))


def _lowered(texts: pa.Array) -> pa.Array:
    """The texts in lower case, each with a zero byte behind it."""
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    return pc.utf8_lower(pc.binary_join_element_wise(pc.fill_null(whole, ""), pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())))


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes (as bytes where all are ASCII), and how many start before each byte."""
    lead = data & 0xC0 != 0x80
    total = np.concatenate(([0], np.cumsum(lead)))
    at = np.nonzero(lead)[0]
    if len(at) == len(data) and not (data & 0x80).any():
        return data, total
    points = data[at].astype(np.uint32)
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        long = np.nonzero((points >= least) & (points < (least >> 1 | 0x80)) & (data[at] >= least))[0]
        x = data[at[long]].astype(np.uint32) & mask
        for k in range(1, more + 1):
            x = x << 6 | data[at[long] + k].astype(np.uint32) & 0x3F
        points[long] = x
    return points, total


@dataclass
class Folded:
    """Folded texts one after another, each followed by a zero: their code points, a byte for each (equal points have equal bytes), where each text starts (one more at the end), each point's place among the code points of all texts, and where each text starts there."""

    points: np.ndarray
    letters: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    begins: np.ndarray


def folded(texts: pa.Array) -> Folded:
    data, starts = text_bytes(_lowered(texts))
    points, total = _points(data)
    begins = total[starts]
    known = _in_words()
    out = np.where(known[points], points, points.dtype.type(32))
    out[begins[1:] - 1] = 0
    keep = np.ones(len(out), bool)
    space = out == 32
    keep[1:] = ~(space[1:] & (space[:-1] | (out[:-1] == 0)))
    if len(out):
        keep[0] = not space[0]
    places = np.nonzero(keep)[0]
    out = out[keep]
    letters = out if out.dtype == np.uint8 else np.where(out < 128, out, 128 | (out * np.uint32(2654435761)) >> np.uint32(25)).astype(np.uint8)
    return Folded(out, letters, np.concatenate(([0], np.cumsum(keep)))[begins], places, begins)


def grams(data: np.ndarray) -> np.ndarray:
    """Every 8 neighbouring letters as one uint64."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()


@dataclass
class Index:
    """The q-grams of some items: sorted distinct grams, and for each its (item, place) postings."""

    item_ids: list
    items: list[np.ndarray]  # code points
    letters: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    width: np.ndarray
    known: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short_ids: list
    short: list[np.ndarray]  # code points
    short_letters: list[bytes]


def make_index(rows: list[tuple], edits: float = EDITS, least: int = LEAST) -> Index | None:
    """Of (item_id, text) rows; items that fold to fewer than ``least`` characters are kept apart, for an exact search."""
    text = folded(pa.array([r[1] for r in rows], pa.large_string()))
    spans = [(r[0], a, b - 1 - int(b - 1 > a and text.points[b - 2] == 32)) for r, a, b in zip(rows, text.starts.tolist(), text.starts[1:].tolist(), strict=False)]
    item = lambda a, b: (text.points[a:b].astype(np.uint32), text.letters[a:b].tobytes())
    short = [(i, *item(a, b)) for i, a, b in spans if 0 < b - a < least]
    kept = [(i, *item(a, b)) for i, a, b in spans if b - a >= least]
    apart = [[x[k] for x in short] for k in range(3)]
    if not kept:
        none = np.zeros(0, np.int64)
        return Index([], [], [], none, none, none, none.astype(np.uint64), np.zeros(1, np.int64), none, none, np.zeros(1 << _BITS, bool), *apart) if short else None
    n = np.array([len(t) for _, t, _ in kept])
    budget = np.minimum((edits * n).astype(int), (n - Q) // Q)
    codes = [grams(np.frombuffer(x, np.uint8)) for _, _, x in kept]
    every, owner = np.concatenate(codes), np.repeat(np.arange(len(kept)), [len(c) for c in codes])
    place = np.concatenate([np.arange(len(c)) for c in codes])
    order = np.argsort(every, kind="stable")
    known, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << _BITS, bool)
    table[_slot(known)] = True
    width = 1 << np.ceil(np.log2(2 * budget + 1)).astype(int)
    return Index([i for i, _, _ in kept], [t for _, t, _ in kept], [x for _, _, x in kept], budget, n + 1 - Q - budget * Q, width, known, np.append(first, len(order)), owner[order], place[order], table, *apart)


def _slot(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * _MULTIPLIER) >> np.uint64(64 - _BITS)).astype(np.int64)


def candidates(data: np.ndarray, starts: np.ndarray, index: Index) -> np.ndarray:
    """(row, item, first diagonal, last diagonal) of every band pair whose shared q-grams reach the item's bound.

    A diagonal is the text's place less the item's. Bands of ``width`` diagonals are counted, and each is
    taken with the next, so the pairs overlap by a band and every ``width`` neighbouring diagonals lie in one. A
    pair has fewer diagonals than two occurrences side by side are apart, so it holds one of them at most.
    """
    if not index.items:
        return np.zeros((0, 4), np.int64)
    codes = grams(data)
    at = np.nonzero(index.table[_slot(codes)])[0]
    number = np.minimum(np.searchsorted(index.known, codes[at]), len(index.known) - 1)
    hit = index.known[number] == codes[at]
    at, number = at[hit], number[hit]
    n = index.first[number + 1] - index.first[number]
    posting = np.arange(n.sum()) + np.repeat(index.first[number] - (np.cumsum(n) - n), n)
    item = index.item[posting]
    row = np.searchsorted(starts, at, side="right") - 1
    band = (np.repeat(at, n) - index.place[posting]) // index.width[item]
    key = ((np.repeat(row, n) * len(index.items) + item) << 28) + band + (1 << 27)
    place = index.place[posting]
    for distinct in (False, True):  # first all hits, then the item's distinct places among those left
        if distinct:
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            key, place = key[first], place[first]
        held, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        near = held[1:] == held[:-1] + 1
        bound = index.bound[(held >> 28) % len(index.items)]
        ahead, behind = count.copy(), count.copy()
        ahead[:-1][near] += count[1:][near]
        behind[1:][near] += count[:-1][near]
        good = ((ahead >= bound) | (behind >= bound))[inverse]
        key, place = key[good], place[good]
    if not len(key):
        return np.zeros((0, 4), np.int64)
    key = np.unique(np.concatenate((held[ahead >= bound], held[(behind >= bound)] - 1)))
    low, owner = key & ((1 << 28) - 1), key >> 28
    item = owner % len(index.items)
    width = index.width[item]
    return np.stack((owner // len(index.items), item, (low - (1 << 27)) * width, (low + 2 - (1 << 27)) * width), axis=1)


def align(patterns: list[np.ndarray], texts: list[np.ndarray], band: int, anchor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against a part of its text, and where that part ends.

    The part starts anywhere in the first ``band`` characters, or at character ``anchor``; only
    alignments whose diagonal stays within ``band`` of the text's start are seen. All pairs go row by row together.
    """
    n = np.array([len(p) for p in patterns])
    rows = int(n.max())
    p = np.zeros((len(patterns), rows), np.uint32)
    t = np.full((len(patterns), rows + band), 1, np.uint32)  # 1 never is in a folded text
    for k, (a, b) in enumerate(zip(patterns, texts, strict=True)):
        p[k, : len(a)] = a
        t[k, : min(len(b), rows + band)] = b[: rows + band]
    limit = np.array([len(b) for b in texts])
    far = 1 << 20
    step = np.arange(band, dtype=np.int32)
    cost = np.zeros((len(patterns), band), np.int32)
    if anchor is not None:
        cost[:] = np.where(step < anchor, far, step - anchor)
    cost[step[None, :] > limit[:, None]] = far
    best, end = np.full(len(patterns), far), np.zeros(len(patterns), np.int64)
    for i in range(rows):
        new = cost + (p[:, i : i + 1] != t[:, i : i + band])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new[step[None, :] + i + 1 > limit[:, None]] = far
        cost = np.minimum.accumulate(new - step, axis=1) + step
        cost[step[None, :] + i + 1 > limit[:, None]] = far
        done = np.nonzero(n == i + 1)[0]
        if len(done):
            where = cost[done].argmin(1)
            best[done], end[done] = cost[done, where], where + i + 1
    return best, end


def short_hits(text: Folded, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, 0) of every occurrence of the short items between word boundaries of the folded texts. Short items are numbered after the others.

    Stretches of as many words as an item, of its length and its first two letters, are looked up among the items.
    """
    data, starts = text.letters, text.starts
    if not index.short:
        return []
    space = (data == 32) | (data == 0)
    first = np.nonzero(~space & np.concatenate(([True], space[:-1])))[0]
    last = np.nonzero(~space & np.concatenate((space[1:], [True])))[0] + 1
    if not len(first):
        return []
    row = np.searchsorted(starts, first, side="right") - 1
    whole = data.tobytes()
    by_words: dict[int, dict[bytes, list[int]]] = {}
    for k, item in enumerate(index.short_letters):
        by_words.setdefault(item.count(b" ") + 1, {}).setdefault(item, []).append(k)
    out = []
    for words, items in by_words.items():
        begin, end = first[: len(first) - words + 1], last[words - 1 :]
        near = (row[: len(begin)] == row[words - 1 :]) & np.isin(end - begin, [len(t) for t in items])
        lead = np.zeros(1 << 16, bool)  # by the first two letters, or one and what follows it
        lead[[(t + b" ")[0] << 8 | (t + b" ")[1] for t in items]] = True
        second = data[begin + 1]
        near &= lead[data[begin].astype(np.int64) << 8 | np.where(second == 0, 32, second)]
        at = np.nonzero(near)[0]
        done: dict[tuple[int, int], int] = {}
        for r, a, b in zip(row[at].tolist(), begin[at].tolist(), end[at].tolist(), strict=True):
            for k in items.get(whole[a:b], ()):
                if a >= done.get((r, k), 0) and np.array_equal(text.points[a:b], index.short[k]):  # occurrences that overlap are one
                    done[r, k] = b
                    out.append((r, len(index.items) + k, a, b, 0))
    return out


def search(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the items' occurrences in whole texts; places are code points of the text."""
    text = folded(texts)
    starts = text.starts
    found = candidates(text.letters, starts, index)
    out, unsure = [], []
    for row, item, low, high in found.tolist():
        k, pattern, letters = int(index.budget[item]), index.items[item], index.letters[item]
        begin, own, end = low, max(low, int(starts[row])), min(high + len(pattern) - 1, int(starts[row + 1]) - 1)
        if end - own < len(pattern) - k:
            continue
        piece, hit = text.letters[own:end].tobytes(), False
        at = piece.find(letters)
        while at >= 0:  # the item as it is
            if np.array_equal(text.points[own + at : own + at + len(pattern)], pattern):
                hit = True
                out.append((row, item, own + at, own + at + len(pattern), 0))
                at = piece.find(letters, at + len(pattern))
            else:
                at = piece.find(letters, at + 1)
        if not hit:  # diagonals from before the text count too: a copy at its start can lack letters
            unsure.append((row, item, begin, np.concatenate((np.ones(own - begin, np.uint32), text.points[own:end])), high - low))
    unsure.sort(key=lambda x: x[4])
    for first in range(0, len(unsure), 256):
        part = unsure[first : first + 256]
        patterns = [index.items[x[1]] for x in part]
        edits, end = align(patterns, [x[3] for x in part], part[-1][4])
        good = [j for j, x in enumerate(part) if edits[j] <= index.budget[x[1]]]
        if good:
            most = max(int(index.budget[part[j][1]]) for j in good)
            turned = [np.concatenate((np.ones(most, np.uint32), part[j][3][: end[j]][::-1])) for j in good]
            back = align([patterns[j][::-1] for j in good], turned, 2 * most + 2, anchor=most)[1] - most
            out += [(*part[j][:2], max(part[j][2] + int(end[j] - b), int(starts[part[j][0]])), part[j][2] + int(end[j]), int(edits[j])) for j, b in zip(good, back, strict=True)]
    best: list[tuple] = []
    for row in sorted(set(out)):
        if best and best[-1][:2] == row[:2] and row[2] < best[-1][3]:  # the same occurrence, from another band
            if row[4] < best[-1][4]:
                best[-1] = row
        else:
            best.append(row)
    best += short_hits(text, index)
    return [(r, i, int(text.places[a] - text.begins[r]), int(text.places[b - 1] + 1 - text.begins[r]), e) for r, i, a, b, e in best]


def indexes(benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES):
    """Indexes of ``benchmark(item_id, text)``, one for each block of about ``block_bytes``; one block is on the driver at a time."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = make_index(sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1])), edits)
        if index:
            yield index


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])


def find_contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """A row for each occurrence of a benchmark item in a document: doc_id, item_id, start, end (code points), edits.

    An item of n folded characters occurs where at most min(n * ``edits``, (n - 8) / 8) edits of characters make
    it, or as it is between word boundaries if n < 32. Occurrences of an item that overlap are one, the earliest of fewest edits. Null or empty texts, and
    items without letters and digits, hold and match nothing; items that repeat are reported by each id, rows that repeat an id each by itself.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for index in indexes(benchmark, edits):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            held = shared.value
            names = held.item_ids + held.short_ids
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], names[i], a, b, e) for r, i, a, b, e in search(batch.column(1), held)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=OUT)

        part = texts.mapInArrow(tidy(run), "doc_id long, item_id long, start long, end long, edits long")
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long") if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose texts no benchmark item occurs (see ``find_contamination``).

    Rows with a null or empty text, or a null id, hold nothing or are judged by their text; rows that repeat are judged each by itself.
    An empty table of either kind leaves ``docs`` as it is, and columns of any name but ``text`` pass through.
    """
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")
    for index in indexes(benchmark, edits):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in search(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
