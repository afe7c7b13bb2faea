"""Counts of bytes, words and lines of whole texts, for all rows of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from covenant.llm.words import Words

SYMBOLS = b"#*$%&|<>"
KINDS = ("upper", "lower", "digit", "symbol", "bang", "question", "stop", "comma", "space", "newline", "pipe", "other_ascii", "inner", "lead")


def _kinds() -> np.ndarray:
    """For each byte its kind's number; continuation bytes of UTF-8 are ``inner`` and other bytes from 128 ``lead``."""
    table = np.full(256, KINDS.index("other_ascii"), np.uint8)
    for chars, kind in ((range(65, 91), "upper"), (range(97, 123), "lower"), (range(48, 58), "digit"), (b"#*$%&<>", "symbol"), (b"|", "pipe"), (b"!", "bang"), (b"?", "question"), (b".", "stop"), (b",;:", "comma"), (b" \t\x0b\x0c\r", "space"), (b"\n", "newline"), (range(128, 192), "inner"), (range(192, 256), "lead")):
        for c in chars:
            table[c] = KINDS.index(kind)
    return table


_TABLE = _kinds()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and where each text starts (one more at the end)."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def kind_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows x kinds: how many bytes of each kind each row has."""
    kinds = _TABLE[data]
    rows = len(starts) - 1
    if rows == 0:
        return np.zeros((0, len(KINDS)), np.int64)
    key = np.repeat(np.arange(rows, dtype=np.int32) * len(KINDS), np.diff(starts)) + kinds
    return np.bincount(key, minlength=rows * len(KINDS)).reshape(rows, len(KINDS))


def repeated_windows(words: Words, width: int = 3) -> np.ndarray:
    """For each row, how many words lie in a ``width``-word window that its text has twice or more.

    Windows are compared as sequences of word codes, so nothing is lost to hashing.
    """
    codes, starts = words.codes, words.starts
    rows, n = words.rows, len(words.codes)
    at = np.arange(n)
    at = at[at + width <= starts[1:][rows]] if n else at
    if not len(at):
        return np.zeros(len(words), np.int64)
    key = _ranks(rows[at], codes[at])
    for k in range(1, width):
        key = _ranks(key, codes[at + k])
    twice = np.bincount(key)[key] > 1
    cover = np.zeros(n + 1, np.int64)
    hits = at[twice]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + width, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), starts)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines (cut at \\n alone) of all texts, and where each text's lines start."""
    cut = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    offsets = cut.offsets.to_numpy()
    return cut.flatten(), (offsets - offsets[0]).astype(np.int64)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text, how many lines with a word equal an earlier line."""
    flat, starts = lines(texts)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    rows = rows[full]
    lasting = np.bincount(rows, minlength=len(starts) - 1)
    if not len(rows):
        return lasting
    pairs = np.unique(rows * (int(codes.max()) + 1) + codes)
    return lasting - np.bincount(pairs // (int(codes.max()) + 1), minlength=len(starts) - 1)


def code_points(counts: np.ndarray) -> np.ndarray:
    return counts.sum(1) - counts[:, KINDS.index("inner")]


def word_chars(counts: np.ndarray) -> np.ndarray:
    return code_points(counts) - counts[:, KINDS.index("space")] - counts[:, KINDS.index("newline")]


def symbol_count(counts: np.ndarray) -> np.ndarray:
    return counts[:, KINDS.index("symbol")] + counts[:, KINDS.index("pipe")]


def distinct_words(words: Words) -> np.ndarray:
    if not len(words.codes):
        return np.zeros(len(words), np.int64)
    size = int(words.codes.max()) + 1
    return np.bincount(np.unique(words.rows * size + words.codes) // size, minlength=len(words))
