"""Vectorised word handling on Arrow string columns.

A word is a maximal run of characters other than space and the controls
U+0009 to U+000D. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = b" \t\n\x0b\x0c\r"


class Words:
    """The words of a batch of texts: ``codes`` index ``vocab``; row i owns ``codes[starts[i]:starts[i + 1]]``.

    With ``lower`` the letters A-Z of the vocabulary are lowered, and entries can repeat. (It is lowered after the
    words are cut: Arrow's ``ascii_lower`` misreads sliced arrays.)
    """

    __slots__ = ("codes", "starts", "vocab")

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        full = pc.greater(pc.binary_length(flat), 0)
        mask = full.to_numpy(zero_copy_only=False)
        if not mask.all():
            bounds = np.concatenate(([0], np.cumsum(mask)))[bounds]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = bounds.astype(np.int64)
        self.vocab = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def vocab_bytes(self) -> list[bytes]:
        return self.vocab.cast(pa.large_binary()).to_pylist()

    def vocab_hashes(self, seed: int = 0) -> np.ndarray:
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w, seed) for w in self.vocab_bytes()), np.uint64, len(self.vocab))


def windows(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word index and row of every ``width``-word window that stays inside its row."""
    n = int(starts[-1])
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(n)
    ok = at + width <= starts[1:][rows] if n else np.zeros(0, bool)
    return at[ok], rows[ok]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(hashes: np.ndarray, at: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of the windows that start at ``at``, then mixed.

    With P(i) the sum of h(k) * B**-k for k < i, a window's polynomial is (P(i + width) - P(i)) * B**i.
    """
    with np.errstate(over="ignore"):
        n = len(hashes)
        inverse = pow(base, -1, 1 << 64)
        up, down = powers(base, n), powers(inverse, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * down, out=sums[1:])
        return mix((sums[at + width] - sums[at]) * up[at])


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """B**0 .. B**(n - 1) modulo 2**64; kept for the next batch."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
        _POWERS[base] = have
    return have[:n]


def slices(batches, most_bytes: int = 4 << 20, column: str = "text"):
    """Record batches cut so that each holds about ``most_bytes`` of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
            yield batch.slice(first, last - first)
            first = last
