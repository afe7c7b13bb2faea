"""Fixed-width token files: every id takes the fewest bits that hold the vocabulary's largest id.

Layout of a file (little-endian): the packed ids in blocks of ``BLOCK`` ids, each block padded with zero
bits to a whole number of 64-bit words; then the blocks' byte offsets (uint64), the documents' ids (int64)
and where each document's ids end (uint64, counted in ids); then the trailer. A document is read from the
blocks that hold it alone, and blocks are unpacked with numpy.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"COVBITS1"
BLOCK = 4096
TRAILER = struct.Struct("<QQQIIQ8s")  # ids, documents, blocks, bits, crc32 of all before, bytes of the packed ids, magic


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint64 words; 64 ids take ``bits`` words."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(groups, 64).T)
    out = np.zeros((bits, groups), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).ravel()


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    groups = len(words) // bits
    columns = np.ascontiguousarray(words.reshape(groups, bits).T)
    out, mask = np.empty((64, groups), np.uint32), np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = columns[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | columns[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return np.ascontiguousarray(out.T).ravel()[:n]


def encode(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    """A file's bytes. An id beyond the vocabulary is an error."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} in a vocabulary of {vocabulary}")
    bits = bits_for(vocabulary)
    body = pack(ids, bits)
    blocks = -(-len(ids) // BLOCK)
    offsets = np.arange(blocks, dtype="<u8") * (BLOCK // 64 * bits * 8)
    data = body.astype("<u8").tobytes() + offsets.tobytes() + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(ends, "<u8").tobytes()
    return data + TRAILER.pack(len(ids), len(doc_ids), blocks, bits, zlib.crc32(data), body.nbytes, MAGIC)


class TokenFile:
    """Random access to a file that is open for reading."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        if size < TRAILER.size:
            raise ValueError("not a token file")
        file.seek(size - TRAILER.size)
        self.n_ids, self.n_docs, blocks, self.bits, self.crc, self.body, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC or self.body + 8 * (blocks + 2 * self.n_docs) + TRAILER.size != size:
            raise ValueError("not a token file, or cut short")
        file.seek(self.body)
        tables = np.frombuffer(file.read(8 * (blocks + 2 * self.n_docs)), "<u8")
        self.offsets = tables[:blocks]
        self.doc_ids = tables[blocks : blocks + self.n_docs].view("<i8")
        self.ends = tables[blocks + self.n_docs :].astype(np.int64)

    def verify(self) -> None:
        self.file.seek(0)
        if zlib.crc32(self.file.read(self.body + 8 * (len(self.offsets) + 2 * self.n_docs))) != self.crc:
            raise ValueError("the token file is damaged")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1, read from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, (last - 1) // BLOCK
        begin = int(self.offsets[low])
        end = int(self.offsets[high + 1]) if high + 1 < len(self.offsets) else self.body
        self.file.seek(begin)
        held = unpack(np.frombuffer(self.file.read(end - begin), "<u8"), self.bits, min(self.n_ids, (high + 1) * BLOCK) - low * BLOCK)
        return held[first - low * BLOCK : last - low * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))
