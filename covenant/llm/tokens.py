"""Token ids of whole texts by a public tokenizer whose ids don't depend on what stands beyond white space."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from covenant.llm.textstats import text_bytes
from covenant.llm.words import Words


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Text that is encoded at once; a larger batch repeats fewer words.
TEXT_BYTES = 4 << 20
#: Punctuation that ends a word; the tokenizer cuts it off as a unit of its own.
_TAIL = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_STRETCH = 4096


class TextEncoder:
    """Encodes batches of texts.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in
    order. Each distinct unit is encoded by the tokenizers library and kept in Arrow and numpy arrays; when more
    than ``keep`` would be held, those that were used least lately go.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep, self.turn = keep, 0
        self.units = pa.array([], pa.large_string())
        self.flat, self.sizes, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _singly(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, texts: list[str]) -> list[list[int]]:
        """Ids of words of letters alone: a stretch of them at once, cut where ids end a word."""
        out: list[list[int]] = []
        for k in range(0, len(texts), _STRETCH):
            part = texts[k : k + _STRETCH]
            ids = self._singly([" ".join(part)])[0]
            ends = (np.nonzero(self.ends_word[np.array(ids, np.int64)])[0] + 1).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:  # some word isn't one unit after all
                out += self._singly(part)
        return out

    def _plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of words of a-z alone, which neither the normaliser nor the byte map changes: the model itself takes them."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w)] for w in texts]

    def _forget(self, coming: int) -> None:
        """Makes room for ``coming`` units: the half used last stays, or as many as fit."""
        room = max(0, min(self.keep // 2, self.keep - coming))
        stay = np.sort(np.argsort(-self.used, kind="stable")[:room])
        self.flat = _gather(self.flat, self.sizes, stay)
        self.units, self.sizes, self.used = self.units.take(pa.array(stay)), self.sizes[stay], self.used[stay]

    def _look(self, units: pa.Array) -> np.ndarray:
        """The number of each of some distinct units among those kept; the tokenizer encodes new ones."""
        self.turn += 1
        find = lambda: pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = find()
        missing = np.nonzero(at < 0)[0]
        if len(self.units) and len(self.units) + len(missing) > self.keep:
            self._forget(len(missing))
            at = find()
            missing = np.nonzero(at < 0)[0]
        if len(missing):
            new = units.take(pa.array(missing))
            letters = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
            plain = letters & pc.string_is_ascii(new).to_numpy(zero_copy_only=False) & pc.equal(pc.ascii_lower(new), new).to_numpy(zero_copy_only=False)
            order, ids = [], []
            for kind, learn in ((plain, self._plain), (letters & ~plain, self._letters), (~letters, self._singly)):
                which = np.nonzero(kind)[0]
                if len(which):
                    order.append(which)
                    ids += learn(new.take(pa.array(which)).to_pylist())
            order = np.concatenate(order)
            at[missing[order]] = len(self.units) + np.arange(len(order))
            self.units = pa.concat_arrays([self.units, new.take(pa.array(order))])
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)))
            self.used = np.concatenate((self.used, np.zeros(len(ids), np.int32)))
        self.used[at] = self.turn
        return at

    def _vocabulary(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct words, and how many each has.

        Letters, and punctuation behind them, are units of their own to the tokenizer, and the case of A-Z
        doesn't count; so a word is a head and a tail, and other words are a head that is encoded as it stands.
        """
        head = pc.utf8_rtrim(pc.ascii_lower(vocab), characters=_TAIL)
        head = pc.if_else(pc.utf8_is_alpha(head), head, vocab)
        size = pc.binary_length(head).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        more = np.nonzero(whole > size)[0]
        tail = _ends(vocab, size, whole)
        coded = pa.concat_arrays([head, tail]).dictionary_encode()
        at = self._look(coded.dictionary)
        number = at[coded.indices.to_numpy(zero_copy_only=False)]
        none = len(self.sizes)
        seq = np.full((len(vocab), 2), none)
        seq[:, 0], seq[more, 1] = number[: len(vocab)], number[len(vocab) :]
        sizes = np.append(self.sizes, 0)
        return _gather(self.flat, sizes, seq.ravel()), sizes[seq].sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
        """All ids, where each row's ids start (one more at the end), the words and the number of ids of each word."""
        words = Words(texts)
        table, sizes = self._vocabulary(words.vocab)
        lengths = sizes[words.codes]
        starts = np.concatenate(([0], np.cumsum(lengths)))[words.starts]
        return _gather(table, sizes, words.codes), starts, words, lengths


def _ends(texts: pa.Array, size: np.ndarray, whole: np.ndarray) -> pa.Array:
    """What follows the first ``size`` bytes of each text of ``whole`` bytes, where anything does."""
    data, starts = text_bytes(texts)
    n = (whole - size)[whole > size]
    cut = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat((starts[:-1] + size)[whole > size] - cut[:-1], n) + np.arange(cut[-1])
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``index`` of ``flat``, which holds runs of ``sizes`` one after another."""
    n = sizes[index]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This Python worker's encoder; later tasks of the worker use it again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id ``end`` to every row."""
    return np.insert(ids, starts[1:], np.uint32(end)).astype(np.uint32, copy=False), starts + np.arange(len(starts))
