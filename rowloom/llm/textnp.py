"""Words and byte grams of many texts at once, in numpy.

A word is a run of ASCII letters and digits and of bytes of other characters; A-Z counts as a-z. Hashes
are differences of prefix sums over the bytes (a polynomial modulo 2^64), mixed at the end, so that
no step runs word by word in Python.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: What ends a sentence: . ! ? and a line break, and the zero byte that stands between two texts.
ENDS = np.isin(_BYTES, [0, 10, 33, 46, 63])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up, down = (np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_P, _P_INV))
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Bytes:
    """The bytes of some texts, with their words: starts and ends (in bytes), and the text of each."""

    def __init__(self, texts: list[str]):
        coded = [t.replace("\0", " ").encode() for t in texts]
        self.raw = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        size = np.array([len(c) + 1 for c in coded], np.int64)
        self.begins = np.cumsum(size) - size
        self.low = LOWER[self.raw]
        edge = np.diff(IS_WORD[self.raw].view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.begins, self.starts, "right") - 1
        n = 1 << max(19, int(len(self.raw)).bit_length())
        self.up, self.down = _powers(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * self.up[: len(self.low)])])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span of bytes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each run of n bytes inside a word."""
        ok = np.zeros(len(self.raw) + 1, np.int32)
        length = np.maximum(self.ends - self.starts - n + 1, 0)
        has = length > 0
        np.add.at(ok, self.starts[has], 1)
        np.add.at(ok, self.starts[has] + length[has], -1)
        at = np.flatnonzero(np.cumsum(ok)[:-1])
        return at, self.spans(at, at + n)

    def sentences(self) -> np.ndarray:
        """For each byte, the number of the sentence that it stands in."""
        ends = ENDS[self.raw]
        return np.cumsum(ends) - ends


def groups(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of at most about `most` characters in all; (index of the first, texts)."""
    at, part, n = 0, [], 0
    for i, t in enumerate(texts):
        if part and n + len(t) > most:
            yield at, part
            at, part, n = i, [], 0
        part.append(t)
        n += len(t)
    if part:
        yield at, part


#: Characters of a text that are held as bytes, with their sums, at once: a piece ends at the next cut behind them.
LONG = 1 << 19
#: Where no word, and no sentence, is cut in two.
BETWEEN_WORDS, AFTER_SENTENCES = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), re.compile(r"[\0\n!.?]")


def pieces(text: str, cut: re.Pattern = BETWEEN_WORDS, most: int | None = None) -> Iterator[str]:
    """A long text in pieces that end with the first cut behind `most` characters; a run without a cut stays whole, so
    words and sentences are the same for any `most`."""
    most, k = most or LONG, 0
    while len(text) - k > most and (m := cut.search(text, k + most)):
        yield text[k : m.end()]
        k = m.end()
    yield text[k:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words in order; long texts piece by piece."""
    if all(len(t) <= LONG for t in texts):
        b = Bytes(texts)
        return b.doc, b.words()
    doc, out = [], []
    for i, t in enumerate(texts):
        for piece in pieces(t):
            out.append(Bytes([piece]).words())
            doc.append(np.full(len(out[-1]), i, np.int64))
    return np.concatenate(doc), np.concatenate(out)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in parts of few rows, so that no more texts than these are Python strings at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def trim() -> None:
    """Gives memory back at the end of a partition: Python workers live on, and serve other stages."""
    _powers.cache_clear()
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
