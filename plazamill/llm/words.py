"""Words of whole texts as 64-bit hashes, a few array passes over the bytes of an Arrow string column.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over random byte values
modulo 2**64, finished by a mixer; folding A-Z only changes the byte values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
P = np.uint64(0x9E3779B97F4A7C13)
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**64, 256, np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            n = max(n, 1 << 20)
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, P)]).astype(np.uint64))
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(P), -1, 1 << 64)))]).astype(np.uint64))


def slices(batches, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has about `most` bytes of text, or one row; empty slices are left out."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


class Words:
    """starts, ends: byte spans in buf; first: for each text its first word, and at the end the number of words. `kind`
    marks the bytes that words are made of."""

    def __init__(self, texts: pa.Array, fold: bool = False, kind: np.ndarray = _IS_WORD):
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf, self.bounds, self.fold = whole[off[0] : off[-1]], off - off[0], fold
        is_word = kind[self.buf]
        n = len(is_word)
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        before = np.zeros(n + 1, bool)
        before[1:] = is_word
        after = np.zeros(n + 1, bool)
        after[:-1] = is_word
        change = (before != after) | (cut & before & after)
        edge = np.flatnonzero(change)
        opens = after[edge]
        self.starts = edge[opens]
        self.ends = edge[before[edge]]
        self.first = np.searchsorted(self.starts, self.bounds)

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        _grow(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((_FOLDED if self.fold else _VALUES)[self.buf] * _powers[:n], out=total[1:])
            return mixed((total[self.ends] - total[self.starts]) * _inverse[self.starts])

    def docs(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries of h (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        _grow(len(h) + 1)
        x = mixed(h + np.uint64(salt)) if salt else h
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x * _powers[: len(h)], out=total[1:])
        return mixed((total[n:] - total[:-n]) * _inverse[: len(h) - n + 1])
