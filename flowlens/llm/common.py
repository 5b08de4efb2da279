"""Vectorised word splitting and hashing on Arrow buffers, and small Spark helpers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space: everything but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits: 0-9, A-Z, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ np.uint64(salt * 0xD6E8FEB86659FD93 % 2**64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of several texts. Word i is ``data[offsets[i]:offsets[i + 1]]``; text d has words ``ptr[d]`` to ``ptr[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def array(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, computed piecewise so that one giant text needs no giant work arrays."""
        out = np.empty(len(self.offsets) - 1, np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + CHUNK_BYTES, "right")) - 1)
            a, b = self.offsets[i], self.offsets[j]
            up, down = _powers(int(b - a) + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[self.data[a:b]] * up[: b - a], out=total[1:])
            at = self.offsets[i : j + 1] - a
            out[i:j] = (total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64)
            i = j
        return mixed(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j
        i = j


def split_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Words (runs of bytes of the table ``inside``) of texts that lie back to back in ``raw``."""
    w = inside[raw]
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    starts = np.flatnonzero(w & ~before)
    data = (LOWER[raw] if lower else raw)[w]
    # A word's bytes are contiguous, so lengths are distances between starts among word bytes.
    rank = np.zeros(len(w) + 1, np.int64)
    np.cumsum(w, out=rank[1:])
    return Words(data, np.append(rank[starts], len(data)), np.searchsorted(starts, offsets))


def words_of(texts: pa.Array, inside: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) of chunk after chunk of an Arrow column."""
    raw, offsets = text_bytes(texts)
    for i, j in chunks(offsets):
        at = offsets[i : j + 1]
        yield i, j, split_words(raw[at[0] : at[-1]], at - at[0], inside, lower)


def bucket_of_id(key: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as id ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def with_results(docs: DataFrame, results: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` and the results; a result replaces a column of the same name (in any case)."""
    names = {k.lower() for k in results}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names], *[v.alias(k) for k, v in results.items()])
