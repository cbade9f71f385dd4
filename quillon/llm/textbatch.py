"""Vectorised word and shingle hashing over batches of texts (numpy, inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(text: str | None) -> bytes:
    """UTF-8; null is empty, unpaired surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def text_slices(pdf: pd.DataFrame, column: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut a batch into row ranges of about `limit` characters (one text at least), so memory stays bounded."""
    sizes = pdf[column].map(lambda t: 0 if t is None else len(t)).to_numpy().cumsum() if len(pdf) else np.zeros(0)
    start = 0
    while start < len(pdf):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, "right")))
        yield pdf.iloc[start:stop]
        start = stop
    release()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of A-Z-lower-cased texts.

    Returns (hash of each word, byte start in its text, byte end, offsets of each text's words)."""
    starts_of = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts_of[1:])
    raw = np.frombuffer(b" ".join([*texts, b""]).lower() if texts else b"", np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end, np.zeros(len(texts) + 1, np.int64)
    powers = np.cumprod(np.full(int((end - start).max()), _BASE, np.uint64))
    place = np.arange(int((end - start).sum())) - np.repeat(np.concatenate(([0], np.cumsum(end - start)[:-1])), end - start)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashed = mix64(np.add.reduceat(value, np.concatenate(([0], np.cumsum(end - start)[:-1]))))
    offsets = np.searchsorted(start, starts_of)
    shift = np.repeat(starts_of[:-1], np.diff(offsets))
    return hashed, start - shift, end - shift, offsets


def shingles(hashed: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `width` words inside a text; a shorter text is one shingle, no words give none."""
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=out[1:])
    first = np.arange(int(out[-1])) - np.repeat(out[:-1], count) + np.repeat(offsets[:-1], count)
    length = np.repeat(np.minimum(n, width), count)
    value = length.astype(np.uint64)
    for k in range(width):
        there = length > k
        at = np.minimum(first + k, max(0, len(hashed) - 1))
        value = np.where(there, mix64(value * _LONG + hashed[at] if len(hashed) else value), value)
    return value, out
