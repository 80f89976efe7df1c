"""Words of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased.  Hashes are pure functions of
the word's bytes, so every task and every retry agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(32)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix((_LOWER + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
_BASE, _WORD_BASE = 0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(_BASE, 256)
_WPOW = powers(_WORD_BASE, 4096)
_WINV = powers(pow(_WORD_BASE, -1, 1 << 64), 4096)


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _WPOW, _WINV
    if len(_WPOW) < n:
        m = 1 << (n - 1).bit_length()
        _WPOW, _WINV = powers(_WORD_BASE, m), powers(pow(_WORD_BASE, -1, 1 << 64), m)
    return _WPOW, _WINV


@dataclass
class Words:
    """Words of consecutive documents: hash, first and end byte (within its document), and for
    document i the range ``ptr[i]:ptr[i+1]``."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray


def _scan(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words in ``data``; no word crosses a position in ``cuts``."""
    global _POW
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), starts, starts
    at = np.flatnonzero(solid)
    place = np.searchsorted(at, starts)
    lens = np.diff(np.append(place, len(at)))
    if (longest := int(lens.max())) > len(_POW):
        _POW = powers(_BASE, 1 << longest.bit_length())
    pos = at - np.repeat(starts, lens)
    h = np.add.reduceat(_BYTE[data[at]] * _POW[pos], place)
    return mix(h + lens.astype(_U)), starts, starts + lens


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column (null counts as empty), without copying text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = (np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize)
           if offsets is not None and len(col) else np.zeros(1, kind)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """Words of documents i..j, block after block of about BLOCK_BYTES (a longer document is
    hashed in pieces cut at white space and given whole)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        lo, hi = off[i], off[j]
        if hi - lo <= 2 * BLOCK_BYTES:
            h, s, e = _scan(data[lo:hi], off[i:j] - lo)
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + BLOCK_BYTES)
                while to < hi and not _IS_SPACE[data[to]]:
                    more = np.flatnonzero(_IS_SPACE[data[to:to + BLOCK_BYTES]])
                    to = to + int(more[0]) if len(more) else min(hi, to + BLOCK_BYTES)
                part = _scan(data[at:to], np.empty(0, np.int64))
                parts.append((part[0], part[1] + (at - lo), part[2] + (at - lo)))
                at = to
            h, s, e = (np.concatenate(x) for x in zip(*parts))
        ptr = np.searchsorted(s, off[i:j + 1] - lo)
        base = np.repeat(off[i:j] - lo, np.diff(ptr))
        yield i, j, Words(h, s - base, e - base, ptr)
        i = j


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` reads the hash of any range of words."""
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * _word_powers(len(h) + 1)[0][:len(h)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of words a..b-1 for arrays of bounds: equal sequences have equal hashes anywhere."""
    inv = _word_powers(len(prefix))[1]
    return mix((prefix[b] - prefix[a]) * inv[a] + (b - a).astype(_U) * _U(0x165667B19E3779F9))


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; with fewer words, of the
    whole sequence; none without words."""
    pre = prefix_hash(words.h)
    n = len(words.h)
    every = span_hash(pre, np.arange(max(0, n - k + 1)), np.arange(k, n + 1)) if n >= k else np.empty(0, _U)
    for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist()):
        if b - a >= k:
            x = np.sort(every[a:b - k + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield span_hash(pre, np.array([a]), np.array([b]))
        else:
            yield np.empty(0, _U)
