"""Lower-cased terms of whole texts as bytes: runs of ``0-9a-z`` and of characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kiln.llm.words import buffers

PIECE_BYTES = 1 << 20
_IN_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(c if c in _IN_TERM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """All terms of a UTF-8 text in order, a list per piece of about PIECE_BYTES."""
    raw = raw.translate(_TABLE)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE_BYTES)
        to = len(raw) if to < 0 else to
        if piece := raw[at:to].split():
            yield piece
        at = to


def texts(col: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text (null counts as empty), one at a time."""
    data, off = buffers(col)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[a:b].tobytes()


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1, ... in one array."""
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
