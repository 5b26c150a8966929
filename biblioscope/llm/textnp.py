"""Whole batches of texts as numpy arrays: words, lines and rolling hashes.

A batch of an Arrow string column is one byte buffer with offsets.  Words are the
runs of bytes other than 0x20 and 0x09-0x0D; their hashes come from one prefix sum
over the buffer (a polynomial modulo 2**64, then mixed), so no Python loop runs
over words.  Batches are cut into pieces of at most ``PIECE_BYTES`` (a longer text
is a piece of its own), which bounds the temporary arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
MULT = U64(0xD6E8FEB86659FD93)

DELIMITERS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(DELIMITERS)] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]))
                                  for b in (BASE, BASE_INV))
        return self.up, self.down


_POWERS = _Powers()


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * BASE**i``; see ``span_hash``."""
    up, _ = _POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``[start, end)``: equal contents give equal hashes wherever they stand."""
    _, down = _POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


@dataclass
class Piece:
    """Rows ``first..first+rows`` of a batch: their bytes and offsets from 0."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a piece in order: byte span, row within the piece, hash; and words per row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    first: np.ndarray     # index of each row's first word


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow column, null as empty, in pieces of bounded bytes."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield Piece(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def words(piece: Piece, lower: bool = False) -> Words:
    data = TO_LOWER[piece.data] if lower else piece.data
    n = len(data)
    inside = IS_WORD[data]
    edge = np.zeros(n + 1, bool)           # a row begins here
    edge[piece.offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    prefix = rolling(data.astype(U64) + U64(1))
    first = np.searchsorted(start, piece.offsets)
    count = np.diff(first)
    return Words(start, end, np.repeat(np.arange(piece.rows), count), span_hash(prefix, start, end), count, first[:-1])


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (word indices) and hashes of all windows of ``n`` consecutive words of one row."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[:total - n + 1] == w.row[n - 1:])
    if n <= 8:
        acc = w.hash[:total - n + 1].copy()
        for j in range(1, n):
            acc = mix(acc * MULT + w.hash[j:total - n + 1 + j])
        return at, acc[at]
    return at, span_hash(rolling(w.hash), at, at + n)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``n``-word shingle; a row of fewer words has its whole sequence as one."""
    at, h = windows(w, n)
    row = w.row[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        whole = span_hash(rolling(w.hash), w.first[short], w.first[short] + w.count[short])
        row, h = np.concatenate([row, short]), np.concatenate([h, whole ^ MULT])
    return row, h


def distinct_sets(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, as one array with offsets."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(rows + 1))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each ``[offsets[i], offsets[i+1])``."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each UTF-8 code point."""
    return (data & 0xC0) != 0x80


def unsigned_to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def plane_bytes(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences.

    The high planes of the differences are mostly zero, which Spark's shuffle
    compression removes: about half the bytes of the plain values.
    """
    steps = np.diff(sorted_values.astype(U64), prepend=U64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel())
