"""Vectorised text kernels for tasks: words and word shingles of whole texts as 64-bit hashes.

All work is on the UTF-8 bytes of an Arrow column: lower-casing touches A-Z only and white space is ASCII, so
bytes of longer characters pass through untouched. Hashes are polynomials modulo 2^64 with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (their words take some 45 bytes of arrays each); one longer text is a piece of its own.
PIECE_BYTES = 1 << 19
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: multiply and shift until every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(29))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES + 1, 1 << int(n).bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.pop(max(_powers))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them), of at most so many bytes or one row; nulls are empty."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the number of words of each row."""
    low = _LOWER[raw]
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = solid[1:]
    first = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _power_tables(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(raw)], out=run[1:])
    hashes = mix64((run[end] - run[first]) * down[first])
    return hashes, first, end, np.diff(np.searchsorted(first, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-word shingle; a row with fewer words has its whole sequence as the only one."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = len(hashes)
    row_of = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(total) + n <= starts[row_of + 1]
    out = np.zeros(total, np.uint64)
    if total >= n:
        full = total - n + 1
        for i in range(n):
            out[:full] = out[:full] * _STEP + hashes[i : i + full]
    got, rows = out[keep], row_of[keep]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            more = counts[few] > i
            short[more] = short[more] * _STEP + hashes[starts[few[more]] + i] + np.uint64(i + 1)
        got, rows = np.concatenate([got, short]), np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        got, rows = got[order], rows[order]
    return mix64(got), rows


def distinct_sorted(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, their rows, and how many each row has."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, rows, np.bincount(rows, minlength=n_rows)
