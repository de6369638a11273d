"""Words of UTF-8 texts as numpy arrays.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, with A-Z lower-cased. Every
multi-byte character of UTF-8 consists of bytes above 127, so words can be cut on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer text makes a step of its own.
STEP_BYTES = 1 << 20

LOWER = np.zeros(256, dtype=np.uint8)  # 0: not part of a word
LOWER[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LOWER[128:] = np.arange(128, 256)

#: The same table for bytes.translate, with a blank for what is not part of a word.
TRANSLATE = bytes(int(b) or 32 for b in LOWER)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, STEP_BYTES + 1), base, dtype=np.uint64)
        table[0] = 1
        have = np.cumprod(table, dtype=np.uint64)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, so that memory does not grow with the batch."""
    offsets = utf8(column)[1]
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 outside words), word starts, word ends, and the word offsets of the rows."""
    low = LOWER[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, beginnings: Sequence[int] = ()):
    """64-bit hash of each word, with starts, ends and the word offsets of the rows.

    ``beginnings`` adds a list of hashes of the words' first so many bytes (of the whole word where it is shorter).
    """
    low, starts, ends, word_offsets = spans(data, offsets)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * _power_table(_BASE, n), out=sums[1:])
    back = _power_table(_INVERSE, n)[starts]
    upto = lambda end, kind: mix((sums[end] - sums[starts]) * back + (end - starts).astype(np.uint64) + np.uint64(kind << 32))
    whole = upto(ends, 0)
    if not beginnings:
        return whole, starts, ends, word_offsets
    return whole, starts, ends, word_offsets, [upto(np.minimum(starts + k, ends), k) for k in beginnings]


def sequence_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of the words of each row, in their order."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power_table(_BASE, n), out=sums[1:])
    starts = offsets[:-1]
    back = np.append(_power_table(_INVERSE, n), np.uint64(1))[starts]
    return mix((sums[offsets[1:]] - sums[starts]) * back + np.diff(offsets).astype(np.uint64))


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their row offsets; a text of fewer words, but not none, is one shingle."""
    counts = np.diff(word_offsets)
    end = np.repeat(word_offsets[1:], counts)
    at = np.arange(len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for j in range(width):
        word = np.where(at + j < end, padded[j : j + len(hashes)], np.uint64(0))
        out = mix(out * np.uint64(_BASE) + word + np.uint64(1))
    keep = (at + width <= end) | (np.isin(at, word_offsets[:-1][counts > 0]) if width > 1 else False)
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[word_offsets]
