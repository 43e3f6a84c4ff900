"""64-bit hashes of words and word shingles over Arrow string columns, vectorised over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vitrine.llm.common import text_buffers

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are hashed in pieces of about this many bytes, cut at white space.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def _hash_piece(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data and where they start; a word also ends at a break (the start of a text)."""
    word = ~_SPACE[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts = at[:-1][word[at[:-1]]]
    ends = at[1:][word[at[:-1]]]
    power, inverse = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts


def word_hashes(column: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """For each text of the column, the hashes of its words in order. lower: A-Z count as a-z."""
    data, offsets = text_buffers(column)
    table, row = _LOWER if lower else _BYTE, 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        if end > row + 1 or offsets[end] - offsets[row] <= PIECE:
            local = offsets[row : end + 1] - offsets[row]
            hashes, starts = _hash_piece(data[offsets[row] : offsets[end]], local[:-1][local[:-1] < local[-1]], table)
            yield from np.split(hashes, np.searchsorted(starts, local[1:-1]))
        else:
            yield _long_text(data[offsets[row] : offsets[end]], table)
        row = end


def _long_text(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + PIECE)
        parts.append(_hash_piece(data[start:end], np.zeros(0, np.int64), table)[0])
        start = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of all words together if there are fewer than k, and none without words."""
    size = min(k, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - size + 1] + np.uint64(size)
    for j in range(1, size):
        out = mix(out * _JOIN) + words[j : len(words) - size + 1 + j]
    return mix(out)
