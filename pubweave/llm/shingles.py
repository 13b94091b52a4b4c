"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; longer texts stand alone.
CHUNK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xCF1BBCDCBFA56351)
    return x ^ (x >> np.uint64(32))


#: The bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: The same for words of letters and digits: punctuation separates them too, and
#: capital letters of Latin-1, two bytes in UTF-8, become small as well.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = (
    False
)

#: Places in a word whose byte numbers are kept in a table.
_NEAR = 64
_PLACES: dict[int, np.ndarray] = {}

_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of every run follows, see run_hash()."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("base", _BASE, len(values)), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of runs, the same wherever a run stands."""
    inverse = _powers("inverse", _INVERSE, len(sums))
    return (sums[ends] - sums[starts]) * inverse[starts]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows, not copied."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def _place_numbers(lower: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A number for every byte that depends on its place in the word as well."""

    def number(codes: np.ndarray) -> np.ndarray:
        return mix((codes.astype(np.uint64) + np.uint64(1)) * _ODD + mix(np.uint64([seed])))

    table = _PLACES.get(seed)
    if table is None:
        table = _PLACES[seed] = number(np.arange(_NEAR << 8))
    code = (place << 8) | lower
    far = np.flatnonzero(place >= _NEAR)
    found = table[np.minimum(code, len(table) - 1)]
    found[far] = number(code[far])
    return found


def word_hashes(
    data: np.ndarray,
    offsets: np.ndarray,
    letters_only: bool = False,
    separators: np.ndarray | None = None,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and last byte + 1 of every word, and words before each row.

    ``offsets`` are those of consecutive rows in ``data``.  Words lie between ASCII
    white space, between bytes for which ``separators`` is true, or are runs of
    letters and digits.  A hash is the sum of numbers drawn for every byte at every
    place in the word, so that no rearrangement of its bytes has the same sum.
    """
    base = int(offsets[0])
    data, bounds = data[base : int(offsets[-1])], offsets - base
    if separators is None:
        separators = _NO_LETTER if letters_only else _SPACE
    word = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    lower = _LOWER[data]
    if letters_only:
        lower[1:][(data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    place = np.arange(len(data))
    place -= np.maximum.accumulate(np.where(begins, place, 0))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_place_numbers(lower, place, seed), out=sums[1:])
    hashes = mix(sums[ends] - sums[starts])
    return hashes, starts + base, ends + base, np.searchsorted(starts, bounds)


def shingle_hashes(
    words: np.ndarray, before: np.ndarray, k: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and shingles before each row.

    A row of fewer than k words has them all as its one shingle; one without
    words has none.
    """
    n = np.diff(before)
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    after = np.append(0, np.cumsum(per_row))
    short = np.flatnonzero((n > 0) & (n < k))
    # Position of the first word of every shingle.
    first = np.arange(after[-1]) + np.repeat(before[:-1] - after[:-1], per_row)
    padded = np.append(words, np.zeros(k, np.uint64))
    sums = np.zeros(len(first), np.uint64)
    for i in range(k):
        sums = mix(sums * _ODD + padded[first + i])
    for row in short.tolist():
        total = np.zeros(1, np.uint64)
        for word in words[before[row] : before[row + 1]]:
            total = mix(total * _ODD + word)
        sums[after[row]] = mix(total + np.uint64(n[row]))[0]
    return sums, after


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, k: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, flat, and their offsets."""
    words, _, _, before = word_hashes(data, offsets)
    flat, after = shingle_hashes(words, before, k)
    bounds = after.tolist()
    sets = [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (
        np.concatenate(sets) if sets else np.zeros(0, np.uint64),
        np.append(0, np.cumsum(sizes)),
    )
