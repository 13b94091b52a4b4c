"""Fast similarity sketches of sets of 64-bit hashes.

A sketch has t coordinates.  In round i every element of the set falls into a bin
chosen by hashing and brings a value; a bin keeps the least value of the first
round that reaches it, and rounds go on while a bin is empty.  From round t
on all elements go to bin i - t, so after 2t rounds every bin is full.  A
coordinate agrees for two sets with a probability equal to their Jaccard
similarity, and the number of agreements is concentrated as for independent
coordinates, while a large set costs little more than one round.
"""

from __future__ import annotations

import numpy as np

from pubweave.llm.shingles import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROUNDS = mix(np.arange(1, 4097, dtype=np.uint64))


def sketches(flat: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates per set; a set without elements has no meaning."""
    n = len(offsets) - 1
    sketch = np.full(n * t, _EMPTY)
    row = np.repeat(np.arange(n), np.diff(offsets))
    element = flat
    for i in range(2 * t):
        if not len(element):
            break
        hashed = mix(element + _ROUNDS[i % len(_ROUNDS)] + np.uint64(i))
        value = (np.uint64(i) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
        if i < t:
            bins = ((hashed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(element), i - t)
        np.minimum.at(sketch, row * t + bins, value)
        # Rows whose bins are all full are done.
        rows = row[np.append(True, row[1:] != row[:-1])]
        open_rows = (sketch.reshape(n, t)[rows] == _EMPTY).any(axis=1)
        if not open_rows.all():
            is_open = np.zeros(n, bool)
            is_open[rows[open_rows]] = True
            keep = is_open[row]
            row, element = row[keep], element[keep]
    return sketch.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of ``rows`` coordinates; keys of different bands differ."""
    keys = np.repeat(
        mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :], len(sketch), axis=0
    )
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    for i in range(rows):
        keys = mix(keys * _STEP + parts[:, :, i])
    return keys
