"""Hashes of words and word shingles of whole texts, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from concordat.llm.arrow import spread

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _factors(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * _A) | U(1)


def byte_table(separators: bytes) -> np.ndarray:
    """What stands for each byte: 0 for a separator, else the byte and 1, A-Z lowered."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[ord("A"):ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of anything but these.
SPACES = byte_table(b" \t\n\v\f\r")


def word_hashes(text: pa.Array, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, words per text, and the byte at which each
    word starts within the batch. Null texts have no words."""
    text = pc.fill_null(text.cast(pa.string()), "")
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    data = table[raw]
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][(ends[:-1] < len(data))]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, U), counts, starts
    at = np.flatnonzero(first[inside])
    letters = data[inside]
    lens = np.diff(np.append(at, len(letters)))
    factors = _factors(1 << int(lens.max() - 1).bit_length() if lens.max() > 1 else 2)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(letters.astype(U) * factors[spread(np.zeros(len(lens)), lens)], at)
        return mix(h + lens.astype(U) * _B), counts, starts


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of runs of ``words`` words; of the whole text if it has fewer."""
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, U(n) * _C, U)
        for k in range(n):
            s = mix(s * _B + h[k:len(h) - n + 1 + k])
    return np.unique(s)
