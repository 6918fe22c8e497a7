"""Block sizes and rolling checksums."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the block format.
MIN_BLOCK, MAX_BLOCK = 700, 131072
WEAK_BASE = 16381
WEAK_BITS = 31
FALSE_MATCH_BITS, WEAK_USEFUL_BITS = 120, 27
STRONG_MIN, STRONG_MAX = 2, 16

_MASK = np.uint64((1 << WEAK_BITS) - 1)
_BASE_INVERSE = pow(WEAK_BASE, -1, 1 << 64)


def block_size(length: Column) -> Column:
    """Power of two nearest to the square root of the length, within bounds."""
    power = F.pow(F.lit(2.0), F.round(F.ln(F.sqrt(length.cast("double"))) / F.ln(F.lit(2.0))))
    clamped = F.least(F.greatest(power, F.lit(float(MIN_BLOCK))), F.lit(float(MAX_BLOCK)))
    return F.when(length > 0, clamped.cast("int")).otherwise(F.lit(MIN_BLOCK))


def checksum_size(src: Column, dst: Column, block: Column) -> Column:
    """Bytes of the strong checksum the classic length formula asks for."""
    pairs = F.ceil(src / block).cast("double") * F.ceil(dst / block).cast("double")
    needed = (F.ln(pairs) / F.ln(F.lit(2.0)) - (FALSE_MATCH_BITS + WEAK_USEFUL_BITS)) / 8
    clamped = F.least(F.greatest(F.ceil(needed), F.lit(STRONG_MIN)), F.lit(STRONG_MAX))
    return F.when((src == 0) | (dst == 0), F.lit(STRONG_MIN)).otherwise(clamped.cast("int"))


def _powers(factor: int, n: int) -> np.ndarray:
    steps = np.full(n, factor, dtype=np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


def weak_of(data: bytes) -> int:
    """Polynomial checksum of a whole byte string."""
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    return int((values * _powers(WEAK_BASE, len(values))[::-1]).sum() & _MASK)


def weak_at_every_offset(data: bytes, window: int) -> np.ndarray:
    """Checksums of all windows of a byte string.

    With S the prefix sums of c_i * base**-i (mod 2**64), a window starting at
    o has the checksum base**(o+window-1) * (S[o+window] - S[o]). The base is
    odd, so the inverse exists and the arithmetic is exact.
    """
    n = len(data)
    if window <= 0 or n < window:
        return np.zeros(0, dtype=np.int64)
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE_INVERSE, n), out=sums[1:])
    scale = _powers(WEAK_BASE, n)[window - 1:]
    return ((sums[window:] - sums[:-window]) * scale & _MASK).astype(np.int64)


@F.pandas_udf(T.IntegerType())
def weak_hash(content: pd.Series) -> pd.Series:
    """Weak checksum of each binary value."""
    return content.map(weak_of, na_action="ignore").astype("Int32")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def block_weak_hashes(content: pa.Array, block: pa.Array) -> pa.Array:
    """Weak checksums of the consecutive blocks of each binary value. Values
    leave the Arrow batch one at a time."""
    sums, counts = array("i"), []
    for c, b in zip(content, block.to_pylist(), strict=True):
        c, before = c.as_py(), len(sums)
        sums.extend(weak_of(c[i:i + b]) for i in range(0, len(c), b))
        counts.append(len(sums) - before)
    return pa.ListArray.from_arrays(_offsets(counts), pa.array(np.frombuffer(sums, np.int32), pa.int32()))


def _offsets(counts: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def rolling_weak(content: pd.Series, window: pd.Series) -> pd.Series:
    """Weak checksum at every offset (for inspection of bounded values)."""
    return pd.Series([weak_at_every_offset(c, int(w)) for c, w in zip(content, window)])


MATCHES = T.ArrayType(T.StructType([
    T.StructField("off", T.IntegerType()), T.StructField("block", T.IntegerType())]))

#: Bytes scanned at a time; keeps the arrays of a large value small.
SCAN_CHUNK = 4 << 20


def _hits(data: bytes, block: int, wanted: np.ndarray):
    """Offsets whose weak checksum is wanted, in order, chunk by chunk."""
    pos = 0
    while pos + block <= len(data):
        piece = data[pos:pos + SCAN_CHUNK + block - 1]
        sums = weak_at_every_offset(piece, block)
        yield pos + np.flatnonzero(np.isin(sums, wanted))
        pos += len(sums)


@F.arrow_udf(MATCHES)
def matching_offsets(content: pa.Array, block: pa.Array, weak: pa.Array,
                     strong: pa.Array, number: pa.Array) -> pa.Array:
    """Left-to-right, non-overlapping places where a known block occurs.

    ``weak``/``strong``/``number`` are the distinct signatures of the old
    value. The byte scan is vectorised; the strong checksum is computed only
    where the weak one is known and the previous match has ended, and a match
    is passed in one step, so repetitive values cost no more than others.
    Values leave the Arrow batch one at a time, and the places are kept as
    numbers: a batch is never held a second time as Python objects.
    """
    offs, blocks, counts = array("i"), array("i"), []
    for data, size, ws, ss, ns in zip(content, block.to_pylist(), weak, strong, number, strict=True):
        known, free, before = dict(zip(ss.as_py(), ns.as_py(), strict=True)), 0, len(offs)
        if known:
            data = data.as_py()
            for offsets in _hits(data, size, np.asarray(ws.as_py(), dtype=np.int64)):
                i = int(np.searchsorted(offsets, free))
                while i < len(offsets):
                    off = int(offsets[i])
                    n = known.get(hashlib.md5(data[off:off + size]).hexdigest())
                    if n is None:
                        i += 1
                        continue
                    offs.append(off)
                    blocks.append(n)
                    free = off + size
                    i = int(np.searchsorted(offsets, free))  # over all that the match covers
        counts.append(len(offs) - before)
    places = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, np.int32), pa.int32()) for x in (offs, blocks)], names=["off", "block"])
    return pa.ListArray.from_arrays(_offsets(counts), places)
