"""Comparison of entry properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: coarse file systems keep times in steps of two seconds.
FAT_SECONDS = 2


def _seconds_apart(a: Column, b: Column) -> Column:
    return F.floor(F.abs(F.unix_millis(a) - F.unix_millis(b)) / 1000)


def times_similar(a: Column, b: Column, fat: bool = False) -> Column:
    """Less than a second apart (up to two whole seconds with ``fat``); two
    unknown times are similar, one unknown is not."""
    return F.coalesce(_seconds_apart(a, b) <= (FAT_SECONDS if fat else 0), a.eqNullSafe(b))


def perms_similar(a: Column, b: Column, mask: int = 0o777) -> Column:
    """Equal bits under the mask; unknown permissions count as none."""
    bits = lambda c: F.coalesce(c, F.lit(0)).bitwiseAND(mask)
    return bits(a) == bits(b)


def props_similar(a: Column, b: Column, fat: bool = False, mask: int = 0o777,
                  times: bool = True) -> Column:
    """Two ``struct<perms,mtime,length,…>`` need no property transfer. Owner
    and group are not looked at."""
    same = a["length"].eqNullSafe(b["length"]) & perms_similar(a["perms"], b["perms"], mask)
    return same & times_similar(a["mtime"], b["mtime"], fat) if times else same


def stamp_unchanged(a: Column, b: Column) -> Column:
    """Type, stamp, length and modification time all equal (null-safe)."""
    same = [a[f].eqNullSafe(b[f]) for f in ("kind", "inode", "rescan", "length", "mtime")]
    out = same[0]
    for test in same[1:]:
        out = out & test
    return out
