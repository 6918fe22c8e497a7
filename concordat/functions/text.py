"""Human-readable sizes, rates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units.
KB, MB, GB = 1024, 1024 ** 2, 1024 ** 3


def _fixed(value: Column, digits: int) -> Column:
    return value.cast("double").cast(f"decimal(38,{digits})").cast("string")


def format_bytes(n: Column) -> Column:
    """Also for decimals, whose own division would round to fewer digits."""
    of = lambda unit: _fixed(n.cast("double") / unit, 1)
    return (F.when(n < KB, F.concat(n.cast("long").cast("string"), F.lit(" B")))
            .when(n < MB, F.concat(of(KB), F.lit(" KB")))
            .when(n < GB, F.concat(of(MB), F.lit(" MB")))
            .when(n.isNotNull(), F.concat(of(GB), F.lit(" GB"))))


def format_rate(rate: Column) -> Column:
    return (F.when(rate < KB, F.concat(_fixed(rate, 0), F.lit(" B/s")))
            .when(rate < MB, F.concat(_fixed(rate / KB, 1), F.lit(" KB/s")))
            .when(rate.isNotNull(), F.concat(_fixed(rate / MB, 1), F.lit(" MB/s"))))


def format_eta(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; unknown is ``--:--``."""
    whole = lambda c: F.floor(c).cast("string")
    return (F.when(seconds.isNull(), "--:--")
            .when(seconds >= 3600, F.concat(whole(seconds / 3600), F.lit("h "),
                                            whole(seconds % 3600 / 60), F.lit("m")))
            .when(seconds >= 60, F.concat(whole(seconds / 60), F.lit("m "),
                                          whole(seconds % 60), F.lit("s")))
            .otherwise(F.concat(whole(seconds), F.lit("s"))))


def items_text(done: Column, total: Column) -> Column:
    return F.concat(done.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" items"))


def progress_text(done: Column, total: Column) -> Column:
    return F.concat(format_bytes(done), F.lit(" / "), format_bytes(total))
