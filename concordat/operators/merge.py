"""Row merges of keys that changed on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import patterns as M
from concordat.operators.reconcile import key_text


def parse_rule(spec: str) -> tuple[str, str] | None:
    """``pattern -> strategy``; null when a part is missing."""
    found = re.match(r"\s*(\S.*?)\s*->\s*(\S.*?)\s*\Z", spec)
    return (found[1], found[2]) if found else None


def merge_column(base: Column, left: Column, right: Column) -> Column:
    """The side that changed wins; equal changes agree. Null also stands for a
    conflict, ask :func:`column_conflict`."""
    return (F.when(right.eqNullSafe(base), left).when(left.eqNullSafe(base), right)
            .when(left.eqNullSafe(right), left))


def column_conflict(base: Column, left: Column, right: Column) -> Column:
    return ~(left.eqNullSafe(base) | right.eqNullSafe(base) | left.eqNullSafe(right))


Strategy = Callable[[Column, Column, Column], Column]


def strategies(mtime: str | None = None) -> dict[str, Strategy]:
    """Built-in column strategies. ``newer`` needs the name of a time column."""
    longest = lambda b, l, r: F.when(
        F.length(r.cast("string")) > F.length(l.cast("string")), r).otherwise(F.coalesce(l, r))
    known: dict[str, Strategy] = {
        "column": merge_column,
        "left": lambda b, l, r: l,
        "right": lambda b, l, r: r,
        "longest": longest,
    }
    if mtime:
        known["newer"] = lambda b, l, r: F.when(F.col(f"r.{mtime}") > F.col(f"l.{mtime}"), r).otherwise(l)
    return known


def three_way_merge(base: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str],
                    values: Sequence[str], wanted: DataFrame | None = None,
                    rules: Sequence[str] = (), mtime: str | None = None,
                    extra: Mapping[str, Strategy] | None = None) -> DataFrame:
    """Merge rows column by column.

    ``wanted`` restricts the work to the keys of a plan before anything is
    joined. ``rules`` choose a strategy per key, the first match wins, the
    default is ``column``. Rows with a conflict list the columns; others hold
    the merged values for both sides.
    """
    known = {**strategies(mtime), **(extra or {})}
    parsed = [r for r in (parse_rule(s) for s in rules) if r]
    unknown = {s for _, s in parsed} - set(known)
    if unknown:
        raise ValueError(f"unknown merge strategies: {sorted(unknown)}")

    def side(df: DataFrame, label: str) -> DataFrame:
        if wanted is not None:
            df = df.join(wanted.select(*keys), list(keys), "left_semi")
        fields = [*values, *([mtime] if mtime and mtime in df.columns and mtime not in values else [])]
        return df.select(*keys, F.struct(*fields).alias(label))

    j = side(left, "l").join(side(right, "r"), list(keys)).join(side(base, "b"), list(keys), "left")
    chosen = M.first_match(key_text(keys), [(p, F.lit(s)) for p, s in parsed])
    j = j.withColumn("strategy", F.coalesce(chosen.cast("string"), F.lit("column")))
    merged, conflicts = {}, []
    for v in values:
        b, l, r = F.col(f"b.{v}"), F.col(f"l.{v}"), F.col(f"r.{v}")
        value = merge_column(b, l, r)
        for s in sorted({s for _, s in parsed} - {"column"}):
            value = F.when(F.col("strategy") == s, known[s](b, l, r)).otherwise(value)
        merged[v] = value
        by_column = F.col("strategy") == "column"
        conflicts.append(F.when(by_column & column_conflict(b, l, r), F.lit(v)))
    out = j.withColumn("conflict_columns", F.array_compact(F.array(*conflicts)))
    return out.select(*keys, *[merged[v].alias(v) for v in values], "strategy", "conflict_columns",
                      (F.size("conflict_columns") == 0).alias("clean"))
