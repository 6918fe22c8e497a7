"""Relative paths (``/``-separated) as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_path(raw: Column) -> Column:
    """``\\`` becomes ``/``, trailing ``/`` go; null when :func:`path_error`
    has something to say."""
    return F.when(path_error(raw).isNull(), _cleaned(raw))


def _slashed(raw: Column) -> Column:
    return F.translate(raw, "\\", "/")


def _cleaned(raw: Column) -> Column:
    return F.rtrim(_slashed(raw), F.lit("/"))


def path_error(raw: Column) -> Column:
    """Why a text is not a relative path, or null."""
    slashed, cleaned = _slashed(raw), _cleaned(raw)
    return (
        F.when(raw.isNull(), "null path")
        .when(slashed.rlike(r"\A(?:/|[\s\S]:)"), "path must be relative")
        .when(cleaned.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), "path must not contain '.' or '..'")
        .when(cleaned.rlike("//"), "path must not contain empty components")
    )


def segments(path: Column) -> Column:
    """Components; the root has none. Arrays compare component by component,
    so this is also the sort key for :func:`path_order`."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


path_order = segments


def depth(path: Column) -> Column:
    slashes = F.length(path) - F.length(F.translate(path, "/", ""))
    return F.when(path == "", F.lit(0)).otherwise(slashes + 1)


def name(path: Column) -> Column:
    """Last component (the root's is empty)."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Path without the last component; null for the root."""
    cut = F.length(path) - F.length(name(path)) - 1
    return F.when(path == "", None).when(cut <= 0, "").otherwise(F.substring(path, F.lit(1), cut))


def first(path: Column) -> Column:
    return F.when(path != "", F.substring_index(path, "/", 1))


def rest(path: Column) -> Column:
    """Path without the first component; null for the root."""
    return F.when(path != "", F.substring(path, F.length(first(path)) + 2, F.length(path)))


def join_path(left: Column, right: Column) -> Column:
    """Append a child or a whole relative path; the root is neutral."""
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat_ws("/", left, right))


def suffix_name(path: Column, suffix: Column | str) -> Column:
    """Append to the last component; the root has no name to extend (null)."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.when(path != "", F.concat(path, suffix))


def absolute_path(root: Column, path: Column) -> Column:
    base = F.rtrim(root, F.lit("/"))
    return F.when(path == "", root).otherwise(F.concat(base, F.lit("/"), path))


def relative_path(root: Column, absolute: Column) -> Column:
    """Inverse of :func:`absolute_path`; null outside the root."""
    base = F.concat(F.rtrim(_slashed(root), F.lit("/")), F.lit("/"))
    full = _slashed(absolute)
    return F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full)))


def ancestors(path: Column) -> Column:
    """Every prefix of a path, the path itself last, the root left out."""
    parts = segments(path)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)),
                    lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFD", s), na_action="ignore")


def _non_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) != F.length(text), text)


def nfc(text: Column) -> Column:
    """Canonical composition. Pure ASCII texts cross to Python as nulls only."""
    return F.coalesce(_nfc(_non_ascii(text)), text)


def nfd(text: Column) -> Column:
    """Canonical decomposition."""
    return F.coalesce(_nfd(_non_ascii(text)), text)


CASE_MODES = ("sensitive", "insensitive", "unicode", "unicode_insensitive")


def path_key(path: Column, mode: str = "sensitive") -> Column:
    """Comparison key of a path or name under a case mode."""
    return {
        "sensitive": lambda: path,
        "insensitive": lambda: F.lower(path),
        "unicode": lambda: nfc(path),
        "unicode_insensitive": lambda: F.lower(nfc(path)),
    }[mode]()


def pair_case_mode(left: str, right: str) -> str:
    """Mode for a pair of replicas: either side insensitive makes both so."""
    unicode = any(m.startswith("unicode") for m in (left, right))
    folded = any(m.endswith("insensitive") for m in (left, right))
    if unicode:
        return "unicode_insensitive" if folded else "unicode"
    return "insensitive" if folded else "sensitive"


def with_path_columns(df: DataFrame, col: str = "path", mode: str = "sensitive") -> DataFrame:
    """Add the derived path columns. Rows whose text is no valid relative path
    keep a null ``path`` and say why in ``error``."""
    raw = F.col(col)
    path = F.col(col)
    out = df.withColumn("error", path_error(raw)).withColumn(col, normalize_path(raw))
    return out.withColumns({
        "segments": segments(path), "depth": depth(path), "parent": parent(path),
        "name": name(path), "path_key": path_key(path, mode),
    })
