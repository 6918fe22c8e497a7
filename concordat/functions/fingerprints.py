"""Content and row fingerprints as Spark columns (hex text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the stand-in format: marker bytes 'LEN' and the last byte.
PSEUDO_PREFIX = "4c454e"
PSEUDO_SUFFIX = "00"

#: How a null value is written inside a row fingerprint; the escape character
#: never occurs bare in a value, see :func:`row_fp`.
NULL_MARK = "\\N"


def content_fp(content: Column) -> Column:
    """MD5 of a binary or text value."""
    return F.md5(content)


def range_fp(content: Column, offset: Column | int, length: Column | int) -> Column:
    """MD5 of a byte range (zero-based offset)."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    length = F.lit(length) if isinstance(length, int) else length
    return F.md5(F.substring(content, offset + 1, length))


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Canonical text of a value: floats by a text that reads back as the same
    number (negative zero is zero), instants as microseconds, whatever the
    session's time zone, maps in order of their keys."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(dtype, T.StructType):
        fields = [F.coalesce(_escaped(value_text(value[f.name], f.dataType)), F.lit(NULL_MARK)) for f in dtype.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda x: F.coalesce(_escaped(value_text(x, dtype.elementType)), F.lit(NULL_MARK)))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(dtype, T.MapType):
        pair = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        entries = F.transform(F.map_entries(value), lambda e: value_text(e, pair))
        return F.concat(F.lit("<"), F.array_join(F.array_sort(F.transform(entries, _escaped)), ","), F.lit(">"))
    return value.cast("string")


def _escaped(text: Column) -> Column:
    """Commas and escape characters inside a part of a nested value."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\c"))


def row_fp(df: DataFrame, cols: Sequence[str], texts: Mapping[str, Column] | None = None) -> Column:
    """MD5 over value columns. Nulls are marked and the separator is escaped,
    so different rows never build the same text."""
    texts, parts = dict(texts or {}), []
    for name in cols:
        dtype = df.schema[name].dataType
        text = texts[name] if name in texts else value_text(F.col(name), dtype)
        if name in texts or isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
            text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        parts.append(F.coalesce(text, F.lit(NULL_MARK)))
    return F.md5(F.concat_ws("|", *parts))


def full_fp(data: Column, second: Column | None = None) -> Column:
    """Pair of fingerprints; compare with ``eqNullSafe``."""
    second = F.lit(None).cast("string") if second is None else second
    return F.struct(data.alias("fp"), second.alias("fp2"))


def _hex_le(value: Column, n_bytes: int) -> Column:
    return F.concat(*[
        F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n_bytes)])


def path_hash(path: Column) -> Column:
    """31-polynomial hash over UTF-16 code units, 31 bits."""
    units = F.hex(F.encode(path, "UTF-16BE"))
    count = F.floor(F.length(units) / 4).cast("int")
    code = lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    folded = F.aggregate(
        F.sequence(F.lit(0), count - 1), F.lit(0).cast("long"),
        lambda acc, i: (acc * 31 + code(i)).bitwiseAND(0x7FFFFFFF))
    return F.when(count > 0, folded).otherwise(F.lit(0).cast("long"))


def pseudo_fp(path: Column, size: Column) -> Column:
    """Cheap stand-in built from path and size instead of the content."""
    return F.lower(F.concat(
        F.lit(PSEUDO_PREFIX), _hex_le(size.cast("long"), 8),
        F.lpad(F.hex(path_hash(path)), 8, "0"), F.lit(PSEUDO_SUFFIX)))


def is_pseudo(fp: Column) -> Column:
    return fp.startswith(PSEUDO_PREFIX)


def short_hash(fp: Column) -> Column:
    """First three bytes, little endian."""
    swapped = F.concat(F.substring(fp, 5, 2), F.substring(fp, 3, 2), F.substring(fp, 1, 2))
    return F.conv(swapped, 16, 10).cast("int")


def etag_fp(etag: Column, name: Column, size: Column, mtime: Column) -> Column:
    """MD5 of the entity tag, or a stand-in from name, size and time when the
    server sent none."""
    stamp = F.coalesce(F.concat(F.date_format(mtime, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z")),
                       F.lit("null"))
    label = F.concat_ws(":", name, size.cast("string"), stamp)
    return F.coalesce(F.md5(F.nullif(etag, F.lit(""))), pseudo_fp(label, size))
