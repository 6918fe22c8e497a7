"""Fixed column sets of the tables that travel between operators."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT_VERSION = 1

PROPS = T.StructType([
    T.StructField("perms", T.IntegerType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("owner", T.IntegerType()),
    T.StructField("grp", T.IntegerType()),
])

#: Columns describing the state of one entry, besides its keys.
STATE = {
    "kind": T.StringType(),
    "fp": T.StringType(),
    "fp2": T.StringType(),
    "length": T.LongType(),
    "mtime": T.TimestampType(),
    "perms": T.IntegerType(),
    "owner": T.IntegerType(),
    "grp": T.IntegerType(),
    "target": T.StringType(),
    "error": T.StringType(),
}

LISTING = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("perms", T.IntegerType()),
    T.StructField("owner", T.IntegerType()),
    T.StructField("grp", T.IntegerType()),
    T.StructField("target", T.StringType()),
    T.StructField("error", T.StringType()),
])

FP_CACHE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("fp", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("perms", T.IntegerType()),
    T.StructField("format_version", T.IntegerType()),
])

HISTORY_RECORD = T.StructType([
    T.StructField("sync_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("left", T.StringType()),
    T.StructField("right", T.StringType()),
    T.StructField("profile", T.StringType()),
    T.StructField("propagated", T.LongType()),
    T.StructField("skipped", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
])

HISTORY_ENTRY = T.StructType([
    T.StructField("sync_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("size", T.LongType()),
])

#: Status values of one side.
UNCHANGED, CREATED, MODIFIED, PROPS_CHANGED, DELETED, ERROR = (
    "unchanged", "created", "modified", "propsChanged", "deleted", "error")

#: Directions of a plan row. ``equal`` rows need no action and are only counted.
L2R, R2L, CONFLICT, MERGE, PROBLEM, EQUAL = (
    "l2r", "r2l", "conflict", "merge", "problem", "equal")
