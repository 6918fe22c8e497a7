"""Sync history: one table of records, one of entries.

A sync may touch any number of keys, so entries are rows of their own table
and not an array inside the record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.operators.propagate import source_bytes, source_status
from concordat.operators.reconcile import key_text

# Fixed value: records that are kept.
KEEP_RECORDS = 100

#: Words for the two directions; the remote listing uses the second pair.
WORDS = {"local": ("r1to2", "r2to1"), "remote": ("upload", "download")}


def history_entries(done: DataFrame, keys: Sequence[str], sync_id: Column,
                    words: str = "local") -> DataFrame:
    """One entry per succeeded key: what happened, which way, how many bytes."""
    right, left = WORDS[words]
    ok = done.where((F.col("outcome") == "success") & F.col("direction").isin(S.L2R, S.R2L, S.MERGE))
    way = F.when(F.col("direction") == S.L2R, right).when(F.col("direction") == S.R2L, left)
    return ok.select(sync_id.cast("string").alias("sync_id"), key_text(keys).alias("path"),
                     F.coalesce(source_status(), F.lit("merged")).alias("action"),
                     F.coalesce(way, F.lit("both")).alias("direction"), source_bytes().alias("size"))


def history_record(done: DataFrame, sync_id: Column, ts: Column, left: str = "", right: str = "",
                   profile: str | None = None, duration_ms: int = 0) -> DataFrame:
    """One row for the sync; none if nothing succeeded and nothing failed."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    counts = done.agg(n("success").alias("propagated"), n("skipped").alias("skipped"),
                      n("error").alias("failed"))
    return (counts.where((F.col("propagated") > 0) | (F.col("failed") > 0))
            .select(sync_id.cast("string").alias("sync_id"), ts.cast("timestamp").alias("ts"),
                    F.lit(left).alias("left"), F.lit(right).alias("right"),
                    F.lit(profile).cast("string").alias("profile"),
                    "propagated", "skipped", "failed",
                    F.lit(duration_ms).cast("long").alias("duration_ms")))


def recent(records: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` records (a distributed top-k)."""
    return records.orderBy(F.col("ts").desc(), F.col("sync_id").desc()).limit(n)


def file_history(records: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """All syncs that touched a path, newest first."""
    mine = entries.where(F.col("path") == path)
    return (mine.join(records.select("sync_id", "ts"), "sync_id")
            .orderBy(F.col("ts").desc(), F.col("sync_id").desc()))


def all_paths(entries: DataFrame) -> DataFrame:
    return entries.select("path").distinct()


def prune_history(records: DataFrame, keep: int = KEEP_RECORDS) -> DataFrame:
    """Keep the highest ids in text order."""
    return records.orderBy(F.col("sync_id").cast("string").desc()).limit(keep)


def prune_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries of the records that are left."""
    return entries.join(records.select("sync_id"), "sync_id", "left_semi")


def record_summary(records: DataFrame, entries: DataFrame) -> DataFrame:
    files = entries.groupBy("sync_id").agg(F.count(F.lit(1)).alias("n_files"))
    return (records.join(files, "sync_id", "left")
            .select("sync_id", "propagated", "skipped", "failed",
                    F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files")))
