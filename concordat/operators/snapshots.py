"""Turning tables and listings into comparable snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import fingerprints as FP


class KeyViolation(ValueError):
    """Keys are null or not unique."""


def check_keys(df: DataFrame, keys: Sequence[str], *others: DataFrame) -> DataFrame:
    """Fail with the offending counts if a key is null or occurs twice in one
    of the tables.

    One job for all tables, one aggregation over the key columns only; what
    comes back are two numbers.
    """
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    tables = [t.select(F.lit(i).alias("_table"), *keys) for i, t in enumerate((df, *others))]
    counts = (reduce(DataFrame.unionByName, tables).groupBy("_table", *keys).count()
              .agg(F.sum(F.when(some_null, F.col("count"))).alias("nulls"),
                   F.sum(F.when(~some_null & (F.col("count") > 1), 1)).alias("twice"))
              .first())
    nulls, twice = counts["nulls"] or 0, counts["twice"] or 0
    if nulls or twice:
        raise KeyViolation(f"keys {list(keys)}: {nulls} null rows, {twice} keys more than once")
    return df


def snapshot_table(df: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None,
                   mtime: str | None = None, check: bool = False) -> DataFrame:
    """Any keyed table as a replica: its rows plus ``kind`` and the row
    fingerprint, and optionally a column that serves as modification time.
    The fingerprint is computed before any shuffle, so later steps carry
    32 characters instead of the row."""
    values = list(values or [c for c in df.columns if c not in keys])
    out = df.withColumns({"kind": F.lit("file"), "fp": FP.row_fp(df, values)})
    if mtime:
        out = out.withColumn("mtime", F.col(mtime).cast("timestamp"))
    return check_keys(out, keys) if check else out


def build_base(listing: DataFrame, ignore: Sequence[str] = (), ignore_not: Sequence[str] = (),
               pseudo: bool = False) -> DataFrame:
    """First base from a listing: ignored entries and everything below them
    left out, fingerprints taken over (or stand-ins for files)."""
    from concordat.operators.listings import prune_ignored

    out = prune_ignored(listing, ignore, ignore_not)
    if pseudo:
        stand_in = F.when(F.col("kind") == "file", FP.pseudo_fp(F.col("path"), F.col("length")))
        out = out.withColumn("fp", stand_in)
    return out


def reuse_fp(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Take the fingerprint of entries whose path, length and time are cached;
    ``fp`` stays null where it has to be computed."""
    known = cache.select("path", "length", "mtime", F.col("fp").alias("_cached"))
    out = listing.drop("fp").join(known, ["path", "length", "mtime"], "left")
    return out.withColumnRenamed("_cached", "fp")


def update_fp_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert entries by path."""
    kept = cache.join(fresh.select("path"), "path", "left_anti")
    return kept.unionByName(fresh.select(*cache.columns))


def invalidate(cache: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Drop the given paths, or everything."""
    if paths is None:
        return cache.limit(0)
    return cache.join(paths.select("path"), "path", "left_anti")


def fingerprint_suspects(listing: DataFrame, base: DataFrame, cache: DataFrame | None = None,
                         use_fast_check: bool = True, pseudo_new_files: bool = False) -> DataFrame:
    """Files whose content has to be read. ``fp`` is filled where metadata or
    the cache settle it; ``suspect`` marks the rest.

    Metadata only: no content column passes through this join.
    """
    b = base.select("path", F.col("kind").alias("_bkind"), F.col("length").alias("_blen"),
                    F.col("mtime").alias("_bmtime"), F.col("fp").alias("_bfp"))
    j = listing.drop("fp").join(b, "path", "left")
    same = (F.col("_bkind") == "file") & (F.col("length") == F.col("_blen")) & (
        F.unix_millis("mtime") == F.unix_millis("_bmtime"))
    fp = F.when(same & F.lit(use_fast_check), F.col("_bfp"))
    if pseudo_new_files:
        fp = F.coalesce(fp, F.when(F.col("_bkind").isNull(),
                                   FP.pseudo_fp(F.col("path"), F.col("length"))))
    if cache is not None and use_fast_check:
        known = cache.select("path", "length", "mtime", F.col("fp").alias("_cfp"))
        j = j.join(known, ["path", "length", "mtime"], "left")
        fp = F.coalesce(fp, F.col("_cfp"))
    is_file = F.col("kind") == "file"
    return (j.withColumn("fp", F.when(is_file, fp))
            .withColumn("suspect", is_file & F.col("fp").isNull() & F.col("error").isNull()
                        if "error" in listing.columns else is_file & F.col("fp").isNull())
            .select(*[c for c in listing.columns if c != "fp"], "fp", "suspect"))


def fingerprint_table(suspects: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """Second stage over a content table: only suspect paths are joined to
    the contents, the hash is taken before anything else moves."""
    hashed = contents.select("path", FP.content_fp(F.col(content)).alias("_fp"))
    todo = suspects.where("suspect").select("path")
    fresh = hashed.join(todo, "path", "left_semi")
    out = suspects.join(fresh, "path", "left")
    return out.withColumn("fp", F.coalesce("fp", "_fp")).drop("_fp", "suspect")
