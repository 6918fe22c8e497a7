"""Filters over listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import paths as P
from concordat.functions import patterns as M
from concordat.session import materialize

# Fixed value: longest chain of links that is followed.
MAX_HOPS = 100


def prune_ignored(df: DataFrame, ignore: Sequence[str], ignore_not: Sequence[str] = (),
                  col: str = "path") -> DataFrame:
    """Drop ignored entries and all below them. Decided row by row, no shuffle."""
    return df.where(~M.ignored_or_below(F.col(col), ignore, ignore_not))


def select_paths(df: DataFrame, paths: Sequence[str], col: str = "path") -> DataFrame:
    """Restrict to the given sub-paths (no paths, or the root, mean everything)."""
    wanted = [p for p in paths if p]
    if not wanted or len(wanted) < len(paths):
        return df
    test = F.lit(False)
    for p in wanted:
        test = test | (F.col(col) == p) | F.col(col).startswith(p + "/")
    return df.where(test)


def max_size(df: DataFrame, kb: int) -> DataFrame:
    """Leave out entries larger than ``kb`` kilobytes (0 = no limit)."""
    return df if kb <= 0 else df.where(F.col("length").isNull() | (F.col("length") <= kb * 1024))


def include_links(df: DataFrame, flag: bool) -> DataFrame:
    return df if flag else df.where(F.col("kind") != "symlink")


def backup_filter(path: Column, backup: Sequence[str], backup_not: Sequence[str] = ()) -> Column:
    """Entries that get backups."""
    return M.any_of(path, backup) & ~M.any_of(path, backup_not)


def atomic_group(path: Column, patterns: Sequence[str]) -> Column:
    """Topmost ancestor that is to be treated as one unit, or null."""
    matching = F.filter(P.ancestors(path), lambda a: M.any_of(a, patterns))
    return F.get(matching, F.lit(0))


def atomic_groups(plan: DataFrame, patterns: Sequence[str], col: str = "path") -> DataFrame:
    """A conflict anywhere inside an atomic directory makes all its rows
    conflict.

    Conflicting groups are reduced to one row each before they meet the plan;
    no group is ever brought together in one task.
    """
    grouped = materialize(plan.withColumn("_group", atomic_group(F.col(col), patterns)), "grouped")
    bad = (grouped.where(F.col("_group").isNotNull() & F.col("direction").isin("conflict", "problem"))
           .select("_group").distinct().withColumn("_bad", F.lit(True)))
    inside = grouped.where(F.col("_group").isNotNull())
    joined = inside.join(bad, "_group", "left")
    hit = F.col("_bad") & ~F.col("direction").isin("conflict", "problem", "equal")
    marked = (joined.withColumn("reason", F.when(hit, "conflict inside atomic directory")
                                .otherwise(F.col("reason")))
              .withColumn("direction", F.when(hit, "conflict").otherwise(F.col("direction"))))
    return (grouped.where(F.col("_group").isNull()).select(*plan.columns)
            .unionByName(marked.select(*plan.columns)))


def resolve_dots(path: Column) -> Column:
    """Remove ``.`` and resolve ``..`` inside a relative path; null when it
    leaves the root."""
    step = lambda acc, s: (
        F.when(acc.isNull() | s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)"), F.array_join(folded, "/")).otherwise(path)


def link_targets(df: DataFrame) -> DataFrame:
    """Links with the path they point to (``next``; null outside the root)."""
    base = P.parent(F.col("path"))
    relative = P.join_path(base, F.col("target"))
    raw = F.when(F.col("target").startswith("/"), None).otherwise(relative)
    return df.where(F.col("kind") == "symlink").select("path", resolve_dots(raw).alias("next"))


def follow_links(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Replace matching link rows by the row their chain of links ends at.

    Chains are shortened by doubling: after k joins of the link table with
    itself every link has advanced 2**k hops, so seven joins cover the limit
    of 100 instead of one join per hop. Each round is written out, which keeps
    the plan of the next one flat. A link that can't be resolved stays a
    link: on or into a cycle, beyond the limit, out of the listing, or to nothing.
    """
    links = materialize(link_targets(df), "links")
    chain = links.withColumns({"hops": F.lit(1), "open": F.lit(True)})
    for _ in range(MAX_HOPS.bit_length()):
        ahead = chain.select(F.col("path").alias("next"), F.col("next").alias("_next"),
                             F.col("hops").alias("_hops"), F.lit(True).alias("_is_link"))
        moving = F.coalesce(F.col("_is_link"), F.lit(False))
        chain = materialize(chain.join(ahead, "next", "left").select(
            "path",
            F.when(moving, F.col("_next")).otherwise(F.col("next")).alias("next"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            moving.alias("open")), "links")
        if chain.where("open").isEmpty():
            break
    wanted = links.where(M.any_of(F.col("path"), patterns)).select("path")
    still_links = links.select(F.col("path").alias("next"))
    ends = chain.join(wanted, "path", "left_semi").where(F.col("hops") <= MAX_HOPS)
    ends = ends.join(still_links, "next", "left_anti").select("path", "next")
    others = [c for c in df.columns if c != "path"]
    targets = df.where(F.col("kind") != "symlink").select(F.col("path").alias("next"), *others)
    followed = materialize(ends.join(targets, "next").select(*df.columns), "followed")
    return df.join(followed.select("path"), "path", "left_anti").unionByName(followed)
