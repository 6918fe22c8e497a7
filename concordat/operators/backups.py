"""Versioned backups and conflict copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.config import BackupConfig
from concordat.functions import paths as P
from concordat.operators.listings import backup_filter
from concordat.operators.propagate import only_props
from concordat.operators.reconcile import key_text


def stash_preimages(target: DataFrame, done: DataFrame, keys: Sequence[str], direction: str,
                    taken_at: Column, sync_id: str = "",
                    cfg: BackupConfig = BackupConfig()) -> DataFrame:
    """Old rows of the files a direction is about to overwrite or delete, also
    where it is forced or preferred."""
    hit = done.where((F.col("direction") == direction) & (F.col("outcome") == "success")
                     & ~only_props()).select(*keys)
    rows = target.join(hit, list(keys), "left_semi")
    if "kind" in target.columns:
        rows = rows.where(F.col("kind") == "file")
    wanted = backup_filter(key_text(keys), cfg.backup, cfg.backup_not)
    values = [c for c in target.columns if c not in keys]
    return rows.where(wanted).select(*keys, taken_at.alias("taken_at"),
                                     F.lit(sync_id).alias("sync_id"), F.struct(*values).alias("payload"))


def rotate_backups(backups: DataFrame, keys: Sequence[str], n: int = 2,
                   order: Sequence[Column] = ()) -> DataFrame:
    """Number the copies of each key from the newest (0) and keep ``n``.

    The rank filter is recognised by Catalyst as a group limit: every map task
    keeps n rows per key before the shuffle, so a key with very many copies
    costs no more than any other.
    """
    newest = order or [F.col("taken_at").desc()]
    w = Window.partitionBy(*keys).orderBy(*newest)
    return (backups.drop("version").withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= n).withColumn("version", F.col("_rn") - 1).drop("_rn"))


def backup_name(path: Column, version: Column, cfg: BackupConfig = BackupConfig()) -> Column:
    """Where a version is kept. Central backups repeat the directory below the
    backup folder, local ones sit beside the original; the root has none."""
    number = F.when(version > 0, F.concat(F.lit("."), version.cast("string"))).otherwise("")
    name = F.concat(F.lit(cfg.prefix), P.name(path), F.lit(cfg.suffix), number)
    beside = P.join_path(P.parent(path), name)
    if cfg.location == "central":
        beside = F.concat(F.lit(cfg.backup_dir.rstrip("/") + "/"), beside)
    return F.when(path != "", beside)


def _extension(name: Column) -> Column:
    """The last dot and what follows; empty without a dot or if it comes first."""
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(tail) + 1 < F.length(name), F.concat(F.lit("."), tail)).when(name.isNotNull(), "")


def _without(text: Column, end: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(end))


#: `` (conflict on YYYY-MM-DD)`` and its length.
_LABEL, _LABEL_LENGTH = r"\A \(conflict on \d{4}-\d{2}-\d{2}\)\z", 25


def conflict_copies(conflicts: DataFrame, existing: DataFrame, day: Column) -> DataFrame:
    """Name for a copy of each conflicting file: ``base (conflict on
    YYYY-MM-DD)[.n].ext`` with the first number that is free in its directory.

    The taken numbers of a name, sorted, equal their places up to the first gap,
    so the gap is a count and no numbers are gathered. Names are cut at dots,
    step by step, and only their short ends meet a pattern; the rows are
    shuffled once, by name."""
    name = P.name(F.col("path"))
    wanted = (conflicts.select("path", name.alias("_name")).withColumn("_ext", _extension(F.col("_name")))
              .select("path", P.parent(F.col("path")).alias("dir"),
                      F.concat(_without(F.col("_name"), F.col("_ext")), F.lit(" (conflict on "),
                               F.date_format(day, "yyyy-MM-dd"), F.lit(")")).alias("_base"), "_ext"))
    there = existing.select("path", name.alias("_name")).where(F.col("_name").contains(" (conflict on "))
    there = there.select(P.parent(F.col("path")).alias("dir"), "_name", _extension(F.col("_name")).alias("_ext"))
    # Without an extension the number itself looks like one: "x (conflict …).3".
    whole = F.explode(F.array_compact(F.array(
        F.struct(_without(F.col("_name"), F.col("_ext")).alias("s"), F.col("_ext").alias("e")),
        F.when(F.col("_ext").rlike(r"\A\.\d+\z"), F.struct(F.col("_name").alias("s"), F.lit("").alias("e"))))))
    split = (there.select("dir", whole.alias("t")).select("dir", F.col("t.s").alias("s"), F.col("t.e").alias("_ext"))
             .withColumn("end", _extension(F.col("s")))
             .withColumn("end", F.when(F.col("end").rlike(r"\A\.\d+\z"), F.col("end")).otherwise(""))
             .select("dir", _without(F.col("s"), F.col("end")).alias("_base"), "_ext",
                     F.coalesce(F.substring("end", F.lit(2), F.length("end")).try_cast("long"), F.lit(0)).alias("n")))
    names = ["dir", "_base", "_ext"]
    taken = (split.where(F.substring("_base", -_LABEL_LENGTH, _LABEL_LENGTH).rlike(_LABEL))
             .repartition(*names).distinct())
    place = F.row_number().over(Window.partitionBy(*names).orderBy("n")) - 1
    gaps = (taken.withColumn("_place", place).where(F.col("n") == F.col("_place"))
            .groupBy(*names).agg(F.count(F.lit(1)).alias("_free")))
    j = wanted.join(gaps, names, "left")
    free = F.coalesce("_free", F.lit(0))
    number = F.when(free > 0, F.concat(F.lit("."), free.cast("string"))).otherwise("")
    copy = P.join_path(F.col("dir"), F.concat("_base", number, "_ext"))
    return j.select("path", copy.alias("copy"))


def latest_backup(backups: DataFrame) -> DataFrame:
    return backups.where(F.col("version") == 0)


def restore_version(backups: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Latest copy of each key taken at or before a time. One aggregation with
    map-side combine; no copies are gathered per key."""
    others = [c for c in backups.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.col("taken_at"))
    return (backups.where(F.col("taken_at") <= as_of).groupBy(*keys).agg(newest.alias("_b"))
            .select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others]))
