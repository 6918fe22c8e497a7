"""Moves, case conflicts and look-alike files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.functions import paths as P
from concordat.operators.ordered import rank_in_groups
from concordat.session import materialize


def _candidates(plan: DataFrame) -> DataFrame:
    """(side, fp, path, gone) of deleted and created files; the fingerprint of a
    deleted file is the one the base remembers."""
    ends = []
    for side in ("left", "right"):
        for status, kind, fp in ((S.DELETED, "prev_kind", "prev_fp"), (S.CREATED, "kind", "fp")):
            fits = (F.col(f"{side}.status") == status) & (F.col(f"{side}.{kind}") == "file")
            ends.append(F.when(fits, F.struct(F.lit(side).alias("side"), F.col(f"{side}.{fp}").alias("fp"),
                                              F.lit(status == S.DELETED).alias("gone"))))
    return (plan.select("path", F.explode(F.array_compact(F.array(*ends))).alias("s"))
            .where(F.col("s.fp").isNotNull()).select("path", "s.*"))


def detect_moves(plan: DataFrame) -> DataFrame:
    """Pair deleted and created files of one side with equal content, one to
    one, in path order.

    Both sets are numbered inside (side, fingerprint) and joined on the
    number: no cross product, also when millions of files are equal (empty
    ones, say). Fingerprints present on one set only never reach the
    numbering.
    """
    both = materialize(_candidates(plan), "moved")
    paired = (both.groupBy("side", "fp").agg(F.bool_or("gone").alias("g"), F.bool_or(~F.col("gone")).alias("n"))
              .where("g and n").select("side", "fp"))
    both = both.join(paired, ["side", "fp"], "left_semi")
    ranked = rank_in_groups(both, ["side", "fp", "gone"], [P.path_order(F.col("path"))], "rank")
    gone = ranked.where("gone").select("side", "fp", "rank", F.col("path").alias("old_path"))
    new = ranked.where("not gone").select("side", "fp", "rank", F.col("path").alias("new_path"))
    return gone.join(new, ["side", "fp", "rank"]).select("side", "old_path", "new_path", "fp")


def annotate_moves(plan: DataFrame, moves: DataFrame) -> DataFrame:
    """Add ``left_move`` and ``right_move``: (kind, other_path) for both ends."""
    out = plan
    for side in ("left", "right"):
        mine = moves.where(F.col("side") == side)
        ends = mine.select(
            F.explode(F.array(
                F.struct(F.col("old_path").alias("path"), F.lit("moved_out").alias("kind"),
                         F.col("new_path").alias("other_path")),
                F.struct(F.col("new_path").alias("path"), F.lit("moved_in").alias("kind"),
                         F.col("old_path").alias("other_path")))).alias("e"))
        out = out.join(
            ends.select("e.path", F.struct("e.kind", "e.other_path").alias(f"{side}_move")),
            "path", "left")
    return out


def move_rows(df: DataFrame, moves: DataFrame, col: str = "path") -> DataFrame:
    """Rename keys within one side."""
    m = moves.select(F.col("old_path").alias(col), F.col("new_path").alias("_new"))
    return (df.join(m, col, "left").withColumn(col, F.coalesce("_new", col))
            .select(*df.columns))


def detect_case_conflicts(listing: DataFrame, mode: str = "insensitive") -> DataFrame:
    """Names in one directory that differ by case only: the first in name
    order with each later one. Linear in the conflicts, never all pairs."""
    rows = listing.where(F.col("path") != "").select(
        P.parent(F.col("path")).alias("directory"), P.name(F.col("path")).alias("name"))
    keyed = rows.withColumn("_key", P.path_key(F.col("name"), mode))
    groups = (keyed.groupBy("directory", "_key")
              .agg(F.min("name").alias("name1"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).drop("_n"))
    return (keyed.join(groups, ["directory", "_key"])
            .where(F.col("name") != F.col("name1"))
            .select("directory", "name1", F.col("name").alias("name2")))


def same_file_guess(listing: DataFrame) -> DataFrame:
    """Likely hard links: same size, time and type. The relation is an
    equivalence, so each member is paired with the first path of its class
    instead of with every other member."""
    cls = ["kind", "length", "mtime"]
    known = listing.where(F.col("length").isNotNull() & F.col("mtime").isNotNull()).select("path", *cls)
    groups = (known.groupBy(*cls).agg(F.min("path").alias("path1"), F.count(F.lit(1)).alias("n_class"))
              .where(F.col("n_class") > 1))
    return (known.join(groups, cls).where(F.col("path") != F.col("path1"))
            .select("path1", F.col("path").alias("path2"), "n_class"))
