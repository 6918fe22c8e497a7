"""Sorted plans, pages and directory roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.functions import paths as P
from concordat.operators import reconcile as R
from concordat.operators.ordered import rank_in_groups, with_position

SORT_MODES = ("default", "name", "size", "new_first")


def key_order(keys: Sequence[str]) -> list[Column]:
    """Paths sort component by component, other keys as they are."""
    return [P.path_order(F.col(k)) if k == "path" else F.col(k) for k in keys]


def plan_order(keys: Sequence[str], mode: str = "default") -> list[Column]:
    """Conflicts and problems first, then by path; ``size`` puts large items
    first, ``new_first`` created ones."""
    trouble = F.when(F.col("direction").isin(S.CONFLICT, S.PROBLEM), 0).otherwise(1)
    middle: list[Column] = []
    if mode == "size":
        bytes_ = R.side_bytes("left") + R.side_bytes("right")
        middle = [F.when(F.col("direction") == S.PROBLEM, 0).otherwise(-bytes_)]
    elif mode == "new_first":
        new = R.any_side(lambda s: s == S.CREATED) & (F.col("direction") != S.PROBLEM)
        middle = [F.when(new, 0).otherwise(1)]
    return [trouble, *middle, *key_order(keys)]


def sort_plan(plan: DataFrame, keys: Sequence[str], mode: str = "default") -> DataFrame:
    """The rows that need attention, in plan order (a distributed range sort)."""
    return plan.where(F.col("direction") != S.EQUAL).orderBy(*plan_order(keys, mode))


def rank_plan(plan: DataFrame, keys: Sequence[str], mode: str = "default") -> DataFrame:
    """Plan rows with their ``position`` in plan order."""
    return with_position(plan.where(F.col("direction") != S.EQUAL), plan_order(keys, mode))


def plan_page(plan: DataFrame, keys: Sequence[str], center: int, size: int = 15,
              mode: str = "default") -> DataFrame:
    """Window of rows around a position, for review."""
    start = max(center - size // 2, 1)
    if "position" in plan.columns:
        return plan.where(F.col("position").between(start, start + size - 1))
    # The first rows in plan order by a top-k, then the last ones of these.
    upto = sort_plan(plan, keys, mode).limit(start + size - 1)
    order = plan_order(keys, mode)
    numbered = upto.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("position") >= start).withColumn("position", F.col("position").cast("long"))


# -- trees as (path, value) rows ---------------------------------------------

def subtree_rollup(listing: DataFrame) -> DataFrame:
    """Files and bytes per directory over all descendants.

    Files are first summed per direct parent, so that what is exploded over
    the ancestors is one row per directory and not one per file; the second
    sum is again combined map-side, which keeps hot upper directories cheap.
    """
    files = listing.where(F.col("kind") == "file").select(
        P.parent(F.col("path")).alias("dir"), "length")
    direct = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    above = direct.select("n", "b", F.explode(
        F.concat(F.array(F.lit("")), P.ancestors(F.col("dir")))).alias("path"))
    return above.groupBy("path").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"))


def map_tree(rows: DataFrame, label: Column | None = None, value: Column | None = None,
             col: str = "path") -> DataFrame:
    """Change every component (``label`` sees it as ``F.col('x')``) or the
    value of tree rows."""
    out = rows
    if value is not None:
        out = out.withColumn("value", value)
    if label is not None:
        out = out.withColumn(col, F.array_join(label, "/"))
    return out


def nest_children(rows: DataFrame, page: int) -> DataFrame:
    """Directory rows with sorted arrays of their children.

    The caller says how many children stand in one row; further ones follow in
    rows numbered by ``part``.
    """
    kids = rows.where(F.col("path") != "").select(
        P.parent(F.col("path")).alias("dir"), P.name(F.col("path")).alias("name"))
    ranked = rank_in_groups(kids, ["dir"], [F.col("name")], "rank")
    part = F.floor((F.col("rank") - 1) / page)
    return (ranked.groupBy("dir", part.alias("part"))
            .agg(F.sort_array(F.collect_list("name")).alias("children")))


def empty_subtrees(listing: DataFrame) -> DataFrame:
    """Directories with no file anywhere below."""
    dirs = listing.where(F.col("kind") == "directory").select("path")
    return dirs.join(subtree_rollup(listing).select("path"), "path", "left_anti")
