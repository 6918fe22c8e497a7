"""Checks that stop a cycle before it does damage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.operators.propagate import source_missing, target_there


class Refused(RuntimeError):
    """A guard refused to go on."""


def live_rows(side: DataFrame) -> DataFrame:
    """Entries that could be read; a tree's root is none."""
    if "error" in side.columns:
        side = side.where(F.col("error").isNull())
    return side.where(F.col("path") != "") if "path" in side.columns else side


def guard_empty_side(side: DataFrame, base: DataFrame, label: str) -> None:
    """Refuse when a side has no live rows although the base has (two probes that
    stop at the first row)."""
    if live_rows(side).isEmpty() and not live_rows(base).isEmpty():
        raise Refused(f"{label} is empty but the base is not; drop the base to start fresh")


def deletions(plan: DataFrame) -> DataFrame:
    """Rows each direction would delete, forced ones included."""
    return (plan.where(source_missing() & target_there()).groupBy("direction").agg(F.count(F.lit(1)).alias("n_deleted")))


def guard_big_deletes(plan: DataFrame, left: DataFrame, right: DataFrame,
                      fraction: float = 1.0) -> None:
    """Refuse when a side would lose all its rows, or at least a fraction. The
    sides are counted only if something would be deleted there."""
    sides = {S.L2R: right, S.R2L: left}
    for r in deletions(plan).collect():  # at most two rows
        total = sides[r["direction"]].count()
        if total and r["n_deleted"] >= fraction * total:
            raise Refused(f"{r['direction']} would delete {r['n_deleted']} of {total} rows")


def may_save_base(counts: dict[str, int]) -> bool:
    """Whether the base may advance: not if nothing succeeded and something
    failed, nor if the only item was skipped."""
    ok, failed, skipped = (counts.get(k, 0) for k in ("success", "error", "skipped"))
    if ok == 0 and failed > 0:
        return False
    return not (skipped == 1 and ok + failed == 0)


def base_decision(done: DataFrame) -> DataFrame:
    """:func:`may_save_base` as a one-row table."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    counts = done.agg(n("success").alias("ok"), n("error").alias("failed"), n("skipped").alias("skipped"))
    stop: Column = ((F.col("ok") == 0) & (F.col("failed") > 0)) | (
        (F.col("skipped") == 1) & (F.col("ok") + F.col("failed") == 0))
    return counts.withColumn("save_base", ~stop)
