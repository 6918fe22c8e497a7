"""Bulk edits of a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.operators.reconcile import any_side

SKIPPED_BY_USER = "skipped by user"
DELETION_SKIPPED = "deletion skipped"


def is_conflict() -> Column:
    return F.col("direction") == S.CONFLICT


def is_ltr() -> Column:
    return F.col("direction") == S.L2R


def is_rtl() -> Column:
    return F.col("direction") == S.R2L


def is_merge() -> Column:
    return F.col("direction") == S.MERGE


def is_props_only() -> Column:
    return any_side(lambda s: s == S.PROPS_CHANGED)


def is_created() -> Column:
    return any_side(lambda s: s == S.CREATED)


def is_deleted() -> Column:
    return any_side(lambda s: s == S.DELETED)


def is_modified() -> Column:
    return any_side(lambda s: s == S.MODIFIED)


def not_(test: Column) -> Column:
    return ~test


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def editable() -> Column:
    """Problem rows cannot be edited; equal rows are not shown."""
    return ~F.col("direction").isin(S.PROBLEM, S.EQUAL)


def set_direction(plan: DataFrame, test: Column, direction: str,
                  reason: str | None = None) -> DataFrame:
    """Give the matching rows a direction. :func:`edit_count` with the same
    test says how many there are."""
    hit = test & editable()
    return plan.withColumns({
        "direction": F.when(hit, direction).otherwise(F.col("direction")),
        "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason")),
    })


def edit_count(plan: DataFrame, test: Column) -> DataFrame:
    return plan.agg(F.count(F.when(test & editable(), 1)).alias("n"))


def _to_default(plan: DataFrame, test: Column) -> DataFrame:
    hit = test & editable()
    return plan.withColumns({
        "direction": F.when(hit, F.col("default_direction")).otherwise(F.col("direction")),
        "reason": F.when(hit, F.col("default_reason")).otherwise(F.col("reason")),
    })


def accept_defaults(plan: DataFrame) -> DataFrame:
    return _to_default(plan, ~is_conflict())


def revert_all(plan: DataFrame) -> DataFrame:
    return _to_default(plan, F.lit(True))


def skip_all(plan: DataFrame) -> DataFrame:
    return set_direction(plan, F.lit(True), S.CONFLICT, SKIPPED_BY_USER)


def force_right(plan: DataFrame) -> DataFrame:
    """Everything goes from left to right."""
    return set_direction(plan, F.lit(True), S.L2R)


def force_left(plan: DataFrame) -> DataFrame:
    return set_direction(plan, F.lit(True), S.R2L)


def resolve_conflicts(plan: DataFrame, side: str) -> DataFrame:
    """Conflicts take the state of ``side``."""
    return set_direction(plan, is_conflict(), S.L2R if side == "left" else S.R2L)


def skip_conflicts(plan: DataFrame) -> DataFrame:
    return set_direction(plan, is_conflict(), S.CONFLICT, SKIPPED_BY_USER)


def skip_deletions(plan: DataFrame) -> DataFrame:
    return set_direction(plan, is_deleted(), S.CONFLICT, DELETION_SKIPPED)


def edit_plan(plan: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-key directions from an edits table (keys, ``direction``, optional
    ``reason``); keys without an edit stay."""
    reason = F.col("reason") if "reason" in edits.columns else F.lit(None).cast("string")
    e = edits.select(*keys, F.col("direction").alias("_d"), reason.alias("_r"))
    hit = F.col("_d").isNotNull() & editable()
    return (plan.join(e, list(keys), "left")
            .withColumns({"direction": F.when(hit, F.col("_d")).otherwise(F.col("direction")),
                          "reason": F.when(hit, F.col("_r")).otherwise(F.col("reason"))})
            .drop("_d", "_r"))
