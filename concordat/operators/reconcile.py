"""Reconciliation: two update sets become a plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import LEFT, PlanConfig, UpdateConfig
from concordat.functions import paths as P
from concordat.functions import patterns as M
from concordat.functions import props as PR
from concordat.operators.tree import bind_subtrees

SIDE_FIELDS = ["status", "kind", "prev_kind", "fp", "fp2", "prev_fp", "contents_changed",
               "props_changed", "props", "prev_props", "target", "error"]


DELETED_AGAINST_MODIFIED = "deleted on one side, modified on other"


def key_text(keys: Sequence[str]) -> Column:
    """Keys as one path-like text, which patterns are matched against."""
    return F.col(keys[0]).cast("string") if len(keys) == 1 else F.concat_ws(
        "/", *[F.col(k).cast("string") for k in keys])


def pair_updates(u1: DataFrame, u2: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair two change sets by key; a missing side is unchanged. Unchanged
    rows are dropped before the join, so only changes are shuffled."""
    side = lambda u, label: u.where(F.col("status") != S.UNCHANGED).select(
        *keys, F.struct(*SIDE_FIELDS).alias(label))
    return side(u1, "left").join(side(u2, "right"), list(keys), "full_outer")


def status(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.status"), F.lit(S.UNCHANGED))


def content_equal(update: UpdateConfig = UpdateConfig()) -> Column:
    """Both sides hold the same thing now, under the options of the comparison
    with the base."""
    l, r = F.col("left"), F.col("right")
    similar = _alike(l, r, update)
    same_data = (~l["contents_changed"] & ~r["contents_changed"]) | (
        l["contents_changed"] & r["contents_changed"]
        & l["fp"].eqNullSafe(r["fp"]) & l["fp2"].eqNullSafe(r["fp2"]))
    return (F.when(l["kind"] != r["kind"], False)
            .when(l["kind"] == "absent", True)
            .when(l["kind"] == "file", same_data & similar)
            .when(l["kind"] == "symlink", l["target"].eqNullSafe(r["target"]))
            .otherwise(similar))


def _alike(l: Column, r: Column, update: UpdateConfig) -> Column:
    return PR.props_similar(l["props"], r["props"], update.fat_tolerance, update.perm_mask, update.compare_times)


def conflict_reason() -> Column:
    l, r = F.col("left.kind"), F.col("right.kind")
    return (F.when((l == "absent") != (r == "absent"), DELETED_AGAINST_MODIFIED)
            .when((l == "file") & (r == "file"), "file changed on both sides")
            .when((l == "symlink") & (r == "symlink"), "symlink changed on both sides")
            .when(l != r, "type changed on both sides")
            .otherwise("conflicting updates"))


def merge_eligible(path: Column, patterns: Sequence[str]) -> Column:
    both_files = (F.col("left.kind") == "file") & (F.col("right.kind") == "file")
    return both_files & M.any_of(path, patterns)


def reconcile(u1: DataFrame, u2: DataFrame, keys: Sequence[str],
              cfg: PlanConfig = PlanConfig(), update: UpdateConfig = UpdateConfig()) -> DataFrame:
    """One row per key that changed on either side, with direction and reason.

    Keys that changed alike on both sides stay in the plan as ``equal``. For
    listings, what lies below a disputed or unreadable directory shares its fate
    (:func:`concordat.operators.tree.bind_subtrees`).
    """
    paired = pair_updates(u1, u2, keys)
    if not cfg.compare_dir_props:
        paired = _without_dir_noise(paired)
    problem = F.coalesce(F.col("left.error"), F.col("right.error"))
    both_dirs = (F.col("left.kind") == "directory") & (F.col("right.kind") == "directory")
    dirs_alike = _alike(F.col("left"), F.col("right"), update)
    if not cfg.compare_dir_props:
        dirs_alike = F.lit(True)
    direction = (
        F.when(problem.isNotNull(), S.PROBLEM)
        .when(F.col("right").isNull(), S.L2R)
        .when(F.col("left").isNull(), S.R2L)
        .when(both_dirs, F.when(dirs_alike, S.EQUAL).otherwise(S.CONFLICT))
        .when(content_equal(update), S.EQUAL)
        .when(merge_eligible(key_text(keys), cfg.merge), S.MERGE)
        .otherwise(S.CONFLICT))
    reason = F.when(F.col("direction") == S.CONFLICT, F.when(
        both_dirs, "properties changed on both sides").otherwise(conflict_reason()))
    decided = paired.withColumn("direction", direction).withColumn("reason", reason).withColumn("problem", problem)
    if list(keys) == ["path"]:
        decided = bind_subtrees(decided, DELETED_AGAINST_MODIFIED)
    return (decided.withColumn("default_direction", F.col("direction"))
            .withColumn("default_reason", F.col("reason"))
            .select(*keys, "left", "right", "direction", "reason", "default_direction", "default_reason", "problem"))


def _without_dir_noise(paired: DataFrame) -> DataFrame:
    """Directory rows whose only change is their properties (a directory's time
    moves whenever a child does) count as unchanged."""
    for side in ("left", "right"):
        s = F.col(side)
        noise = (s["kind"] == "directory") & (s["status"] == S.PROPS_CHANGED)
        paired = paired.withColumn(side, F.when(~F.coalesce(noise, F.lit(False)), s))
    return paired.where(F.col("left").isNotNull() | F.col("right").isNotNull())


# -- policy -----------------------------------------------------------------

def _toward(side: str) -> Column:
    return F.lit(S.L2R if side == LEFT else S.R2L)


def is_open(direction: Column) -> Column:
    """Rows a policy may touch: neither problems nor already equal."""
    return ~direction.isin(S.PROBLEM, S.EQUAL)


def newer_side(older: bool = False) -> Column:
    """Direction from the newer (older) file of a file-file pair; null on a tie
    or for other kinds."""
    l, r = F.col("left.props.mtime"), F.col("right.props.mtime")
    files = (F.col("left.kind") == "file") & (F.col("right.kind") == "file")
    left_wins = (l < r) if older else (l > r)
    right_wins = (r < l) if older else (r > l)
    return F.when(files & left_wins, S.L2R).when(files & right_wins, S.R2L)


def partial_direction(direction: Column, path: Column, cfg: PlanConfig) -> Column:
    """Path-specific overrides: forced ones first, preferred ones only for
    conflicts."""
    forced = M.first_match(path, [(p, _toward(s)) for p, s in cfg.force_partial])
    preferred = M.first_match(path, [(p, _toward(s)) for p, s in cfg.prefer_partial])
    conflict = F.when(direction == S.CONFLICT, preferred)
    return F.when(is_open(direction), F.coalesce(forced, conflict, direction)).otherwise(direction)


_RESTRICTIONS = (
    ("no_deletion", S.DELETED, "deletion not allowed"),
    ("no_creation", S.CREATED, "creation not allowed"),
    ("no_update", S.MODIFIED, "update not allowed"),
)


def restriction_reason(direction: Column, cfg: PlanConfig) -> Column:
    """Why a direction is not allowed, or null."""
    found = []
    for flag, status_value, text in _RESTRICTIONS:
        if getattr(cfg, flag):
            found += [
                F.when((direction == S.L2R) & (status("left") == status_value), f"{text} (replica 1)"),
                F.when((direction == S.R2L) & (status("right") == status_value), f"{text} (replica 2)"),
            ]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def policy(keys: Sequence[str], cfg: PlanConfig) -> tuple[Column, Column]:
    """Direction and reason after all overrides, in their fixed order: partial
    force and preference, then force, preference, newer/older (each of these
    settles the row), then the restrictions."""
    d = partial_direction(F.col("direction"), key_text(keys), cfg)
    conflict = d == S.CONFLICT
    if cfg.force:
        settled, chosen = is_open(d), _toward(cfg.force)
    else:
        settled, chosen = F.lit(False), F.lit(None).cast("string")
        if cfg.prefer in ("left", "right"):
            settled, chosen = conflict, _toward(cfg.prefer)
        elif cfg.prefer in ("newer", "older") or cfg.prefer_newer:
            files = (F.col("left.kind") == "file") & (F.col("right.kind") == "file")
            settled = conflict & F.coalesce(files, F.lit(False))
            chosen = newer_side(older=cfg.prefer == "older")
    d = F.when(settled, F.coalesce(chosen, d)).otherwise(d)
    blocked = F.when(settled | ~is_open(d), None).otherwise(restriction_reason(d, cfg))
    reason = (F.when(blocked.isNotNull(), blocked)
              .when(d == S.CONFLICT, F.col("reason")))
    return F.when(blocked.isNotNull(), S.CONFLICT).otherwise(d), reason


def apply_policy(plan: DataFrame, keys: Sequence[str], cfg: PlanConfig) -> DataFrame:
    """One projection; default directions stay as they were."""
    direction, reason = policy(keys, cfg)
    return plan.withColumns({"direction": direction, "reason": reason})


def force(plan: DataFrame, side: str) -> DataFrame:
    return apply_policy(plan, ["direction"], PlanConfig(force=side))


def prefer(plan: DataFrame, side: str) -> DataFrame:
    """``left``, ``right``, ``newer`` or ``older`` for conflicts."""
    return apply_policy(plan, ["direction"], PlanConfig(prefer=side))


# -- counting and shaping ----------------------------------------------------

def count_equal(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.when(F.col("direction") == S.EQUAL, 1)).alias("n_equal"))


def problems(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    return plan.where(F.col("direction") == S.PROBLEM).select(*keys, "problem")


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


def side_bytes(side: str) -> Column:
    s = F.col(side)
    return F.coalesce(F.when(s["kind"] == "file", s["props"]["length"]), F.lit(0).cast("long"))


def side_items(side: str, children: Column | None = None) -> Column:
    kind = F.col(f"{side}.kind")
    inside = F.lit(0).cast("long") if children is None else F.coalesce(children, F.lit(0))
    return (F.when(kind == "file", F.lit(1).cast("long")).when(kind == "directory", inside)
            .otherwise(F.lit(0).cast("long")))


def item_size(plan: DataFrame) -> DataFrame:
    """Items and bytes per side: a file counts itself, a directory its changed
    children."""
    out = plan
    for side in ("left", "right"):
        kids = (plan.where(F.col(side).isNotNull() & (F.col("path") != ""))
                .select(P.parent(F.col("path")).alias("path"))
                .groupBy("path").agg(F.count(F.lit(1)).alias("_kids")))
        out = (out.join(kids, "path", "left")
               .withColumn(f"{side}_items", side_items(side, F.col("_kids")))
               .withColumn(f"{side}_bytes", side_bytes(side)).drop("_kids"))
    return out


def any_side(test) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(test(status(s)), F.lit(False)) for s in ("left", "right")])
