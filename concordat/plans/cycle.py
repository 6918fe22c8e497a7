"""The whole reconciliation cycle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import JobConfig
from concordat.operators import backups as B
from concordat.operators import guards as G
from concordat.operators import history as H
from concordat.operators import propagate as A
from concordat.operators import reconcile as R
from concordat.operators.listings import atomic_groups, follow_links, prune_ignored, select_paths
from concordat.operators.merge import three_way_merge
from concordat.operators.snapshots import check_keys
from concordat.operators.tree import hold_back, without_lost
from concordat.operators.updates import detect_updates, shield_unread
from concordat.session import materialize


@dataclass(frozen=True)
class Outcome:
    """Tables of one cycle. ``base`` is the old one if ``save_base`` is false.
    ``backups`` are this cycle's pre-images, or None without a backup option;
    ``record`` and ``entries`` go to the history."""

    left: DataFrame
    right: DataFrame
    base: DataFrame
    plan: DataFrame
    results: DataFrame
    backups: DataFrame | None
    record: DataFrame
    entries: DataFrame
    save_base: bool


def scope(df: DataFrame, cfg: JobConfig) -> DataFrame:
    """Without ignored and unselected entries."""
    if cfg.ignore or cfg.ignore_not:
        df = prune_ignored(df, cfg.ignore, cfg.ignore_not)
    return select_paths(df, cfg.paths) if cfg.paths else df


def make_plan(left: DataFrame, right: DataFrame, base: DataFrame, cfg: JobConfig) -> DataFrame:
    """Detection, pairing and policy as one lazy plan. Ignored and unselected
    keys are filtered out of all three inputs alike."""
    keys = list(cfg.keys)
    left, right, base = (scope(df, cfg) for df in (left, right, base))
    left, right = _resolved(left, right, cfg)
    u1 = detect_updates(left, base, keys, cfg.update)
    u2 = detect_updates(right, base, keys, cfg.update)
    if keys == ["path"]:
        u1, u2 = shield_unread(u1, left), shield_unread(u2, right)
    return decide(u1, u2, cfg)


def decide(u1: DataFrame, u2: DataFrame, cfg: JobConfig) -> DataFrame:
    """Pairing and policy over what was detected on the two sides."""
    keys = list(cfg.keys)
    plan = R.apply_policy(R.reconcile(u1, u2, keys, cfg.plan, cfg.update), keys, cfg.plan)
    if not cfg.links:
        plan = plan.where(~_involves_link())
    if cfg.max_size_kb:
        plan = limit_size(plan, cfg.max_size_kb)
    return atomic_groups(plan, cfg.plan.atomic) if cfg.plan.atomic else plan


def _involves_link() -> Column:
    kinds = [F.col(f"{s}.{k}") for s in ("left", "right") for k in ("kind", "prev_kind")]
    return F.coalesce(F.array_contains(F.array(*kinds), "symlink"), F.lit(False))


def limit_size(plan: DataFrame, kb: int) -> DataFrame:
    """Hold back transfers of larger files. The decision falls on the plan: if
    large files were filtered out of one listing they would look deleted."""
    large = A.source_bytes() > kb * 1024
    return plan.withColumns({
        "reason": F.when(large, f"larger than {kb} KB").otherwise(F.col("reason")),
        "direction": F.when(large, S.CONFLICT).otherwise(F.col("direction"))})


def dry_run(left: DataFrame, right: DataFrame, base: DataFrame, cfg: JobConfig) -> DataFrame:
    """Plan only. It is written out, so that it can be reviewed, edited and
    committed later, and so that writing the replicas cannot change it."""
    if cfg.check_keys:
        check_keys(left, cfg.keys, right, base)
    if cfg.guard_empty:
        G.guard_empty_side(left, base, "left")
        G.guard_empty_side(right, base, "right")
    return materialize(make_plan(left, right, base, cfg), "plan")


def _resolved(left: DataFrame, right: DataFrame, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    return (follow_links(left, cfg.follow), follow_links(right, cfg.follow)) if cfg.follow else (left, right)


def commit(left: DataFrame, right: DataFrame, base: DataFrame, plan: DataFrame, cfg: JobConfig,
           merge_values: Sequence[str] = (), failures: DataFrame | None = None,
           sync_id: str | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> Outcome:
    """Carry out a (possibly edited) plan. Links that the plan followed are
    replaced by what they point to, here as in the plan. ``counted`` are the
    whole sides where ``left`` and ``right`` are parts of them."""
    keys = list(cfg.keys)
    left, right = _resolved(left, right, cfg)
    if cfg.max_delete_fraction is not None:
        G.guard_big_deletes(plan, *(counted or (left, right)), cfg.max_delete_fraction)
    merged = None
    if merge_values:
        wanted = plan.where(F.col("direction") == S.MERGE)
        merged = three_way_merge(base, left, right, keys, list(merge_values), wanted,
                                 cfg.plan.merge_rules, cfg.plan.merge_mtime, cfg.plan.merge_strategies)
    done = A.results(plan, keys, cfg.apply, merged, failures)
    done = materialize(A.error_budget(done, keys, cfg.apply.max_errors, cfg.plan.sort_mode), "results")
    listings = keys == ["path"] and all("kind" in t.columns for t in (left, right, base))
    if listings:
        done = hold_back(plan, done, left, right)
    save = G.may_save_base({r["outcome"]: r["n"] for r in A.result_counts(done).collect()})  # at most three rows
    acts = A.act_rows(left, right, base, plan, done, keys, merged)
    new_left, new_right = A.apply_plan(left, right, acts, keys, cfg.apply)
    new_base = A.next_base(base, left, right, acts, keys, cfg.apply) if save else base
    if save and listings and (cfg.ignore or cfg.ignore_not or cfg.paths):
        new_base = without_lost(new_base, acts)
    sync_id = sync_id or uuid.uuid4().hex
    now = F.lit(datetime.now(UTC).isoformat()).cast("timestamp")
    backups = None
    if cfg.backup:
        sides = [B.stash_preimages(t, done, keys, d, now, sync_id, cfg.backup).withColumn("side", F.lit(side))
                 for t, d, side in ((right, S.L2R, "right"), (left, S.R2L, "left"))]
        backups = sides[0].unionByName(sides[1], allowMissingColumns=True)
    record = H.history_record(done, F.lit(sync_id), now)
    entries = H.history_entries(done, keys, F.lit(sync_id))
    return Outcome(new_left, new_right, new_base, plan, done, backups, record, entries, save)


def sync(left: DataFrame, right: DataFrame, base: DataFrame, cfg: JobConfig,
         merge_values: Sequence[str] = (), failures: DataFrame | None = None, **more) -> Outcome:
    """Detect, decide and apply: new left, right and base with plan, results,
    backups and history."""
    return commit(left, right, base, dry_run(left, right, base, cfg), cfg, merge_values, failures, **more)
