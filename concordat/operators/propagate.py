"""Carrying out a plan: new replicas, results, new base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import ApplyConfig
from concordat.functions import fingerprints as FP
from concordat.functions import paths as P
from concordat.operators.reconcile import side_bytes, status
from concordat.operators.views import plan_order
from concordat.session import materialize


def source_status() -> Column:
    """Status of the side a row is copied from; null without a direction."""
    return (F.when(F.col("direction") == S.L2R, status("left"))
            .when(F.col("direction") == S.R2L, status("right")))


def source_missing() -> Column:
    """The side a row is copied from has no entry now, so the other loses its own."""
    def missing(source: str, target: str) -> Column:
        return F.coalesce(F.col(f"{source}.kind") == "absent",
                          F.col(source).isNull() & (status(target) == S.CREATED))
    return (F.when(F.col("direction") == S.L2R, missing("left", "right"))
            .when(F.col("direction") == S.R2L, missing("right", "left")).otherwise(False))


def target_there() -> Column:
    """The side a row is copied to has an entry now."""
    def there(source: str, target: str) -> Column:
        return F.coalesce(F.col(f"{target}.kind") != "absent", status(source) != S.CREATED)
    return (F.when(F.col("direction") == S.L2R, there("left", "right"))
            .when(F.col("direction") == S.R2L, there("right", "left")).otherwise(False))


def only_props() -> Column:
    """A source changed in its properties alone and the target not at all."""
    alone = lambda source, target: (status(source) == S.PROPS_CHANGED) & F.col(target).isNull()
    return (F.when(F.col("direction") == S.L2R, alone("left", "right"))
            .when(F.col("direction") == S.R2L, alone("right", "left")).otherwise(False))


def source_bytes() -> Column:
    return (F.when(F.col("direction") == S.L2R, side_bytes("left"))
            .when(F.col("direction") == S.R2L, side_bytes("right"))
            .otherwise(F.lit(0).cast("long")))


def results(plan: DataFrame, keys: Sequence[str], cfg: ApplyConfig = ApplyConfig(),
            merged: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Outcome per key: success, skipped with the reason, or error.

    ``merged`` is the output of a three-way merge; ``failures`` are keys with
    messages that a writer reported.
    """
    p = plan.where(F.col("direction") != S.EQUAL)
    text = F.lit(None).cast("string")
    if failures is not None:
        p = p.join(failures.select(*keys, F.col("message").alias("_fail")), list(keys), "left")
    else:
        p = p.withColumn("_fail", text)
    if merged is not None:
        p = p.join(merged.select(*keys, F.col("clean").alias("_clean"),
                                 F.array_join("conflict_columns", ",").alias("_cols")),
                   list(keys), "left")
    else:
        p = p.withColumns({"_clean": F.lit(None).cast("boolean"), "_cols": text})
    d = F.col("direction")
    idle = (source_status() == S.UNCHANGED) if cfg.force_mode == "skip" else F.lit(False)
    skipped = (
        F.when(d == S.PROBLEM, F.concat(F.lit("Problem: "), F.col("problem")))
        .when(d == S.CONFLICT, F.concat(F.lit("Conflict: "), F.col("reason")))
        .when((d == S.MERGE) & F.col("_clean").isNull(), "No merge configured")
        .when((d == S.MERGE) & ~F.col("_clean"), F.concat(F.lit("Merge conflict: "), F.col("_cols")))
        .when(d.isin(S.L2R, S.R2L) & idle, "Unchanged"))
    outcome = (F.when(skipped.isNotNull(), "skipped")
               .when(F.col("_fail").isNotNull(), "error").otherwise("success"))
    return p.withColumn("outcome", outcome).withColumn(
        "detail", F.coalesce(skipped, F.col("_fail"))).drop("_fail", "_clean", "_cols")


def error_budget(done: DataFrame, keys: Sequence[str], max_errors: int,
                 mode: str = "default") -> DataFrame:
    """In plan order, everything after error number ``max_errors + 1`` is
    skipped (-1 = never).

    Only the place of that one error matters. It comes from a top-k over the
    error rows; no running count over the plan is needed.
    """
    if max_errors < 0:
        return done
    order = plan_order(keys, mode)
    fields = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranked = done.withColumn("_at", fields)
    first_errors = (ranked.where(F.col("outcome") == "error").select("_at")
                    .orderBy("_at").limit(max_errors + 1))
    stop = first_errors.agg(F.when(F.count(F.lit(1)) > max_errors, F.max("_at")))
    after = F.coalesce(F.col("_at") > F.col("_stop"), F.lit(False))
    return (ranked.withColumn("_stop", stop.scalar())
            .withColumns({
                "detail": F.when(after, "Aborted: error limit reached").otherwise(F.col("detail")),
                "outcome": F.when(after, "skipped").otherwise(F.col("outcome"))})
            .select(*done.columns))


def result_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def all_succeeded(done: DataFrame) -> DataFrame:
    """True when nothing failed (skipped rows do not count as failures)."""
    return done.agg(F.coalesce(F.bool_and(F.col("outcome") != "error"), F.lit(True)).alias("ok"))


def upsert_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def delete_rows(target: DataFrame, gone: DataFrame, keys: Sequence[str],
                subtree: bool = False) -> DataFrame:
    """Remove keys; with ``subtree`` also everything below a removed path.

    Every row looks for a removed ancestor. A directory that holds a third of
    all rows is a frequent join key; adaptive execution splits it.
    """
    if not subtree:
        return target.join(gone.select(*keys), list(keys), "left_anti")
    (key,) = keys
    above = target.select(key, F.explode(P.ancestors(F.col(key))).alias("_above"))
    roots = gone.select(F.col(key).alias("_above")).distinct().withColumn("_gone", F.lit(True))
    below = above.join(roots, "_above").select(key).distinct()
    return target.join(below, key, "left_anti")


def props_only(target: DataFrame, source: DataFrame, keys: Sequence[str],
               cfg: ApplyConfig = ApplyConfig()) -> DataFrame:
    """Target rows with times, permissions and owner of the source rows; the
    content stays."""
    names = [*(["mtime"] if cfg.times else []), *(["perms"] if cfg.perms else []), "owner", "grp"]
    names = [n for n in names if n in target.columns and n in source.columns]
    s = source.select(*keys, F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in names])
    j = target.join(s, list(keys), "left")
    return (j.withColumns({n: F.when(F.col("_hit"), F.coalesce(F.col(f"_{n}"), F.col(n)))
                           .otherwise(F.col(n)) for n in names})
            .select(*target.columns))


def act_rows(left: DataFrame, right: DataFrame, base: DataFrame, plan: DataFrame, done: DataFrame,
             keys: Sequence[str], merged: DataFrame | None = None) -> DataFrame:
    """One row per key that the new tables take from elsewhere than their own
    old row: what to do (``act``), whether only properties go over (``props``),
    and the current rows of the three tables (structs, null where there is
    none).

    Each big table meets only the planned keys here, in one semi-join; what is
    put together afterwards has the size of the plan. It is written out, so
    that the new tables share it and Catalyst knows its size.
    """
    keys = list(keys)
    acts = (done.where((F.col("outcome") == "success") & F.col("direction").isin(S.L2R, S.R2L, S.MERGE))
            .select(*keys, F.col("direction").alias("act"), (source_status() == S.PROPS_CHANGED).alias("props"))
            .unionByName(plan.where(F.col("direction") == S.EQUAL).select(
                *keys, F.lit(S.EQUAL).alias("act"), F.lit(False).alias("props"))))
    acts = materialize(acts, "acts")
    out = acts
    for label, table in (("l", left), ("r", right), ("b", base)):
        mine = table.join(acts.select(*keys), keys, "left_semi")
        out = out.join(mine.select(*keys, F.struct(*table.columns).alias(label)), keys, "left")
    if merged is not None:
        values = [c for c in merged.columns if c not in (*keys, "strategy", "conflict_columns", "clean")]
        m = merged.where("clean").select(*keys, F.struct(*values).alias("m"))
        out = out.join(m, keys, "left")
    return materialize(out, "act_rows")


def _taken(acts: DataFrame, act: str, target: str, source: str, columns: Sequence[str], have: Sequence[str],
           cfg: ApplyConfig) -> DataFrame:
    """New rows of the side ``target`` for one direction."""
    mine = acts.where((F.col("act") == act) & F.col(source).isNotNull())
    carried = {*(["mtime"] if cfg.times else []), *(["perms"] if cfg.perms else []), "owner", "grp"} & set(have)
    kept = F.col("props") & F.col(target).isNotNull() & F.lit("mtime" in columns)
    field = lambda side, c: F.col(f"{side}.{c}")
    return mine.select(*[
        F.when(kept, F.coalesce(field(source, c), field(target, c)) if c in carried else field(target, c))
        .otherwise(field(source, c) if c in have else F.lit(None)).alias(c) for c in columns])


def _merged_rows(acts: DataFrame, side: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows with their merged values and, where the table has one, the
    fingerprint of what they hold now."""
    names = acts.schema["m"].dataType.names if "m" in acts.columns else []
    rows = acts.where((F.col("act") == S.MERGE) & F.col(side).isNotNull()).select(*[
        F.col(f"m.{c}").alias(c) if c in names else F.col(f"{side}.{c}").alias(c) for c in columns])
    if "fp" in columns and names:
        rows = rows.withColumn("fp", FP.row_fp(rows, [c for c in columns if c not in keys and c not in S.STATE]))
    return rows


def _new_side(table: DataFrame, acts: DataFrame, keys: Sequence[str], act: str, target: str, source: str,
              other: Sequence[str], cfg: ApplyConfig) -> DataFrame:
    replaced = acts.where(F.col("act").isin(act, S.MERGE)).select(*keys)
    out = table.join(replaced, list(keys), "left_anti").unionByName(
        _taken(acts, act, target, source, table.columns, other, cfg))
    return out.unionByName(_merged_rows(acts, target, table.columns, keys))


def apply_plan(left: DataFrame, right: DataFrame, acts: DataFrame, keys: Sequence[str],
               cfg: ApplyConfig = ApplyConfig()) -> tuple[DataFrame, DataFrame]:
    """New left and right: one anti-join per table and the rows at hand. A row
    takes the *current* row of its source side: none there means the target
    loses it."""
    return (_new_side(left, acts, keys, S.R2L, "l", "r", right.columns, cfg),
            _new_side(right, acts, keys, S.L2R, "r", "l", left.columns, cfg))


def next_base(base: DataFrame, left: DataFrame, right: DataFrame, acts: DataFrame, keys: Sequence[str],
              cfg: ApplyConfig = ApplyConfig()) -> DataFrame:
    """The state that both sides share after the cycle, for keys that succeeded
    or were equal; skipped and failed keys keep their old row, so a conflict is
    still a conflict next time. A base column that the left table lacks keeps
    its value. Of ``left`` and ``right`` only the column names are used."""
    keys = list(keys)
    known = [c for c in base.columns if c in left.columns]
    fresh = (acts.where((F.col("act").isin(S.L2R, S.EQUAL)) & F.col("l").isNotNull()).select(*keys, F.col("l").alias("now"))
             .unionByName(_packed(_taken(acts, S.R2L, "l", "r", left.columns, right.columns, cfg), keys))
             .unionByName(_packed(_merged_rows(acts, "l", left.columns, keys), keys)))
    fresh = fresh.join(acts.select(*keys, "b"), keys)
    old_fp = F.col("b.fp") if "fp" in base.columns else F.lit(None)
    if "kind" in known:  # what replaces a file has no use for its fingerprint
        old_fp = F.when(F.col("now.kind").eqNullSafe(F.col("b.kind")), old_fp)
    value = lambda c: (F.coalesce(F.col("now.fp"), old_fp) if c == "fp" and c in known
                       else F.col(f"now.{c}") if c in known else F.col(f"b.{c}"))
    return base.join(acts.select(*keys), keys, "left_anti").unionByName(
        fresh.select(*[value(c).alias(c) for c in base.columns]))


def _packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.struct(*rows.columns).alias("now"))


def replicas_equal(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   values: Sequence[str] | None = None) -> DataFrame:
    """Counts of keys that differ or exist once only, and the verdict. A keyed
    join instead of two row-set differences: one shuffle per side."""
    values = list(values or [c for c in left.columns if c not in keys])
    l = left.select(*keys, F.struct(*values).alias("l"), F.lit(True).alias("lh"))
    r = right.select(*keys, F.struct(*values).alias("r"), F.lit(True).alias("rh"))
    j = l.join(r, list(keys), "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    out = j.agg(
        count(F.col("rh").isNull()).alias("only_left"),
        count(F.col("lh").isNull()).alias("only_right"),
        count(F.col("lh") & F.col("rh") & ~F.col("l").eqNullSafe(F.col("r"))).alias("different"))
    return out.withColumn("equal", (F.col("only_left") + F.col("only_right") + F.col("different")) == 0)


def transfer_volume(plan: DataFrame) -> DataFrame:
    """Items and bytes to move per direction."""
    moving = plan.where(F.col("direction").isin(S.L2R, S.R2L))
    files = F.when(F.col("direction") == S.L2R, F.col("left.kind")).otherwise(F.col("right.kind")) == "file"
    return moving.groupBy("direction").agg(
        F.count(F.when(files, 1)).alias("n_items"), F.sum(source_bytes()).alias("n_bytes"))
