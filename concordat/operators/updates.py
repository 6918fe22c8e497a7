"""Update detection: one side against the base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import UpdateConfig
from concordat.functions import fingerprints as FP
from concordat.functions import paths as P
from concordat.functions import props as PR
from concordat.operators.tree import covers_all
from concordat.session import materialize


def _state(df: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, list[str]]:
    """Key columns plus one struct of the state columns the table really has."""
    have = [c for c in S.STATE if c in df.columns]
    fields = [F.col(c).cast(S.STATE[c]).alias(c) for c in have]
    return df.select(*keys, F.struct(F.lit(True).alias("here"), *fields).alias(label)), have


def _field(label: str, have: Sequence[str], name: str, default=None) -> Column:
    if name in have:
        return F.col(f"{label}.{name}")
    return F.lit(default).cast(S.STATE[name])


def _props(label: str, have: Sequence[str]) -> Column:
    return F.struct(*[_field(label, have, f.name).alias(f.name) for f in S.PROPS])


def fast_check(length: Column, mtime: Column, base_length: Column, base_mtime: Column) -> Column:
    """Equal length and modification time clear the content."""
    same = (length == base_length) & (F.unix_millis(mtime) == F.unix_millis(base_mtime))
    return F.coalesce(same, F.lit(False))


def status_of(here: Column, before: Column, kind: Column, prev_kind: Column,
              contents_changed: Column, props_changed: Column) -> Column:
    """Replica status from content and previous state."""
    return (F.when(~here, S.DELETED).when(~before, S.CREATED)
            .when(kind != prev_kind, S.MODIFIED)
            .when(contents_changed, S.MODIFIED)
            .when(props_changed, S.PROPS_CHANGED)
            .otherwise(S.UNCHANGED))


def classify(current: DataFrame, base: DataFrame, keys: Sequence[str],
             cfg: UpdateConfig = UpdateConfig()) -> DataFrame:
    """Every key of either table with its status.

    One full outer join on the keys. Presence is an explicit flag on each
    side: a null fingerprint never means "absent".
    """
    c, c_has = _state(current, keys, "c")
    b, b_has = _state(base, keys, "b")
    j = c.join(b, list(keys), "full_outer")
    here = F.col("c.here").isNotNull()
    before = F.col("b.here").isNotNull()
    kind = F.coalesce(_field("c", c_has, "kind"), F.lit("file"))
    prev_kind = F.coalesce(_field("b", b_has, "kind"), F.lit("file"))
    fp, prev_fp = _field("c", c_has, "fp"), _field("b", b_has, "fp")
    fp2, prev_fp2 = _field("c", c_has, "fp2"), _field("b", b_has, "fp2")
    props, prev_props = _props("c", c_has), _props("b", b_has)
    cleared = F.lit(cfg.use_fast_check) & fast_check(
        props["length"], props["mtime"], prev_props["length"], prev_props["mtime"])
    target, prev_target = _field("c", c_has, "target"), _field("b", b_has, "target")
    differs = (F.when(kind == "file", ~cleared & ~(fp.eqNullSafe(prev_fp) & fp2.eqNullSafe(prev_fp2)))
               .when(kind == "symlink", ~target.eqNullSafe(prev_target))
               .otherwise(F.lit(False)))
    both = here & before
    contents = F.when(both & (kind == prev_kind), differs).otherwise(here)
    similar = PR.props_similar(props, prev_props, cfg.fat_tolerance, cfg.perm_mask, cfg.compare_times)
    props_changed = both & (kind != "symlink") & (kind == prev_kind) & ~similar
    error = _field("c", c_has, "error")
    status = F.when(error.isNotNull(), S.ERROR).otherwise(
        status_of(here, before, kind, prev_kind, contents, props_changed))
    unread = both & (kind == "file") & (prev_kind == "file") & ~contents
    return j.select(
        *keys,
        status.alias("status"),
        F.when(here, kind).otherwise("absent").alias("kind"),
        F.when(before, prev_kind).alias("prev_kind"),
        F.when(unread, F.coalesce(fp, prev_fp)).otherwise(fp).alias("fp"),
        fp2.alias("fp2"),
        prev_fp.alias("prev_fp"),
        contents.alias("contents_changed"),
        props_changed.alias("props_changed"),
        F.when(here, props).alias("props"),
        F.when(before, prev_props).alias("prev_props"),
        target.alias("target"),
        error.alias("error"),
    )


def detect_updates(current: DataFrame, base: DataFrame, keys: Sequence[str],
                   cfg: UpdateConfig = UpdateConfig()) -> DataFrame:
    """Only the keys that changed (or could not be read)."""
    return classify(current, base, keys, cfg).where(F.col("status") != S.UNCHANGED)


def shield_unread(found: DataFrame, current: DataFrame) -> DataFrame:
    """What the base has below a directory that could not be read counts as not
    read, never as deleted. Where the root couldn't be read, that is everything."""
    if "path" not in current.columns or "error" not in current.columns:
        return found
    unread = materialize(current.where(F.col("error").isNotNull() & (F.col("kind") != "file"))
                         .select(F.col("path").alias("_above")), "unread")
    gone = found.where(F.col("status") == S.DELETED)
    below = (gone.select("path", F.explode(P.ancestors(P.parent(F.col("path")))).alias("_above"))
             .join(unread, "_above").groupBy("path").agg(F.min("_above").alias("_above")))
    hit = F.col("_above").isNotNull() & (F.col("status") == S.DELETED)
    if covers_all(unread):
        below = gone.select("path", F.lit("").alias("_above")).where(F.col("path") != "")
    return (found.join(below, "path", "left")
            .withColumn("error", F.when(hit, F.concat(F.lit("cannot read directory "), "_above")).otherwise(F.col("error")))
            .withColumn("status", F.when(hit, S.ERROR).otherwise(F.col("status"))).drop("_above"))


def created_keys(current: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(base.select(*keys), list(keys), "left_anti")


def deleted_keys(current: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows (previous kind and fingerprint) that are gone."""
    return base.join(current.select(*keys), list(keys), "left_anti")


def type_changes(updates: DataFrame) -> DataFrame:
    return updates.where((F.col("kind") != F.col("prev_kind")) & (F.col("kind") != "absent"))


def link_updates(updates: DataFrame) -> DataFrame:
    return updates.where((F.col("kind") == "symlink") & F.col("contents_changed"))


def scan_errors(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("error").isNotNull())


def child_counts(listing: DataFrame, name: str = "n_children") -> DataFrame:
    """Direct children per directory; counted map-side first."""
    parents = listing.where(F.col("path") != "").select(P.parent(F.col("path")).alias("path"))
    return parents.groupBy("path").agg(F.count(F.lit(1)).alias(name))


def dir_updates(current: DataFrame, base: DataFrame, cfg: UpdateConfig = UpdateConfig()) -> DataFrame:
    """Directories on both sides: property change, and ``emptied`` = no
    children now, some in the base."""
    u = classify(current.where(F.col("kind") == "directory"),
                 base.where(F.col("kind") == "directory"), ["path"], cfg)
    both = u.where((F.col("kind") == "directory") & F.col("prev_kind").isNotNull())
    counted = (both.join(child_counts(current, "n_now"), "path", "left")
               .join(child_counts(base, "n_before"), "path", "left"))
    emptied = F.col("n_now").isNull() & F.col("n_before").isNotNull()
    return counted.select("path", "status", "props_changed", emptied.alias("emptied"),
                          F.coalesce("n_now", F.lit(0)).alias("n_now"),
                          F.coalesce("n_before", F.lit(0)).alias("n_before"))


def detect_remote_updates(remote: DataFrame, base: DataFrame,
                          cfg: UpdateConfig = UpdateConfig()) -> DataFrame:
    """A remote listing with entity tags against the base: equal tag
    fingerprints mean unchanged, and with ``trust_size`` equal sizes do too.
    Times are not compared; servers do not keep them."""
    tagged = remote.withColumn("fp", F.when(
        F.col("kind") == "file",
        FP.etag_fp(F.col("etag"), P.name(F.col("path")), F.col("length"), F.col("mtime"))))
    u = classify(tagged, base, ["path"], UpdateConfig(use_fast_check=False))
    known = (F.col("status").isin(S.MODIFIED, S.PROPS_CHANGED)
             & (F.col("kind") == F.col("prev_kind")))
    same = F.col("fp").eqNullSafe(F.col("prev_fp")) | (F.col("kind") == "directory")
    if cfg.trust_size:
        same = same | (F.col("props.length") == F.col("prev_props.length"))
    status = F.when(known & same, S.UNCHANGED).when(known, S.MODIFIED).otherwise(F.col("status"))
    return u.withColumn("status", status).where(F.col("status") != S.UNCHANGED)


def apply_updates(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold accepted updates into the base: deleted keys go, new content
    replaces the entry, property changes keep the fingerprint. Columns that are
    no state keep the base's value; new keys have none."""
    u = updates.where(F.col("error").isNull())
    kept = base.join(u.select(*keys), list(keys), "left_anti")
    live = u.where(F.col("status") != S.DELETED)
    kept_fp = F.when(F.col("status") == S.PROPS_CHANGED, F.coalesce("prev_fp", "fp"))
    cols = {
        "kind": F.col("kind"), "fp": F.coalesce(kept_fp, F.col("fp")), "fp2": F.col("fp2"),
        "target": F.col("target"), "error": F.lit(None).cast("string"),
        **{f.name: F.col(f"props.{f.name}") for f in S.PROPS},
    }
    payload = [c for c in base.columns if c not in cols and c not in keys]
    if payload:
        live = live.join(base.select(*keys, F.struct(*payload).alias("_payload")), list(keys), "left")
    value = lambda c: cols[c] if c in cols else F.col(f"_payload.{c}") if c in payload else F.col(c)
    return kept.unionByName(live.select(*[value(c).alias(c) for c in base.columns]))
