"""What a tree demands of a plan: every entry lies in a directory.

Two steps keep it so. :func:`bind_subtrees` works on decisions: entries below a
directory that is in dispute share its fate. :func:`held_back` works on what is
about to be carried out, after policies, edits, filters and failures: an entry
isn't put where its directory won't be, and a directory isn't taken from under
entries that stay. Both look at planned rows and their ancestors only; the
tables meet them in joins on one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.functions import paths as P
from concordat.functions.patterns import any_of
from concordat.session import materialize

ABSENT, DIRECTORY = "absent", "directory"
NO_PARENT = "Held back: no directory to put it in"
NOT_EMPTY = "Held back: the directory still has entries"


def kind_now(side: str, other: str) -> Column:
    """Kind of a planned row on one side now: a side without a change has what
    the base had, which the other side's change remembers."""
    return F.coalesce(F.col(f"{side}.kind"), F.col(f"{other}.prev_kind"), F.lit(ABSENT))


def _exploded(rows: DataFrame, path: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(P.ancestors(path)).alias("_above"))


def covers_all(roots: DataFrame) -> bool:
    """Whether the root of the tree is among these directories. It is asked for
    apart: as a join key it would meet every row."""
    return not roots.where(F.col("_above") == "").isEmpty()


def below(rows: DataFrame, roots: DataFrame, itself: bool = False) -> DataFrame:
    """``path, _above``: rows below (or equal to) one of the directories
    ``roots(_above)``, with the topmost one."""
    path = F.col("path") if itself else P.parent(F.col("path"))
    found = _exploded(rows.where(F.col("path") != ""), path, "path").join(roots, "_above", "left_semi")
    return found.groupBy("path").agg(F.min("_above").alias("_above"))


def bind_subtrees(decided: DataFrame, deleted_against_modified: str) -> DataFrame:
    """Bind rows to disputed directories above them.

    * A directory that one side deleted or turned into something else, while the
      other side has something new or changed below it, is a conflict with all
      that lies in it.
    * A conflict over an entry that is a directory on one side only covers all
      that lies below it, with the same reason.
    * What lies below a directory that couldn't be read is a problem.

    Needs the columns ``direction``, ``reason`` and ``problem``.
    """
    decided = materialize(decided, "decided")
    gone = lambda s: F.coalesce((F.col(f"{s}.prev_kind") == DIRECTORY) & (F.col(f"{s}.kind") != DIRECTORY), F.lit(False))
    lost = decided.where(gone("left") | gone("right")).select("path", F.explode(F.array_compact(F.array(
        *[F.when(gone(s), F.lit(s)) for s in ("left", "right")]))).alias("side"))
    live = lambda s: F.coalesce(F.col(f"{s}.kind") != ABSENT, F.lit(False))
    changed = F.array_compact(F.array(F.when(live("right"), F.lit("left")), F.when(live("left"), F.lit("right"))))
    above = decided.where(live("left") | live("right")).select(
        F.explode(P.ancestors(P.parent(F.col("path")))).alias("path"), changed.alias("sides")).select("path", F.explode("sides").alias("side")).distinct()
    torn = lost.join(above, ["path", "side"], "left_semi").select("path", F.lit(deleted_against_modified).alias("why"))
    one_dir = (kind_now("left", "right") == DIRECTORY) != (kind_now("right", "left") == DIRECTORY)
    disputed = decided.where((F.col("direction") == S.CONFLICT) & one_dir).select("path", F.col("reason").alias("why"))
    roots = materialize(torn.unionByName(disputed).groupBy("path").agg(F.min("why").alias("why")).withColumnRenamed("path", "_above"), "disputed")
    not_file = F.coalesce(F.col("left.kind"), F.lit("")) != "file"
    unread = materialize(decided.where((F.col("direction") == S.PROBLEM) & (not_file | (F.coalesce(F.col("right.kind"), F.lit("")) != "file")))
                         .select(F.col("path").alias("_above")), "unreadable")
    out = decided
    if not roots.isEmpty():
        hit = below(decided, roots.select("_above"), itself=True).join(roots, "_above").select("path", "why")
        open_ = F.col("why").isNotNull() & ~F.col("direction").isin(S.PROBLEM, S.EQUAL)
        out = out.join(hit, "path", "left").withColumns({
            "reason": F.when(open_, F.coalesce("reason", "why")).otherwise(F.col("reason")),
            "direction": F.when(open_, S.CONFLICT).otherwise(F.col("direction"))}).drop("why")
    if not unread.isEmpty():
        hit = below(decided, unread).withColumnRenamed("_above", "_unread")
        out = out.join(hit, "path", "left")
        if covers_all(unread):
            out = out.withColumn("_unread", F.when(F.col("path") != "", F.lit("")))
        under = F.col("_unread").isNotNull()
        out = out.withColumns({
            "problem": F.when(under, F.coalesce("problem", F.concat(F.lit("cannot read directory "), "_unread"))).otherwise(F.col("problem")),
            "reason": F.when(~under, F.col("reason")),
            "direction": F.when(under, S.PROBLEM).otherwise(F.col("direction"))}).drop("_unread")
    return out


def _states(plan: DataFrame, done: DataFrame, act: str, source: str, target: str) -> DataFrame:
    """Planned rows as they are on ``target`` now and will be (``then``)."""
    acts = (F.col("direction") == act) & (F.col("outcome") == "success")
    rows = done.select("path", acts.alias("acts"), kind_now(source, target).alias("given"), kind_now(target, source).alias("now"))
    alike = plan.where(F.col("direction") == S.EQUAL).select(
        "path", F.lit(False).alias("acts"), kind_now(source, target).alias("given"), kind_now(target, source).alias("now"))
    return rows.unionByName(alike).withColumn("then", F.when(F.col("acts"), F.col("given")).otherwise(F.col("now")))


def held_back(plan: DataFrame, done: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``path, held``: rows of ``done`` that can't be carried out without leaving
    an entry outside a directory.

    A row that puts an entry fails where its parent will be no directory on that
    side, and with it all that is put below. Listings without directory rows
    (a store of files alone) demand no parents. A row that takes a directory
    away fails where entries stay in it: unplanned ones (left out by a filter, say),
    skipped ones, or those whose own row fails."""
    found = None
    for act, source, target, from_, to in ((S.L2R, "left", "right", left, right), (S.R2L, "right", "left", right, left)):
        states = materialize(_states(plan, done, act, source, target), "states")
        puts = states.where(F.col("acts") & (F.col("then") != ABSENT) & (F.col("path") != "")).select("path", P.parent(F.col("path")).alias("parent"))
        parents = puts.where(F.col("parent") != "").select(F.col("parent").alias("path")).distinct()
        kinds = lambda t, name: t.join(parents, "path", "left_semi").select("path", F.col("kind").alias(name))  # noqa: B023, E731
        planned = states.select("path", F.col("given").alias("p_given"), F.col("then").alias("p_then"))
        known = (parents.join(planned, "path", "left").join(kinds(from_, "t_given"), "path", "left").join(kinds(to, "t_then"), "path", "left")
                 .select(F.col("path").alias("parent"), F.coalesce("p_given", "t_given", F.lit(ABSENT)).alias("given"),
                         F.coalesce("p_then", "t_then", F.lit(ABSENT)).alias("then")))
        bad = ((F.col("then") != DIRECTORY) & ((F.col("then") != ABSENT) | (F.col("given") == DIRECTORY)))
        seeds = materialize(puts.join(known.where(bad), "parent", "left_semi").select(F.col("path").alias("_above")), "seeds")
        stay = states
        failing = None
        if not seeds.isEmpty():
            failing = materialize(below(puts, seeds, itself=True).select("path", F.lit(NO_PARENT).alias("held")), "failing")
            stay = states.join(failing, "path", "left").withColumns({
                "acts": F.col("acts") & F.col("held").isNull(), "then": F.when(F.col("held").isNull(), F.col("then")).otherwise(F.col("now"))}).drop("held")
        freed = materialize(stay.where(F.col("acts") & (F.col("now") == DIRECTORY) & (F.col("then") != DIRECTORY)).select(F.col("path").alias("_above")), "freed")
        blocked = None
        if not freed.isEmpty():
            inside = lambda t: t.withColumn("_above", P.parent(F.col("path"))).join(freed, "_above", "left_semi").select("path")  # noqa: B023, E731
            stuck = inside(to.select("path")).join(states.select("path"), "path", "left_anti").unionByName(
                inside(stay.where(F.col("then") != ABSENT).select("path")))
            blocked = _exploded(stuck, P.parent(F.col("path"))).join(freed, "_above", "left_semi").select(
                F.col("_above").alias("path"), F.lit(NOT_EMPTY).alias("held")).distinct()
        for more in (failing, blocked):
            if more is not None:
                found = more if found is None else found.unionByName(more)
    return found if found is not None else done.select("path", F.lit("").alias("held")).limit(0)


def hold_back(plan: DataFrame, done: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``done`` with what :func:`held_back` finds as skipped."""
    held = materialize(held_back(plan, done, left, right), "held")
    if held.isEmpty():
        return done
    hit = F.col("held").isNotNull()
    return materialize(done.join(held, "path", "left").withColumns({
        "outcome": F.when(hit, "skipped").otherwise(F.col("outcome")),
        "detail": F.when(hit, F.col("held")).otherwise(F.col("detail"))}).drop("held"), "results")


def without_lost(new_base: DataFrame, acts: DataFrame) -> DataFrame:
    """The new base without what it remembers below directories that are none any
    more on either side: entries that a filter kept out of the plan."""
    now = F.when(F.col("act") == S.R2L, F.col("r.kind")).otherwise(F.col("l.kind"))
    freed = materialize(acts.where((F.col("b.kind") == DIRECTORY) & ~now.eqNullSafe(F.lit(DIRECTORY))).select(F.col("path").alias("_above")), "freed")
    return new_base if freed.isEmpty() else new_base.join(below(new_base, freed).select("path"), "path", "left_anti")


def deciding_paths(touched: DataFrame, *tables: DataFrame, atomic: Sequence[str] = ()) -> DataFrame | None:
    """All paths that a plan must look at so that it decides the ``touched`` ones
    as a plan over everything would; None means everything.

    These are the touched paths, their ancestors, and what lies below each of
    them that isn't the same plain directory in all ``tables`` (deleted, new,
    turned into something else, unreadable), or is decided as one group."""
    touched = touched.select("path").distinct()
    near = materialize(touched.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct(), "near")
    if not touched.where("path = ''").isEmpty():
        return None
    seen = None
    for t in tables:
        good = F.lit(True) if "error" not in t.columns else F.col("error").isNull()
        if not t.where((F.col("path") == "") & ~good).isEmpty():
            return None
        rows = t.join(near, "path", "left_semi").select("path", (F.col("kind") == DIRECTORY).alias("dir"), good.alias("good"))
        seen = rows if seen is None else seen.unionByName(rows)
    known = seen.groupBy("path").agg(F.count(F.when(F.col("dir") & F.col("good"), 1)).alias("plain"), F.bool_or("dir").alias("dir"))
    open_ = known.where(F.col("dir") & ((F.col("plain") < len(tables)) | any_of(F.col("path"), atomic))).select(F.col("path").alias("_above"))
    open_ = materialize(open_, "open")
    found = near
    if not open_.isEmpty():
        for t in tables:
            found = found.unionByName(below(t.select("path"), open_).select("path"))
    return materialize(found.distinct(), "deciding")


def orphans(listing: DataFrame) -> DataFrame:
    """Rows whose parent is no directory row of the listing; top-level entries
    lie in the root, which needs no row."""
    directories = listing.where(F.col("kind") == DIRECTORY).select(F.col("path").alias("_above"))
    rows = listing.withColumn("_above", P.parent(F.col("path"))).where(F.col("_above") != "")
    return rows.join(directories, "_above", "left_anti").drop("_above")
