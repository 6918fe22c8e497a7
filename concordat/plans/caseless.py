"""Cycles over listings of which a side doesn't tell cases (or Unicode forms) apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.config import JobConfig
from concordat.functions import paths as P
from concordat.operators.tree import below
from concordat.plans.cycle import Outcome, sync
from concordat.session import materialize

SHOWN = "_shown"


@dataclass(frozen=True)
class CaselessOutcome:
    """New tables with their own names, the cycle over folded names, and the
    entries that were left out: ``side, path, problem``."""

    left: DataFrame
    right: DataFrame
    base: DataFrame
    cycle: Outcome
    collisions: DataFrame


def folded(listing: DataFrame, mode: str) -> DataFrame:
    """``path`` becomes the comparison key; the name stays in a column beside it."""
    return listing.withColumn(SHOWN, F.col("path")).withColumn("path", P.path_key(F.col("path"), mode))


def collisions(listing: DataFrame) -> DataFrame:
    """Keys that several entries of a folded listing share."""
    return listing.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")


def _names(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of a new table under names that fit the table they are in: an entry
    that was there keeps its name, a new one comes below the names of the
    directories that were."""
    had = old.select(F.col("path"), F.col(SHOWN).alias("_had"))
    rows = new.join(had, "path", "left")
    fresh = rows.where("_had is null")
    above = (fresh.select("path", F.posexplode(P.ancestors(P.parent(F.col("path")))).alias("_i", "_above"))
             .join(had.withColumnRenamed("path", "_above"), "_above").groupBy("path")
             .agg(F.max(F.struct(F.col("_i"), F.col("_had").alias("name"))).alias("_dir")))
    rows = rows.join(above, "path", "left")
    tail = F.array_join(F.expr(f"slice(split({SHOWN}, '/'), _dir._i + 2, size(split({SHOWN}, '/')))"), "/")
    name = F.coalesce("_had", F.when(F.col("_dir").isNotNull(), F.concat(F.col("_dir.name"), F.lit("/"), tail)), F.col(SHOWN))
    return rows.withColumn("path", name).select(*[c for c in new.columns if c != SHOWN])


def sync_ignoring_case(left: DataFrame, right: DataFrame, base: DataFrame, cfg: JobConfig, left_mode: str, right_mode: str, **more) -> CaselessOutcome:
    """A cycle in which names are compared as :func:`paths.pair_case_mode` says
    for the two sides. Entries of one side that become equal are problems: they
    and what lies below their names are left out of all three tables and stay as
    they are. Every table keeps its own spelling."""
    mode = P.pair_case_mode(left_mode, right_mode)
    sides = {name: folded(t, mode) for name, t in (("left", left), ("right", right), ("base", base))}
    clash = None
    for t in sides.values():
        clash = collisions(t) if clash is None else clash.unionByName(collisions(t))
    clash = materialize(clash.distinct().withColumnRenamed("path", "_above"), "clash")
    kept, out_of_it, problems = dict(sides), {}, None
    none = clash.isEmpty()
    for name, t in sides.items():
        if not none:
            hit = materialize(below(t, clash, itself=True).select("path"), "hit")
            kept[name] = t.join(hit, "path", "left_anti")
            out_of_it[name] = t.join(hit, "path", "left_semi")
        found = out_of_it.get(name, t.limit(0)).select(F.lit(name).alias("side"), F.col(SHOWN).alias("path"), F.lit("name is not unique when case is ignored").alias("problem"))
        problems = found if problems is None else problems.unionByName(found)
    cycle = sync(kept["left"], kept["right"], kept["base"], cfg, **more)
    result = {}
    for name, new in (("left", cycle.left), ("right", cycle.right), ("base", cycle.base)):
        rows = _names(new, kept[name])
        if name in out_of_it:
            old = out_of_it[name].withColumn("path", F.col(SHOWN)).drop(SHOWN)
            rows = rows.unionByName(old)
        result[name] = rows
    return CaselessOutcome(result["left"], result["right"], result["base"], cycle, problems)
