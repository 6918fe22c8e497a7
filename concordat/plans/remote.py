"""Cycles between a local listing and a remote one, which is known by entity tags.

The two sides have no fingerprint in common: the local one hashes contents, the
remote one has the server's tags. So the base keeps what each side looked like
when they last agreed (``remote_fp``, ``remote_length`` and ``remote_mtime``
beside ``fp``, ``length`` and ``mtime``), and each side is compared with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.config import JobConfig
from concordat.functions import fingerprints as FP
from concordat.functions import paths as P
from concordat.operators import guards as G
from concordat.operators.snapshots import check_keys
from concordat.operators.updates import detect_remote_updates, detect_updates, shield_unread
from concordat.plans.cycle import Outcome, commit, decide, scope
from concordat.session import materialize

#: Columns of the remote side in the base, and what they stand for.
REMOTE = {"remote_fp": "fp", "remote_length": "length", "remote_mtime": "mtime"}


def tag_fp(remote: DataFrame) -> DataFrame:
    """A remote listing with its tag fingerprints; directories have none."""
    fp = FP.etag_fp(F.col("etag"), P.name(F.col("path")), F.col("length"), F.col("mtime"))
    return remote.withColumn("fp", F.when(F.col("kind") == "file", fp))


def remote_base(local: DataFrame, remote: DataFrame) -> DataFrame:
    """First base of two sides that are known to agree: the paths that both have
    as the same kind. Contents aren't compared."""
    seen = tag_fp(remote).select("path", "kind", *[F.col(c).alias(r) for r, c in REMOTE.items()])
    return local.join(seen, ["path", "kind"]).select(*local.columns, *REMOTE)


def _as_local(base: DataFrame) -> DataFrame:
    return base.drop(*REMOTE)


def _as_remote(base: DataFrame) -> DataFrame:
    return base.drop(*REMOTE.values()).withColumnsRenamed(REMOTE)


def plan_remote(local: DataFrame, remote: DataFrame, base: DataFrame, cfg: JobConfig = JobConfig()) -> DataFrame:
    """Plan with the local side left. With ``cfg.update.trust_size`` a remote
    file of the base's size counts as unchanged whatever its tag.

    Files that are new or changed on both sides are conflicts, as nothing tells
    whether a content has a tag. The plan is written out.
    """
    if list(cfg.keys) != ["path"]:
        raise ValueError("remote cycles are over listings, whose key is the path")
    if cfg.check_keys:
        check_keys(local, cfg.keys, remote, base)
    if cfg.guard_empty:
        G.guard_empty_side(local, base, "left")
        G.guard_empty_side(remote, base, "right")
    local, remote, base = (scope(t, cfg) for t in (local, remote, base))
    u1 = shield_unread(detect_updates(local, _as_local(base), cfg.keys, cfg.update), local)
    u2 = shield_unread(detect_remote_updates(remote, _as_remote(base), cfg.update), remote)
    return materialize(decide(u1, u2, cfg), "plan")


def commit_remote(local: DataFrame, remote: DataFrame, base: DataFrame, plan: DataFrame, cfg: JobConfig = JobConfig(), **more) -> Outcome:
    """Carry out a plan. What a side gets has no fingerprint of that side yet
    (``remote_fp`` of uploads, ``fp`` of downloads is null in the base);
    :func:`learn` fills it in."""
    left = local.withColumns({"remote_fp": F.lit(None).cast("string"), "remote_length": F.col("length"), "remote_mtime": F.lit(None).cast("timestamp")})
    right = tag_fp(remote).withColumns({r: F.col(c) for r, c in REMOTE.items()}).withColumn("fp", F.lit(None).cast("string"))
    columns = [*base.columns]
    for name in (*left.columns, *right.columns):
        if name not in columns:
            columns.append(name)
    kinds = {f.name: f.dataType for t in (right, left, base) for f in t.schema.fields}
    left, right, old = (t.select(*[F.col(c) if c in t.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]) for t in (left, right, base))
    return commit(left, right, old, plan, cfg, **more)


def sync_remote(local: DataFrame, remote: DataFrame, base: DataFrame, cfg: JobConfig = JobConfig(), **more) -> Outcome:
    """:func:`plan_remote` and :func:`commit_remote`."""
    return commit_remote(local, remote, base, plan_remote(local, remote, base, cfg), cfg, **more)


def learn(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The base with the fingerprints that the cycle couldn't know, from listings
    taken after its transfers. A file whose size isn't the one that was
    transferred was changed again since: it stays unknown, so that the next
    cycle sees it as changed."""
    now_local = local.select("path", F.struct("kind", "fp", "length", "mtime").alias("_local"))
    now_remote = tag_fp(remote).select("path", F.struct("kind", "fp", "length", "mtime").alias("_remote"))
    rows = base.join(now_local, "path", "left").join(now_remote, "path", "left")
    file = F.col("kind") == "file"
    here = F.coalesce(file & F.col("fp").isNull() & (F.col("_local.kind") == "file") & (F.col("_local.length") == F.col("length")), F.lit(False))
    there = F.coalesce(file & F.col("remote_fp").isNull() & (F.col("_remote.kind") == "file") & (F.col("_remote.length") == F.col("remote_length")), F.lit(False))
    found = {"fp": (here, "_local.fp"), "mtime": (here, "_local.mtime"), "remote_fp": (there, "_remote.fp"), "remote_mtime": (there, "_remote.mtime")}
    return rows.select(*[F.when(found[c][0], F.col(found[c][1])).otherwise(F.col(c)).alias(c) if c in found else F.col(c) for c in base.columns])
