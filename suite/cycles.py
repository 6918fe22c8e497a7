"""Whole cycles: directory conflicts, forced rows, backups, history, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import BackupConfig, JobConfig, PlanConfig
from concordat.functions import fingerprints as FP
from concordat.operators import backups as BK
from concordat.operators import delta as D
from concordat.operators import guards as G
from concordat.operators import propagate as A
from concordat.operators import reconcile as R
from concordat.operators.snapshots import snapshot_table
from concordat.operators.tree import orphans
from concordat.plans.caseless import sync_ignoring_case
from concordat.plans.cycle import commit, dry_run, make_plan, sync
from concordat.session import materialize, scratch_path
from concordat.sources import stores
from concordat.streaming.sync import SyncOnChange, sync_repeat
from suite.core import K, ORDERS_JOB, _failures, _MERGED, orders_plan
from suite.fixtures import (LISTING_PLAN_SQL, ORDERS_PLAN_SQL, as_listing, customer3, listing3, order_snapshots,
                            with_directories)
from suite.registry import partitions, query, table

_DOCS = """with docs as (select doc_id, lang||'/'||source as dir, lang||'/'||source||'/'||doc_id||'.txt' as path, text from documents)
"""


def _tree(spark, d):
    doc = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    texts = doc.select("doc_id", path.alias("path"), "text", t0.alias("mtime"))
    edited = texts.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tuple(with_directories(as_listing(t.drop("doc_id"))) for t in (texts, edited))


# -- conflicts and guards -------------------------------------------------------

@query("dir_deleted_vs_edited", _DOCS + """,
hot as (select count(*) > 0 as hot from docs where dir = 'en/src1' and doc_id%10 = 0)
select path, case when dir <> 'en/src1' then 'r2l' when hot then 'conflict' else 'l2r' end as direction,
  case when dir = 'en/src1' and hot then 'deleted on one side, modified on other' end as reason
from docs, hot where dir = 'en/src1' or doc_id%10 = 0
union all select distinct dir, case when hot then 'conflict' else 'l2r' end,
  case when hot then 'deleted on one side, modified on other' end from docs, hot where dir = 'en/src1'""")
def _(spark, d):
    """The left side deleted a directory, the right side edited every tenth file."""
    base, right = _tree(spark, d)
    left = base.where(~F.col("path").rlike("^en/src1(/|$)"))
    return make_plan(left, right, base, JobConfig()).select("path", "direction", "reason")


@query("unreadable_directory", _DOCS + """
select path, 'problem' as direction from docs where dir = 'de/src2'
union all select distinct dir, 'problem' from docs where dir = 'de/src2'""")
def _(spark, d):
    """A directory that could not be read: what lay below it isn't deleted."""
    base, _ = _tree(spark, d)
    here = F.col("path") == "de/src2"
    left = (base.where(~F.col("path").startswith("de/src2/"))
            .withColumn("error", F.when(here, "permission denied")))
    return make_plan(left, base, base, JobConfig()).select("path", "direction")


def _in(folder: str):
    return F.col("path").rlike(f"^{folder}(/|$)")


def _as_file(base, folder: str):
    """The tree with a directory replaced by a file of its name."""
    here = F.col("path") == folder
    kept = base.where(~F.col("path").startswith(f"{folder}/"))
    return kept.withColumns({"kind": F.when(here, "file").otherwise(F.col("kind")), "length": F.when(here, F.lit(9).cast("long")).otherwise(F.col("length")),
                             "fp": F.when(here, F.md5(F.lit("now a file"))).otherwise(F.col("fp"))})


@query("type_conflict_subtree", _DOCS + """
select path, 'conflict' as direction, 'type changed on both sides' as reason from docs where dir = 'fr/src3'
union all select distinct dir, 'conflict', 'type changed on both sides' from docs where dir = 'fr/src3'""")
def _(spark, d):
    """A new file on the left, a new directory of the same name on the right:
    what lies in the directory isn't copied to below the file."""
    tree, _ = _tree(spark, d)
    base, left = tree.where(~_in("fr/src3")), _as_file(tree, "fr/src3")
    return make_plan(left, tree, base, JobConfig()).select("path", "direction", "reason")


@query("dir_became_file", _DOCS + """,
hot as (select count(*) > 0 as hot from docs where dir = 'de/src2' and doc_id%10 = 0)
select path, case when dir <> 'de/src2' then 'r2l' when hot then 'conflict' else 'l2r' end as direction,
  case when dir = 'de/src2' and hot then 'deleted on one side, modified on other' end as reason
from docs, hot where dir = 'de/src2' or doc_id%10 = 0
union all select distinct dir, case when hot then 'conflict' else 'l2r' end,
  case when hot then 'deleted on one side, modified on other' end from docs, hot where dir = 'de/src2'""")
def _(spark, d):
    """The left side turned a directory into a file, the right side edited every
    tenth file."""
    base, right = _tree(spark, d)
    return make_plan(_as_file(base, "de/src2"), right, base, JobConfig()).select("path", "direction", "reason")


@query("no_orphans", _DOCS + """,
gone as (select count(*) as n, count(case when path like '%7.txt' then 1 end) as kept from docs where dir = 'en/src1'),
whole as (select (select count(*) from docs) + (select count(distinct dir) from docs) + (select count(distinct split_part(dir, '/', 1)) from docs) as n),
hot as (select count(*) as n, count(case when doc_id%10 = 0 and path not like '%7.txt' then 1 end) as edited from docs where dir = 'de/src2')
select 'left' as side, 0 as n_orphans, whole.n - gone.n - (gone.n > 0)::int - hot.n as n_rows from whole, gone, hot
union all select 'right', 0, whole.n - gone.n + gone.kept - (gone.n > 0 and gone.kept = 0)::int
  - case when hot.edited > 0 or hot.n = 0 then 0 else hot.n - (select count(*) from docs where dir = 'de/src2' and path like '%7.txt') end from whole, gone, hot
union all select 'base', 0, whole.n - gone.n + gone.kept - (gone.n > 0 and gone.kept = 0)::int
  - case when hot.edited > 0 or hot.n = 0 then 0 else hot.n - (select count(*) from docs where dir = 'de/src2' and path like '%7.txt') end from whole, gone, hot""")
def _(spark, d):
    """A whole cycle in which the left side deleted one directory, of which the
    right side keeps ignored files, and turned another into a file: every entry
    of the new tables lies in a directory."""
    base, right = _tree(spark, d)
    left = _as_file(base.where(~_in("en/src1")), "de/src2")
    out = sync(left, right, base, JobConfig(ignore=("Name *7.txt",)))
    rows = None
    for side, table_ in (("left", out.left), ("right", out.right), ("base", out.base)):
        table_ = materialize(table_, side)
        lost = orphans(table_).agg(F.count("*")).scalar()
        row = table_.agg(F.count("*").alias("n_rows")).select(F.lit(side).alias("side"), lost.alias("n_orphans"), "n_rows")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("unreadable_root", _DOCS + """
select path, 'problem' as direction from docs union all select distinct dir, 'problem' from docs
union all select distinct split_part(dir, '/', 1), 'problem' from docs union all select '', 'problem'""")
def _(spark, d):
    """The root of one side could not be read: nothing counts as deleted."""
    base, _ = _tree(spark, d)
    root = spark.createDataFrame([("", "directory", "permission denied")], "path string, kind string, error string")
    left = base.limit(0).unionByName(root, allowMissingColumns=True)
    return make_plan(left, base, base, JobConfig()).select("path", "direction")


@query("guard_empty_side", """
select 'no rows' as side, count(*) > 0 as refused from documents union all select 'only an error', count(*) > 0 from documents
union all select 'only the root', count(*) > 0 from documents union all select 'one entry', count(*) < 0 from documents""")
def _(spark, d):
    """Which sides the guard refuses against the tree of documents as base."""
    base, _ = _tree(spark, d)
    entry = lambda path, error: base.limit(0).unionByName(spark.createDataFrame(
        [(path, "directory", error)], "path string, kind string, error string"), allowMissingColumns=True)
    sides = {"no rows": base.limit(0), "only an error": entry("", "permission denied"), "only the root": entry("", None), "one entry": entry("en", None)}
    found = []
    for name, side in sides.items():
        try:
            G.guard_empty_side(side, base, name)
            found.append((name, False))
        except G.Refused:
            found.append((name, True))
    return spark.createDataFrame(found, "side string, refused boolean")


@query("forced_deletions", ORDERS_PLAN_SQL + """
select 'l2r' as direction, count(*) as n_deleted from p
where d <> 'equal' and ((ls = 'deleted' and rs <> 'deleted') or (ls = 'unchanged' and rs = 'created'))""")
def _(spark, d):
    return G.deletions(R.force(orders_plan(spark, d), "left"))


@query("guard_save_outcomes", ORDERS_PLAN_SQL + """
select 'all failed' as name, false as save_base union all select 'one skipped', false
union all select 'some done', count(*) > 0 from p where d in ('l2r', 'r2l')""")
def _(spark, d):
    plan = materialize(orders_plan(spark, d), "plan")
    fail = table(spark, d, "orders").select(*K, F.lit("disk full").alias("message"))
    moving = plan.where(F.col("direction") != S.CONFLICT)
    conflicts = plan.where(F.col("direction") == S.CONFLICT)
    one = conflicts.join(conflicts.agg(F.min(K[0]).alias(K[0])), K, "left_semi")
    cases = {"all failed": A.results(moving, K, failures=fail), "one skipped": A.results(one, K),
             "some done": A.results(plan, K, failures=_failures(spark, d))}
    out = None
    for name, done in cases.items():
        row = G.base_decision(done).select(F.lit(name).alias("name"), "save_base")
        out = row if out is None else out.unionByName(row)
    return out


# -- backups and history ----------------------------------------------------------

@query("stash_forced", ORDERS_PLAN_SQL + """
select o_orderkey, r.o_orderstatus as old from r join p using (o_orderkey) where d <> 'equal'""")
def _(spark, d):
    """Everything that a forced side overwrites is kept, whatever its own status."""
    _, _, right = order_snapshots(spark, d)
    done = A.results(R.force(orders_plan(spark, d), "left"), K)
    out = BK.stash_preimages(right, done, K, S.L2R, F.lit("2024-06-01").cast("timestamp"))
    return out.select(*K, F.col("payload.o_orderstatus").alias("old"))


@query("sync_backups", ORDERS_PLAN_SQL + """
select o_orderkey, 'right' as side, r.o_orderstatus as old from r join p using (o_orderkey) where d in ('l2r', 'conflict')
union all select o_orderkey, 'left', l.o_orderstatus from l join p using (o_orderkey) where d = 'r2l'""")
def _(spark, d):
    base, left, right = order_snapshots(spark, d)
    cfg = JobConfig(keys=tuple(K), plan=PlanConfig(prefer="left"), backup=BackupConfig())
    return sync(left, right, base, cfg).backups.select(*K, "side", F.col("payload.o_orderstatus").alias("old"))


@query("sync_history", ORDERS_PLAN_SQL + """
select count(case when d in ('l2r', 'r2l') then 1 end) as propagated, count(case when d = 'conflict' then 1 end) as skipped,
  0 as failed, count(case when d in ('l2r', 'r2l') then 1 end) as n_entries, true as save_base from p where d <> 'equal'""")
def _(spark, d):
    base, left, right = order_snapshots(spark, d)
    out = sync(left, right, base, ORDERS_JOB, sync_id="s1")
    entries = out.entries.groupBy("sync_id").agg(F.count("*").alias("n_entries"))
    return out.record.join(entries, "sync_id").select("propagated", "skipped", "failed", "n_entries", F.lit(out.save_base).alias("save_base"))


@query("conflict_copies_many", """
select lang||'/'||source||'/'||doc_id||'.txt' as path,
  lang||'/'||source||'/'||doc_id||' (conflict on 2024-06-01).'||(120 + doc_id%7)||'.txt' as copy from documents""")
def _(spark, d):
    """Each file has far more than a hundred copies already. The ids are dealt
    out first: the table's few files would make all names in a few tasks."""
    doc = table(spark, d, "documents").select("doc_id", "lang", "source").repartition(partitions(spark), "doc_id")
    stem = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    n = F.explode(F.sequence(F.lit(0), F.lit(119) + (F.col("doc_id") % 7).cast("int")))
    there = doc.select(stem.alias("stem"), n.alias("n")).select(F.concat(
        "stem", F.lit(" (conflict on 2024-06-01)"), F.when(F.col("n") > 0, F.concat(F.lit("."), F.col("n").cast("string"))).otherwise(""),
        F.lit(".txt")).alias("path"))
    files = doc.select(F.concat(stem, F.lit(".txt")).alias("path"))
    return BK.conflict_copies(files, files.unionByName(there), F.lit("2024-06-01").cast("timestamp"))


# -- merges and fingerprints --------------------------------------------------------

@query("merge_second_cycle", _MERGED + "select 'merge' as direction, count(*) as n from m where bad")
def _(spark, d):
    """After a cycle with merges only the column conflicts are left."""
    base, left, right = (snapshot_table(t, ["c_custkey"]) for t in customer3(spark, d))
    cfg = JobConfig(keys=("c_custkey",), plan=PlanConfig(merge=("Regex .*",)))
    out = sync(left, right, base, cfg, merge_values=["c_acctbal", "c_mktsegment"])
    now = [materialize(t, "merged") for t in (out.left, out.right, out.base)]
    again = [snapshot_table(t.drop("kind", "fp"), ["c_custkey"]) for t in now[:2]]
    return R.plan_summary(make_plan(*again, now[2], cfg))


@query("row_fp_types", """
select event_id, value = value + 1e-9 as near_alike, false as nan_is_null, true as maps_alike, true as zeros_alike, false as nested_alike from events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "user_id")
    one, two = F.lit(1.0), F.col("value")
    e = e.withColumns({
        "near": two + 1e-9, "huge": two * 1e300, "nan": F.lit(float("nan")), "none": F.lit(None).cast("double"),
        "m1": F.create_map(F.lit("a"), one, F.lit("b"), two), "m2": F.create_map(F.lit("b"), two, F.lit("a"), one),
        "zero": F.lit(0.0), "minus": F.lit(-0.0), "s1": F.array(F.lit("a,b")), "s2": F.array(F.lit("a"), F.lit("b"))})
    same = lambda a, b: FP.row_fp(e, [a, "huge"]) == FP.row_fp(e, [b, "huge"])
    return e.select("event_id", same("value", "near").alias("near_alike"), same("nan", "none").alias("nan_is_null"),
                    same("m1", "m2").alias("maps_alike"), same("zero", "minus").alias("zeros_alike"), same("s1", "s2").alias("nested_alike"))


@query("delta_candidates_large", LISTING_PLAN_SQL + """
select path, d as direction from p where (d = 'l2r' and ls = 'modified' and llen > 100)
  or (d = 'r2l' and rs = 'modified' and rlen > 100) or (d = 'conflict' and ls = 'modified' and llen > 100)""")
def _(spark, d):
    """Conflicts go to the right here, so that modified files move."""
    base, left, right = listing3(spark, d)
    plan = make_plan(left, right, base, JobConfig(plan=PlanConfig(prefer="left")))
    shown = D.delta_candidates(plan, 100).select("path", F.col("default_direction").alias("direction"))
    return shown


# -- stores and steps -----------------------------------------------------------------

@query("store_base", "select o_orderkey, o_orderstatus, false as before, true as saved, false as dropped from orders where o_orderkey%100 <> 7")
def _(spark, d):
    """A base is absent, saved and read again, and dropped."""
    root = scratch_path(spark, "store")
    base, _, _ = order_snapshots(spark, d)
    before = stores.base_exists(spark, root, "l", "r")
    stores.save_base(spark, root, "l", "r", base)
    saved = stores.base_exists(spark, root, "l", "r")
    out = materialize(stores.load_base(spark, root, "l", "r", base.schema), "loaded")
    stores.drop_base(spark, root, "l", "r")
    gone = stores.base_exists(spark, root, "l", "r")
    return out.select(*K, "o_orderstatus", F.lit(before).alias("before"), F.lit(saved).alias("saved"), F.lit(gone).alias("dropped"))


@query("store_replicas", """
select 'left' as side, count(*) as n from orders where o_orderkey%100 not in (15,30,40) and (o_orderkey%100 <> 7 or o_orderkey%200 = 7)
union all select 'right', count(*) from orders where o_orderkey%100 not in (31,40)""")
def _(spark, d):
    root = scratch_path(spark, "replicas")
    _, left, right = order_snapshots(spark, d)
    stores.write_replicas(left, right, root, K, buckets=4)
    store = stores.VersionedStore(spark, root)
    return (store.load("left").groupBy(F.lit("left").alias("side")).agg(F.count("*").alias("n"))
            .unionByName(store.load("right").groupBy(F.lit("right").alias("side")).agg(F.count("*").alias("n"))))


@query("store_fp_cache", _DOCS + "select path, md5(text) as fp from docs")
def _(spark, d):
    root = scratch_path(spark, "cache")
    stores.save_fp_cache(_tree(spark, d)[0].where("kind = 'file'"), root)
    return stores.load_fp_cache(spark, root).select("path", "fp")


@query("store_history", ORDERS_PLAN_SQL + """
select 's1' as sync_id, count(*) as n from p where d in ('l2r', 'r2l')
union all select 's2', count(*) from p where d in ('l2r', 'r2l')""")
def _(spark, d):
    """Two cycles append; records and entries are read back."""
    root = scratch_path(spark, "history")
    base, left, right = order_snapshots(spark, d)
    for name in ("s1", "s2"):
        out = sync(left, right, base, ORDERS_JOB, sync_id=name)
        stores.append_history(out.record, out.entries, root)
    records, entries = stores.read_history(spark, root)
    return entries.join(records.select("sync_id"), "sync_id").groupBy("sync_id").agg(F.count("*").alias("n"))


@query("sync_case_insensitive", _DOCS + """,
r as (select doc_id, dir, case when doc_id%2 = 1 then dir || '/' || doc_id || '.TXT' else path end as path, text from docs)
select path, md5(case when doc_id%10 = 0 and doc_id%25 <> 0 then text || '!' else text end) as fp from r
union all select dir || '/new' || doc_id || '.txt', md5(text) from docs where doc_id%7 = 0""")
def _(spark, d):
    """The right side spells every other file in capitals and ignores case. The
    left side edited files and added some; of some it has two spellings, which
    can't both go over."""
    base, _ = _tree(spark, d)
    doc = table(spark, d, "documents")
    rows = doc.select("doc_id", F.concat_ws("/", "lang", "source").alias("dir"), "text", F.lit("2024-01-01").cast("timestamp").alias("mtime"))
    named = lambda df, name: with_directories(as_listing(df.withColumn("path", F.concat("dir", F.lit("/"), name)).drop("doc_id", "dir")))
    number = F.col("doc_id").cast("string")
    edited = rows.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    plain, capital = F.concat(number, F.lit(".txt")), F.concat(number, F.lit(".TXT"))
    files = lambda df: df.where("kind = 'file'")
    left = (named(edited, plain).unionByName(files(named(rows.where("doc_id % 7 = 0"), F.concat(F.lit("new"), plain))))
            .unionByName(files(named(rows.where("doc_id % 25 = 0"), capital))))
    right = named(rows, F.when(F.col("doc_id") % 2 == 1, capital).otherwise(plain))
    out = sync_ignoring_case(left, right, base, JobConfig(), "sensitive", "insensitive")
    return files(out.right).select("path", "fp")


_AFTER_CHANGES = _DOCS + """,
hot as (select count(*) > 0 as hot from docs where dir = 'en/src1' and doc_id%10 = 0),
now as (select path, dir, md5(case when doc_id%10 = 0 then text || '!' else text end) as fp from docs)
select 'left' as side, path, fp from now where dir <> 'en/src1'
union all select 'right', path, fp from now, hot where dir <> 'en/src1' or hot"""


def _changed_pair(spark, d):
    """A pair that agreed: then the left side deleted a directory and the right
    side edited every tenth file."""
    base, edited = _tree(spark, d)
    store = stores.ReplicaStore(spark, scratch_path(spark, "pair"), ["path"])
    store.create(left=base, right=base, base=base)
    return store, base.where(~_in("en/src1")), edited


def _sides(store):
    rows = lambda side: store.read(side).where("kind = 'file'").select(F.lit(side).alias("side"), "path", "fp")
    return rows("left").unionByName(rows("right"))


@query("sync_on_change", _AFTER_CHANGES)
def _(spark, d):
    """A stream of change events; the cycle looks at what decides with them."""
    store, left, right = _changed_pair(spark, d)
    sink = SyncOnChange(store, JobConfig())
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    lost = (F.col("lang") == "en") & (F.col("source") == "src1")
    events = docs.where((F.col("doc_id") % 10 == 0) | lost).select(path.alias("path")).unionByName(
        docs.where(lost).select(F.lit("en/src1").alias("path")).distinct())
    folder = scratch_path(spark, "events")
    events.write.parquet(folder)
    store.put(left=left, right=right)
    (spark.readStream.schema("path string").parquet(folder).writeStream.foreachBatch(sink)
     .option("checkpointLocation", scratch_path(spark, "events-ck")).trigger(availableNow=True).start().awaitTermination())
    return _sides(store)


@query("sync_repeat", _AFTER_CHANGES)
def _(spark, d):
    """Whole cycles on a timer, until there was one."""
    store, left, right = _changed_pair(spark, d)
    store.put(left=left, right=right)
    ticks = scratch_path(spark, "ticks")
    table(spark, d, "region").select("r_regionkey").write.parquet(ticks)
    stream = spark.readStream.schema("r_regionkey int").parquet(ticks)
    query_ = sync_repeat(stream, SyncOnChange(store, JobConfig()), scratch_path(spark, "ticks-ck"), "1 second")
    query_.processAllAvailable()
    query_.stop()
    return _sides(store)


@query("clear_history", ORDERS_PLAN_SQL + """
select 'before' as at, 1 as n_records, count(case when d in ('l2r', 'r2l') then 1 end) as n_entries from p union all select 'after', 0, 0""")
def _(spark, d):
    root = scratch_path(spark, "history")
    base, left, right = order_snapshots(spark, d)
    out = sync(left, right, base, ORDERS_JOB, sync_id="s1")
    stores.append_history(out.record, out.entries, root)
    rows = []
    for at in ("before", "after"):
        records, entries = stores.read_history(spark, root)
        rows.append((at, records.count(), entries.count()))
        stores.clear_history(spark, root)
    return spark.createDataFrame(rows, "at string, n_records long, n_entries long")


@query("dry_run_commit", ORDERS_PLAN_SQL + """
select l.o_orderkey, l.o_orderstatus from l where o_orderkey not in (select o_orderkey from p where d = 'r2l')
union all select r.o_orderkey, r.o_orderstatus from r where o_orderkey in (select o_orderkey from p where d = 'r2l')""")
def _(spark, d):
    base, left, right = order_snapshots(spark, d)
    plan = dry_run(left, right, base, ORDERS_JOB)
    return commit(left, right, base, plan, ORDERS_JOB).left.select(*K, "o_orderstatus")
