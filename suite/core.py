"""Snapshots, update detection, reconciliation, policy, edits, propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import ApplyConfig, JobConfig, PlanConfig, UpdateConfig
from concordat.functions import fingerprints as FP
from concordat.operators import edits as E
from concordat.operators import guards as G
from concordat.operators import propagate as A
from concordat.operators import reconcile as R
from concordat.operators import updates as U
from concordat.operators import views as V
from concordat.operators.listings import atomic_groups
from concordat.operators.merge import three_way_merge
from concordat.operators.snapshots import snapshot_table
from concordat.plans.cycle import make_plan, sync
from concordat.session import materialize
from suite.fixtures import (CUSTOMER3_SQL, LISTING3_SQL, LISTING_PLAN_SQL, ORDER_KEYS, ORDERS3_SQL,
                            ORDERS_PLAN_SQL, customer3, dated_order_snapshots, listing3,
                            order_snapshots, orders3, with_directories)
from suite.registry import query, table

K = ORDER_KEYS
ORDERS_JOB = JobConfig(keys=tuple(K))


def orders_plan(spark, d, cfg: PlanConfig = PlanConfig()):
    base, left, right = order_snapshots(spark, d)
    return make_plan(left, right, base, JobConfig(keys=tuple(K), plan=cfg))


def dated_plan(spark, d, cfg: PlanConfig):
    base, left, right = dated_order_snapshots(spark, d)
    return make_plan(left, right, base, JobConfig(
        keys=tuple(K), plan=cfg, update=UpdateConfig(compare_times=False)))


def listing_plan(spark, d, cfg: PlanConfig = PlanConfig()):
    base, left, right = listing3(spark, d)
    return make_plan(left, right, base, JobConfig(plan=cfg))


def shown(plan, *keys):
    """Keys, statuses, direction and reason."""
    return plan.select(*keys, R.status("left").alias("left_status"),
                       R.status("right").alias("right_status"), "direction", "reason")


ORDERS_SHOWN = """select o_orderkey, ls as left_status, rs as right_status, {d} as direction,
  {why} as reason from p"""
DEFAULT = {"d": "d", "why": "case when d = 'conflict' then why end"}


def orders_sql(d: str = "d", why: str = "case when d = 'conflict' then why end", tail: str = "") -> str:
    return ORDERS_PLAN_SQL + ORDERS_SHOWN.format(d=d, why=why) + tail


# -- A2, D3 -------------------------------------------------------------------

@query("snapshot_table", """
select o_orderkey, 'file' as kind, md5(concat_ws('|', cast(o_custkey as varchar),
  replace(replace(o_orderstatus, '\\', '\\\\'), '|', '\\p'),
  cast(o_totalprice as varchar),
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'),
  replace(replace(o_orderpriority, '\\', '\\\\'), '|', '\\p'))) as fp from orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    return snapshot_table(o, K, check=True).select(*K, "kind", "fp")


@query("row_fp", """
select l_orderkey, l_linenumber, md5(concat_ws('|',
  cast(l_partkey as varchar), cast(l_suppkey as varchar),
  coalesce(cast(nullif(l_quantity, 1) as varchar), '\\N'),
  cast(l_discount as varchar), l_returnflag,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f'))) as fp from lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn(
        "l_quantity", F.nullif(F.col("l_quantity"), F.lit(1.0)))
    cols = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"]
    return li.select("l_orderkey", "l_linenumber", FP.row_fp(li, cols).alias("fp"))


# -- E ------------------------------------------------------------------------

@query("classify_left", "with " + ORDERS3_SQL + """
select coalesce(l.o_orderkey, b.o_orderkey) as o_orderkey,
  case when l.o_orderkey is null then 'deleted' when b.o_orderkey is null then 'created'
    when l.o_orderstatus <> b.o_orderstatus then 'modified' else 'unchanged' end as status
from l full join b on l.o_orderkey = b.o_orderkey""")
def _(spark, d):
    base, left, _ = order_snapshots(spark, d)
    return U.classify(left, base, K).select(*K, "status")


@query("detect_updates_left", ORDERS_PLAN_SQL + "select k as o_orderkey, st as status from lu")
def _(spark, d):
    base, left, _ = order_snapshots(spark, d)
    return U.detect_updates(left, base, K).select(*K, "status")


@query("detect_updates_right", ORDERS_PLAN_SQL + "select k as o_orderkey, st as status from ru")
def _(spark, d):
    base, _, right = order_snapshots(spark, d)
    return U.detect_updates(right, base, K).select(*K, "status")


@query("detect_updates_listing", LISTING_PLAN_SQL + """
select path, st as status, md5(text) as fp, md5(old) as prev_fp, len as length from lu""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return U.detect_updates(left, base, ["path"]).select(
        "path", "status", "fp", "prev_fp", F.col("props.length").alias("length"))


@query("fast_check", """
select concat(lang,'/',source,'/',cast(doc_id as varchar),'.txt') as path,
  case when doc_id%3 = 0 then 'unchanged' when doc_id%3 = 1 then 'modified'
    else 'propsChanged' end as status from documents""")
def _(spark, d):
    """Third 0: other content, same size and time (cleared). Third 1: other
    content and time. Third 2: same content, later time."""
    doc = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    third = F.col("doc_id") % 3
    size = F.octet_length("text").cast("long").alias("length")
    base = doc.select(path.alias("path"), size, t0.alias("mtime"), F.md5("text").alias("fp"))
    cur = doc.select(
        path.alias("path"), size,
        F.when(third == 0, t0).otherwise(t0 + F.expr("interval 1 hour")).alias("mtime"),
        F.when(third == 2, F.md5("text")).otherwise(F.md5(F.reverse(F.concat("text", F.lit("#"))))).alias("fp"))
    return U.classify(cur, base, ["path"]).select("path", "status")


def _props_pairs(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    ms = (F.col("event_id") % 4500).cast("int")
    other = F.timestamp_millis(F.unix_millis(ts) + ms)
    side = lambda t, perms: F.struct(
        perms.alias("perms"), t.alias("mtime"), F.col("user_id").alias("length"))
    return (F.timestamp_millis(F.unix_millis(ts)), other, side, e)


@query("props_similar", """
select event_id, cast((event_id % 4500) / 1000 as integer) = 0 or (event_id%4500) < 1000 as plain,
  (event_id % 4500) < 3000 as fat, (event_id % 4500) < 1000 and event_id%2 = 0 as masked
from events""")
def _(spark, d):
    from concordat.functions.props import props_similar
    t1, t2, side, e = _props_pairs(spark, d)
    a, b = side(t1, F.lit(0o644)), side(t2, F.lit(0o644))
    c = side(t2, F.when(F.col("event_id") % 2 == 0, 0o1644).otherwise(0o640))
    return e.select("event_id", props_similar(a, b).alias("plain"),
                    props_similar(a, b, fat=True).alias("fat"), props_similar(a, c).alias("masked"))


@query("stamp_unchanged", """
select event_id, event_id%3 <> 0 and event_id%5 <> 0 as same from events""")
def _(spark, d):
    from concordat.functions.props import stamp_unchanged
    e = table(spark, d, "events")
    row = lambda inode, rescan: F.struct(
        F.lit("file").alias("kind"), inode.alias("inode"), rescan.alias("rescan"),
        F.col("user_id").alias("length"), F.col("ts").alias("mtime"))
    a = row(F.lit(None).cast("long"), F.lit(False))
    b = row(F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("long")), F.col("event_id") % 5 == 0)
    return e.select("event_id", stamp_unchanged(a, b).alias("same"))


@query("created_keys", "with " + LISTING3_SQL + "select path, md5(text) as fp from l where path not in (select path from b)")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return U.created_keys(left, base, ["path"]).select("path", "fp")


@query("deleted_keys", "with " + LISTING3_SQL + "select path, md5(text) as fp from b where path not in (select path from l)")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return U.deleted_keys(left, base, ["path"]).select("path", "fp")


def _mixed(spark, d):
    """Listings with links, directories in place of files, and unreadable rows."""
    base, left, _ = listing3(spark, d)
    n = F.regexp_extract("path", r"(\d+)\.txt$", 1).try_cast("int")
    mark = lambda df, link: df.select(
        "path", F.when(n % 11 == 0, "symlink").when((n % 13 == 0) & F.lit(link == "new"), "directory")
        .otherwise(F.col("kind")).alias("kind"), "length", "mtime", "perms", "fp",
        F.when(n % 11 == 0, F.when(n % 2 == 0, F.lit(link)).otherwise("same")).alias("target"),
        F.when((n % 17 == 0) & F.lit(link == "new"), "cannot read").alias("error"))
    return mark(base, "old"), mark(left, "new")


_MIXED_SQL = "with " + LISTING3_SQL + """,
n as (select coalesce(l.path, b.path) as path, l.path is not null as here, b.path is not null as before,
  cast(regexp_extract(coalesce(l.path, b.path), '([0-9]+)\\.txt$', 1) as integer) as n, l.text <> b.text as differs
  from l full join b on l.path = b.path),
k as (select *, case when n%11 = 0 then 'symlink' when n%13 = 0 then 'directory' else 'file' end as kind,
  case when n%11 = 0 then 'symlink' else 'file' end as prev_kind from n)
"""


@query("type_changes", _MIXED_SQL + """
select path, prev_kind, kind from k where here and before and kind <> prev_kind and n%17 <> 0""")
def _(spark, d):
    base, left = _mixed(spark, d)
    u = U.detect_updates(left, base, ["path"]).where(F.col("error").isNull())
    return U.type_changes(u.where(F.col("prev_kind").isNotNull())).select("path", "prev_kind", "kind")


@query("link_updates", _MIXED_SQL + """
select path, 'new' as target from k where here and before and kind = 'symlink' and n%2 = 0 and n%17 <> 0""")
def _(spark, d):
    base, left = _mixed(spark, d)
    u = U.detect_updates(left, base, ["path"]).where(F.col("status") == S.MODIFIED)
    return U.link_updates(u).select("path", "target")


@query("scan_errors", _MIXED_SQL + "select path, 'cannot read' as error from k where here and n%17 = 0")
def _(spark, d):
    base, left = _mixed(spark, d)
    return U.scan_errors(U.detect_updates(left, base, ["path"])).select("path", "error")


@query("status_of", _MIXED_SQL + """
select case when here and n%17 = 0 then 'error' when not here then 'deleted' when not before then 'created'
  when kind <> prev_kind then 'modified' when kind = 'symlink' then
    case when n%2 = 0 then 'modified' else 'unchanged' end
  when differs then 'modified' else 'unchanged' end as status, count(*) as n from k group by 1""")
def _(spark, d):
    base, left = _mixed(spark, d)
    return U.classify(left, base, ["path"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("dir_updates", """
with s as (select lang||'/'||source as path, count(*) as n_before,
    count(case when source <> 'src1' then 1 end) as kept from documents group by 1),
t as (select lang as path, count(distinct source) as n from documents group by 1)
select path, path like '%/src2' as props_changed, kept = 0 as emptied, kept as n_now, n_before from s
union all select path, false, false, n, n from t""")
def _(spark, d):
    """Everything in the src1 directories went away; src2 got other permissions."""
    doc = table(spark, d, "documents").select(F.concat_ws(
        "/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.lit("file").alias("kind"), F.lit(1).cast("long").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(0o644).alias("perms"),
        F.lit("x").alias("fp"))
    base = with_directories(doc)
    src1 = F.col("path").contains("/src1/")
    cur = base.where(~src1).withColumn("perms", F.when(
        F.col("path").endswith("/src2"), 0o700).otherwise(F.col("perms")))
    return U.dir_updates(cur, base).select("path", "props_changed", "emptied", "n_now", "n_before")


@query("apply_updates", "with " + LISTING3_SQL + "select path, md5(text) as fp, octet_length(encode(text)) as length from l")
def _(spark, d):
    """Folding the left updates into the base gives the left listing."""
    base, left, _ = listing3(spark, d)
    return U.apply_updates(base, U.detect_updates(left, base, ["path"]), ["path"]).select(
        "path", "fp", "length")


# -- F ------------------------------------------------------------------------

@query("plan_summary", ORDERS_PLAN_SQL + """
select ls as left_status, rs as right_status, d as direction, count(*) as n from p group by 1, 2, 3""")
def plan_summary(spark, d):
    plan = orders_plan(spark, d)
    return shown(plan, *K).groupBy("left_status", "right_status", "direction").agg(
        F.count(F.lit(1)).alias("n"))


@query("direction_counts", LISTING_PLAN_SQL + "select d as direction, count(*) as n from p group by 1")
def _(spark, d):
    return R.plan_summary(listing_plan(spark, d))


@query("pair_updates", ORDERS_PLAN_SQL + "select o_orderkey, ls as left_status, rs as right_status from p")
def _(spark, d):
    base, left, right = order_snapshots(spark, d)
    pairs = R.pair_updates(U.detect_updates(left, base, K), U.detect_updates(right, base, K), K)
    return pairs.select(*K, R.status("left").alias("left_status"), R.status("right").alias("right_status"))


@query("reconcile_orders", orders_sql())
def _(spark, d):
    return shown(orders_plan(spark, d), *K)


@query("reconcile_listing", LISTING_PLAN_SQL + """
select path, ls as left_status, rs as right_status, d as direction,
  case when d = 'conflict' then why end as reason from p""")
def _(spark, d):
    return shown(listing_plan(spark, d), "path")


@query("content_equal", LISTING_PLAN_SQL + """
select path, (ls = 'deleted' and rs = 'deleted') or coalesce(ltext = rtext, false) as same
from p where ls <> 'unchanged' and rs <> 'unchanged'""")
def _(spark, d):
    base, left, right = listing3(spark, d)
    pairs = R.pair_updates(U.detect_updates(left, base, ["path"]), U.detect_updates(right, base, ["path"]), ["path"])
    both = pairs.where(F.col("left").isNotNull() & F.col("right").isNotNull())
    return both.select("path", R.content_equal().alias("same"))


@query("count_equal", ORDERS_PLAN_SQL + "select count(*) as n_equal from p where d = 'equal'")
def _(spark, d):
    return R.count_equal(orders_plan(spark, d))


@query("conflict_reasons", ORDERS_PLAN_SQL + """
select why as reason, count(*) as n from p where d = 'conflict' group by 1""")
def _(spark, d):
    return (orders_plan(spark, d).where(F.col("direction") == S.CONFLICT)
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query("problems", _MIXED_SQL + "select path, 'cannot read' as problem from k where here and n%17 = 0")
def _(spark, d):
    base, left = _mixed(spark, d)
    plan = make_plan(left, base, base, JobConfig())
    return R.problems(plan, ["path"])


@query("merge_eligible", LISTING_PLAN_SQL + """
select path, case when d = 'conflict' and regexp_matches(path, '^(en|de)/') and ls <> 'deleted' and rs <> 'deleted'
  then 'merge' else d end as direction from p""")
def _(spark, d):
    plan = listing_plan(spark, d, PlanConfig(merge=("Path {en,de}/*/*.txt",)))
    return plan.select("path", "direction")


@query("dir_props", """
with n as (select distinct lang||'/'||source as path from documents union select distinct lang from documents),
c as (select path, path like '%src1' as lc, path like '%src1' or path like '%src2' as rc from n)
select path, case when lc then 'conflict' else 'r2l' end as direction,
  case when lc then 'properties changed on both sides' end as reason from c where lc or rc""")
def _(spark, d):
    """Directory permissions differ: src1 on both sides, src2 on the right."""
    base = with_directories(table(spark, d, "documents").select(
        F.concat_ws("/", "lang", "source", F.lit("x")).alias("path")).distinct().select(
        "path", F.lit("file").alias("kind"), F.lit(0).cast("long").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(0).alias("perms"),
        F.lit(None).cast("string").alias("fp"))).where(F.col("kind") == "directory")
    name = F.col("path")
    left = base.withColumn("perms", F.when(name.endswith("src1"), 0o700).otherwise(F.col("perms")))
    right = base.withColumn("perms", F.when(name.endswith("src1"), 0o711)
                            .when(name.endswith("src2"), 0o700).otherwise(F.col("perms")))
    plan = make_plan(left, right, base, JobConfig(plan=PlanConfig(compare_dir_props=True)))
    return plan.select("path", "direction", "reason")


# -- policy -------------------------------------------------------------------

_NOT_EQUAL = "case when d = 'equal' then d else '{}' end"

for _side, _dir in (("left", "l2r"), ("right", "r2l")):
    @query(f"force_{_side}", orders_sql(_NOT_EQUAL.format(_dir), "null"))
    def _(spark, d, side=_side):
        return shown(R.force(orders_plan(spark, d), side), *K).withColumn("reason", F.lit(None).cast("string"))

    @query(f"prefer_{_side}", orders_sql(f"case when d = 'conflict' then '{_dir}' else d end", "cast(null as varchar)"))
    def _(spark, d, side=_side):
        return shown(R.prefer(orders_plan(spark, d), side), *K)

_DATED = "d"
_NEWER = f"""case when {_DATED} = 'conflict' and ls <> 'deleted' and rs <> 'deleted'
  then case when lt > rt then '{{gt}}' when rt > lt then '{{lt}}' else 'conflict' end else {_DATED} end"""


@query("prefer_newer", ORDERS_PLAN_SQL + f"select o_orderkey, {_NEWER.format(gt='l2r', lt='r2l')} as direction from p")
def _(spark, d):
    return dated_plan(spark, d, PlanConfig(prefer_newer=True)).select(*K, "direction")


@query("prefer_older", ORDERS_PLAN_SQL + f"select o_orderkey, {_NEWER.format(gt='r2l', lt='l2r')} as direction from p")
def _(spark, d):
    return dated_plan(spark, d, PlanConfig(prefer="older")).select(*K, "direction")


for _flag, _st, _text in (("no_deletion", "deleted", "deletion not allowed"),
                          ("no_creation", "created", "creation not allowed"),
                          ("no_update", "modified", "update not allowed")):
    _hit_l, _hit_r = f"(d = 'l2r' and ls = '{_st}')", f"(d = 'r2l' and rs = '{_st}')"

    @query(_flag, orders_sql(
        f"case when {_hit_l} or {_hit_r} then 'conflict' else d end",
        f"case when {_hit_l} then '{_text} (replica 1)' when {_hit_r} then '{_text} (replica 2)' "
        "when d = 'conflict' then why end"))
    def _(spark, d, flag=_flag):
        return shown(orders_plan(spark, d, PlanConfig(**{flag: True})), *K)


@query("force_partial", ORDERS_PLAN_SQL + """
select o_orderkey, case when d = 'equal' then d when cast(o_orderkey as varchar) like '%1' then 'r2l'
  when regexp_matches(cast(o_orderkey as varchar), '[0-3]$') then 'l2r' else d end as direction from p""")
def _(spark, d):
    rules = (("Name *1", "right"), ("Name *[0-3]", "left"))
    return orders_plan(spark, d, PlanConfig(force_partial=rules)).select(*K, "direction")


@query("prefer_partial", ORDERS_PLAN_SQL + """
select o_orderkey, case when d <> 'conflict' then d when cast(o_orderkey as varchar) like '%3' then 'r2l'
  when cast(o_orderkey as varchar) like '%2' then 'l2r' else d end as direction from p""")
def _(spark, d):
    rules = (("Regex 3$", "right"), ("Regex 2$", "left"))
    return orders_plan(spark, d, PlanConfig(prefer_partial=rules)).select(*K, "direction")


@query("apply_policy", ORDERS_PLAN_SQL + """,
q as (select *, case when d = 'equal' then d when cast(o_orderkey as varchar) like '%1' then 'r2l'
  when d = 'conflict' and cast(o_orderkey as varchar) like '%3' then 'l2r' else d end as d1 from p),
s as (select *, case when d1 = 'conflict' then 'r2l' else d1 end as d2, d1 = 'conflict' as settled from q)
select o_orderkey, d as default_direction,
  case when not settled and d2 = 'l2r' and ls = 'deleted' then 'conflict'
       when not settled and d2 = 'r2l' and rs = 'deleted' then 'conflict' else d2 end as direction,
  case when not settled and d2 = 'l2r' and ls = 'deleted' then 'deletion not allowed (replica 1)'
       when not settled and d2 = 'r2l' and rs = 'deleted' then 'deletion not allowed (replica 2)' end as reason
from s""")
def _(spark, d):
    cfg = PlanConfig(force_partial=(("Name *1", "right"),), prefer_partial=(("Name *3", "left"),),
                     prefer="right", no_deletion=True)
    return orders_plan(spark, d, cfg).select(*K, "default_direction", "direction", "reason")


@query("atomic_groups", LISTING_PLAN_SQL + """,
g as (select *, case when regexp_matches(path, '^(en|fr)/src[0-9]+/') then regexp_extract(path, '^((en|fr)/src[0-9]+)/', 1) end as g from p),
bad as (select distinct g from g where d = 'conflict' and g is not null)
select path, case when d <> 'equal' and g in (select g from bad) then 'conflict' else d end as direction
from g""")
def _(spark, d):
    plan = listing_plan(spark, d)
    return atomic_groups(plan, ["Path {en,fr}/src*"]).select("path", "direction")


# -- sorting and sizes --------------------------------------------------------

_ORDERS = {
    "default": "string_split(path, '/')",
    "size": "-(llen + rlen), string_split(path, '/')",
    "new_first": "case when ls = 'created' or rs = 'created' then 0 else 1 end, string_split(path, '/')",
}
for _mode, _by in _ORDERS.items():
    @query(f"sort_plan_{_mode}", LISTING_PLAN_SQL + f"""
select path, d as direction, row_number() over (order by case when d = 'conflict' then 0 else 1 end, {_by})
  as position from p where d <> 'equal'""")
    def _(spark, d, mode=_mode):
        return V.rank_plan(listing_plan(spark, d), ["path"], mode).select("path", "direction", "position")


@query("plan_page", LISTING_PLAN_SQL + """,
s as (select path, row_number() over (order by case when d = 'conflict' then 0 else 1 end, string_split(path, '/'))
  as position from p where d <> 'equal')
select path, position from s where position between 23 and 37""")
def _(spark, d):
    return V.plan_page(listing_plan(spark, d), ["path"], center=30).select("path", "position")


@query("item_size", LISTING_PLAN_SQL + """
select path, case when ls in ('created','modified') then 1 else 0 end as left_items, llen as left_bytes,
  case when rs in ('created','modified') then 1 else 0 end as right_items, rlen as right_bytes from p""")
def _(spark, d):
    return R.item_size(listing_plan(spark, d)).select(
        "path", "left_items", "left_bytes", "right_items", "right_bytes")


@query("transfer_volume", LISTING_PLAN_SQL + """
select d as direction, count(case when (d = 'l2r' and ls <> 'deleted') or (d = 'r2l' and rs <> 'deleted') then 1 end) as n_items,
  cast(sum(case when d = 'l2r' then llen else rlen end) as bigint) as n_bytes
from p where d in ('l2r','r2l') group by 1""")
def _(spark, d):
    return A.transfer_volume(listing_plan(spark, d))


# -- edits --------------------------------------------------------------------

def edited_sql(direction: str, reason: str) -> str:
    return ORDERS_PLAN_SQL + f"select o_orderkey, {direction} as direction, {reason} as reason from p"


_KEEP_WHY = "case when d = 'conflict' then why end"
_EDITS = {
    "skip_all": (E.skip_all, "case when d = 'equal' then d else 'conflict' end",
                 "case when d <> 'equal' then 'skipped by user' end"),
    "force_everything_right": (E.force_right, "case when d = 'equal' then d else 'l2r' end", "cast(null as varchar)"),
    "force_everything_left": (E.force_left, "case when d = 'equal' then d else 'r2l' end", "cast(null as varchar)"),
    "resolve_conflicts_left": (lambda p: E.resolve_conflicts(p, "left"),
                               "case when d = 'conflict' then 'l2r' else d end", "cast(null as varchar)"),
    "resolve_conflicts_right": (lambda p: E.resolve_conflicts(p, "right"),
                                "case when d = 'conflict' then 'r2l' else d end", "cast(null as varchar)"),
    "skip_conflicts": (E.skip_conflicts, "d", "case when d = 'conflict' then 'skipped by user' end"),
    "skip_deletions": (E.skip_deletions,
                       "case when d <> 'equal' and (ls = 'deleted' or rs = 'deleted') then 'conflict' else d end",
                       "case when d <> 'equal' and (ls = 'deleted' or rs = 'deleted') then 'deletion skipped' "
                       "when d = 'conflict' then why end"),
    "revert_all": (lambda p: E.revert_all(E.force_left(p)), "d", _KEEP_WHY),
    "accept_defaults": (lambda p: E.accept_defaults(E.set_direction(p, E.is_created(), "r2l")), "d", _KEEP_WHY),
    "set_direction": (
        lambda p: E.set_direction(p, E.and_(E.is_modified(), E.not_(E.or_(E.is_conflict(), E.is_rtl()))),
                                  "conflict", "held back"),
        "case when d = 'l2r' and (ls = 'modified' or rs = 'modified') then 'conflict' else d end",
        "case when d = 'l2r' and (ls = 'modified' or rs = 'modified') then 'held back' "
        "when d = 'conflict' then why end"),
}
for _name, (_fn, _d, _why) in _EDITS.items():
    @query(_name, edited_sql(_d, _why))
    def _(spark, d, fn=_fn):
        return fn(orders_plan(spark, d)).select(*K, "direction", "reason")


@query("plan_predicates", ORDERS_PLAN_SQL + """
select o_orderkey, d = 'conflict' as is_conflict, d = 'l2r' as is_ltr, d = 'r2l' as is_rtl, d = 'merge' as is_merge,
  false as is_props_only, ls = 'created' or rs = 'created' as is_created,
  ls = 'deleted' or rs = 'deleted' as is_deleted, ls = 'modified' or rs = 'modified' as is_modified from p""")
def _(spark, d):
    tests = [E.is_conflict, E.is_ltr, E.is_rtl, E.is_merge, E.is_props_only, E.is_created, E.is_deleted, E.is_modified]
    return orders_plan(spark, d).select(*K, *[t().alias(t.__name__) for t in tests])


@query("edit_count", ORDERS_PLAN_SQL + "select count(*) as n from p where d <> 'equal' and (ls = 'deleted' or rs = 'deleted')")
def _(spark, d):
    return E.edit_count(orders_plan(spark, d), E.is_deleted())


@query("edit_plan", ORDERS_PLAN_SQL + """
select p.o_orderkey, case when d <> 'equal' and o.o_orderpriority = '1-URGENT' then 'l2r' else d end as direction
from p join orders o on o.o_orderkey = p.o_orderkey""")
def _(spark, d):
    edits = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        *K, F.lit("l2r").alias("direction"))
    return E.edit_plan(orders_plan(spark, d), edits, K).select(*K, "direction")


# -- propagation --------------------------------------------------------------

def _synced(spark, d, cfg=ORDERS_JOB):
    base, left, right = order_snapshots(spark, d)
    return sync(left, right, base, cfg)


_NEW_LEFT = "select l.* from l where o_orderkey not in (select o_orderkey from p where d = 'r2l') " \
            "union all select r.* from r where o_orderkey in (select o_orderkey from p where d = 'r2l')"
_NEW_RIGHT = "select r.* from r where o_orderkey not in (select o_orderkey from p where d = 'l2r') " \
             "union all select l.* from l where o_orderkey in (select o_orderkey from p where d = 'l2r')"
_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_COLS = ", ".join(_ORDER_COLS)


@query("apply_left", ORDERS_PLAN_SQL + f"select {_COLS} from ({_NEW_LEFT})")
def _(spark, d):
    return _synced(spark, d).left.select(*_ORDER_COLS)


@query("apply_right", ORDERS_PLAN_SQL + f"select {_COLS} from ({_NEW_RIGHT})")
def _(spark, d):
    return _synced(spark, d).right.select(*_ORDER_COLS)


@query("next_base", ORDERS_PLAN_SQL + f""",
nl as ({_NEW_LEFT}), agreed as (select o_orderkey from p where d <> 'conflict')
select {_COLS} from b where o_orderkey not in (select o_orderkey from agreed)
union all select {_COLS} from nl where o_orderkey in (select o_orderkey from agreed)""")
def _(spark, d):
    return _synced(spark, d).base.select(*_ORDER_COLS)


@query("sync_results", ORDERS_PLAN_SQL + """
select o_orderkey, case when d = 'conflict' then 'skipped' else 'success' end as outcome,
  case when d = 'conflict' then 'Conflict: ' || why end as detail from p where d <> 'equal'""")
def _(spark, d):
    return _synced(spark, d).results.select(*K, "outcome", "detail")


@query("result_counts", ORDERS_PLAN_SQL + """
select case when d = 'conflict' then 'skipped' else 'success' end as outcome, count(*) as n
from p where d <> 'equal' group by 1""")
def _(spark, d):
    return A.result_counts(A.results(orders_plan(spark, d), K))


def _failures(spark, d):
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(*K, F.lit("disk full").alias("message"))


_BUDGET = """,
q as (select p.o_orderkey, d, why, d <> 'conflict' and o.o_orderpriority = '1-URGENT' as bad,
  row_number() over (order by case when d = 'conflict' then 0 else 1 end, p.o_orderkey) as rn
  from p join orders o on o.o_orderkey = p.o_orderkey where d <> 'equal'),
s as (select *, coalesce(sum(case when bad then 1 else 0 end) over (order by rn rows between unbounded preceding and 1 preceding), 0) as before from q)
"""


@query("error_budget", ORDERS_PLAN_SQL + _BUDGET + """
select o_orderkey, case when before > 5 then 'skipped' when d = 'conflict' then 'skipped' when bad then 'error' else 'success' end as outcome,
  case when before > 5 then 'Aborted: error limit reached' when d = 'conflict' then 'Conflict: ' || why when bad then 'disk full' end as detail
from s""")
def _(spark, d):
    done = A.results(orders_plan(spark, d), K, failures=_failures(spark, d))
    return A.error_budget(done, K, max_errors=5).select(*K, "outcome", "detail")


@query("results_with_failures", ORDERS_PLAN_SQL + _BUDGET + """
select case when d = 'conflict' then 'skipped' when bad then 'error' else 'success' end as outcome, count(*) as n from s group by 1""")
def _(spark, d):
    return A.result_counts(A.results(orders_plan(spark, d), K, failures=_failures(spark, d)))


@query("all_succeeded", ORDERS_PLAN_SQL + _BUDGET + "select not bool_or(bad) as ok from s")
def _(spark, d):
    return A.all_succeeded(A.results(orders_plan(spark, d), K, failures=_failures(spark, d)))


@query("force_restores", ORDERS_PLAN_SQL + """
select """ + _COLS + """ from l where o_orderkey in (select o_orderkey from p where d <> 'equal')
union all select """ + _COLS + """ from r where o_orderkey not in (select o_orderkey from p where d <> 'equal')""")
def _(spark, d):
    """Forced to the right: each planned key takes the left side's current row,
    also where only the right side had changed."""
    cfg = JobConfig(keys=tuple(K), plan=PlanConfig(force="left"))
    return _synced(spark, d, cfg).right.select(*_ORDER_COLS)


@query("force_skips", ORDERS_PLAN_SQL + """
select o_orderkey, case when ls = 'unchanged' then 'skipped' else 'success' end as outcome,
  case when ls = 'unchanged' then 'Unchanged' end as detail from p where d <> 'equal'""")
def _(spark, d):
    plan = R.force(orders_plan(spark, d), "left")
    return A.results(plan, K, ApplyConfig(force_mode="skip")).select(*K, "outcome", "detail")


@query("upsert_rows", "with " + LISTING3_SQL + """
select path, md5(text) as fp from l union all select path, md5(text) from b where path not in (select path from l)""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return A.upsert_rows(base, left, ["path"]).select("path", "fp")


@query("delete_rows", "with " + LISTING3_SQL + """
select path, md5(text) as fp from b where not regexp_matches(path, '^(en/src1|de)(/|$)')""")
def _(spark, d):
    base = with_directories(listing3(spark, d)[0])
    gone = base.where(F.col("path").isin("en/src1", "de")).select("path")
    out = A.delete_rows(base, gone, ["path"], subtree=True)
    return out.where(F.col("kind") == "file").select("path", "fp")


@query("props_only", "with " + LISTING3_SQL + """
select b.path, md5(b.text) as fp, case when l.path is null then 420 else 493 end as perms
from b left join l on l.path = b.path""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return A.props_only(base, left.withColumn("perms", F.lit(0o755)), ["path"]).select("path", "fp", "perms")


@query("replicas_equal", ORDERS_PLAN_SQL + f""",
nl as ({_NEW_LEFT}), nr as ({_NEW_RIGHT})
select (select count(*) from nl where o_orderkey not in (select o_orderkey from nr)) as only_left,
  (select count(*) from nr where o_orderkey not in (select o_orderkey from nl)) as only_right,
  (select count(*) from nl join nr using (o_orderkey) where nl.o_orderstatus <> nr.o_orderstatus) as different,
  false as equal""")
def _(spark, d):
    out = _synced(spark, d)
    return A.replicas_equal(out.left, out.right, K)


@query("sync_twice", ORDERS_PLAN_SQL + """
select ls as left_status, rs as right_status, d as direction, count(*) as n from p where d = 'conflict' group by 1, 2, 3""")
def _(spark, d):
    """After a cycle only the conflicts are left, and they are still conflicts."""
    out = _synced(spark, d)
    left, right, base = (materialize(t, "synced") for t in (out.left, out.right, out.base))
    plan = make_plan(left, right, base, ORDERS_JOB)
    return shown(plan, *K).groupBy("left_status", "right_status", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("sync_resolved", ORDERS_PLAN_SQL + """
select 0 as only_left, 0 as only_right, 0 as different, true as equal""")
def _(spark, d):
    """With a preferred side no conflict is left and the replicas agree."""
    out = _synced(spark, d, JobConfig(keys=tuple(K), plan=PlanConfig(prefer="left")))
    return A.replicas_equal(out.left, out.right, K)


@query("big_deletes", ORDERS_PLAN_SQL + """
select d as direction, count(*) as n_deleted from p
where (d = 'l2r' and ls = 'deleted') or (d = 'r2l' and rs = 'deleted') group by 1""")
def _(spark, d):
    return G.deletions(orders_plan(spark, d))


@query("max_size_in_plan", LISTING_PLAN_SQL + """,
q as (select *, case when d = 'l2r' then llen when d = 'r2l' then rlen else 0 end > 2048 as big from p)
select path, case when big then 'conflict' else d end as direction, case when big then 'larger than 2 KB'
  when d = 'conflict' then why end as reason from q""")
def _(spark, d):
    base, left, right = listing3(spark, d)
    return make_plan(left, right, base, JobConfig(max_size_kb=2)).select("path", "direction", "reason")


@query("plan_without_links", _MIXED_SQL + """
select path, case when n%17 = 0 and here then 'problem' else 'l2r' end as direction from k
where not ((here and n%11 = 0) or (before and n%11 = 0)) and (not here or not before or differs or kind <> prev_kind or n%17 = 0)""")
def _(spark, d):
    base, left = _mixed(spark, d)
    return make_plan(left, base, base, JobConfig(links=False)).select("path", "direction")


@query("guard_base_save", ORDERS_PLAN_SQL + """
select count(case when d in ('l2r','r2l') then 1 end) as ok, 0 as failed,
  count(case when d = 'conflict' then 1 end) as skipped, true as save_base from p where d <> 'equal'""")
def _(spark, d):
    return G.base_decision(A.results(orders_plan(spark, d), K))


# -- merges -------------------------------------------------------------------

_MERGED = "with " + CUSTOMER3_SQL + """,
j as (select b.c_custkey, b.c_acctbal as bb, l.c_acctbal as lb, r.c_acctbal as rb,
  b.c_mktsegment as bs, l.c_mktsegment as ls, r.c_mktsegment as rs
  from b join l using (c_custkey) join r using (c_custkey)),
m as (select c_custkey,
  case when rb = bb then lb when lb = bb then rb when lb = rb then lb end as c_acctbal,
  case when rs = bs then ls when ls = bs then rs when ls = rs then ls end as c_mktsegment,
  lb, rb, not (rb = bb or lb = bb or lb = rb) as bad from j)
"""


@query("three_way_merge", _MERGED + """
select c_custkey, c_acctbal, c_mktsegment, case when bad then 'c_acctbal' else '' end as conflicts, not bad as clean from m""")
def _(spark, d):
    base, left, right = customer3(spark, d)
    out = three_way_merge(base, left, right, ["c_custkey"], ["c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "c_acctbal", "c_mktsegment",
                      F.array_join("conflict_columns", ",").alias("conflicts"), "clean")


@query("merge_rules", _MERGED + """
select c_custkey, case when c_custkey%100 = 2 then lb when c_custkey%100 = 12 then rb else c_acctbal end as c_acctbal,
  case when c_custkey%100 = 2 then 'left' when c_custkey%100 = 12 then 'right' else 'column' end as strategy
from m""")
def _(spark, d):
    base, left, right = customer3(spark, d)
    rules = ("Regex (^|[0-9])02$ -> left", "Regex ^2$ -> left", "Regex 12$ -> right")
    out = three_way_merge(base, left, right, ["c_custkey"], ["c_acctbal", "c_mktsegment"], rules=rules)
    return out.select("c_custkey", "c_acctbal", "strategy")


@query("sync_with_merge", _MERGED + """
select m.c_custkey, case when m.bad then l.c_acctbal else m.c_acctbal end as c_acctbal,
  case when m.bad then l.c_mktsegment else m.c_mktsegment end as c_mktsegment
from m join l using (c_custkey)""")
def _(spark, d):
    """Merged rows reach both sides; rows with a column conflict stay."""
    base, left, right = (snapshot_table(t, ["c_custkey"]) for t in customer3(spark, d))
    cfg = JobConfig(keys=("c_custkey",), plan=PlanConfig(merge=("Regex .*",)))
    out = sync(left, right, base, cfg, merge_values=["c_acctbal", "c_mktsegment"])
    return out.left.select("c_custkey", "c_acctbal", "c_mktsegment")
