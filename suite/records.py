"""Backups, history, block deltas, change feeds, transfer statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.config import BackupConfig
from concordat.functions import blocks as BL
from concordat.functions import text as TX
from concordat.operators import backups as BK
from concordat.operators import delta as D
from concordat.operators import history as HI
from concordat.operators import propagate as A
from concordat.operators import stats as ST
from concordat.session import materialize, scratch_path
from concordat.streaming import changes as CH
from concordat.streaming.state import KeyedState, keyed_state
from suite.core import listing_plan
from suite.fixtures import LISTING_PLAN_SQL, listing3, listing3_text
from suite.registry import query, table
from suite.trees import doc_listing

# -- backups ------------------------------------------------------------------


def _copies(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("taken_at"),
                     "l_orderkey", "l_linenumber", "l_extendedprice", F.lit(0).alias("version"))


_TIES = ["l_orderkey", "l_linenumber", "l_extendedprice"]
_VERSIONS = """
v as (select l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate, row_number() over (partition by l_partkey
  order by l_shipdate desc, l_orderkey, l_linenumber, l_extendedprice) - 1 as version from lineitem)
"""


def _rotated(spark, d, n):
    return BK.rotate_backups(_copies(spark, d), ["l_partkey"], n, [F.col("taken_at").desc(), *map(F.col, _TIES)])


@query("rotate_backups", "with " + _VERSIONS + "select l_partkey, l_orderkey, l_linenumber, version from v where version < 3")
def _(spark, d):
    return _rotated(spark, d, 3).select("l_partkey", "l_orderkey", "l_linenumber", "version")


@query("latest_backup", "with " + _VERSIONS + "select l_partkey, l_orderkey, l_linenumber from v where version = 0")
def _(spark, d):
    return BK.latest_backup(_rotated(spark, d, 2)).select("l_partkey", "l_orderkey", "l_linenumber")


@query("restore_version", """
select l_partkey, max(l_shipdate)::varchar as taken_at, count(*) > 0 as found from lineitem
where l_shipdate <= timestamp '1996-06-30' group by 1""")
def _(spark, d):
    out = BK.restore_version(_copies(spark, d), ["l_partkey"], F.lit("1996-06-30").cast("timestamp"))
    return out.select("l_partkey", F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"),
                      F.col("l_orderkey").isNotNull().alias("found"))


@query("backup_name", """
select doc_id, '.concordat_backups/'||lang||'/'||source||'/.bak.'||doc_id||'.txt'||case when doc_id%3 > 0 then '.'||(doc_id%3) else '' end as central,
  lang||'/'||source||'/'||'~'||doc_id||'.txt.old'||case when doc_id%3 > 0 then '.'||(doc_id%3) else '' end as local from documents""")
def _(spark, d):
    v, p = F.col("doc_id") % 3, F.col("path")
    local = BackupConfig(location="local", prefix="~", suffix=".old")
    return doc_listing(spark, d).select("doc_id", BK.backup_name(p, v).alias("central"), BK.backup_name(p, v, local).alias("local"))


@query("stash_preimages", LISTING_PLAN_SQL + """
select b.path, md5(b.text) as old_fp from b join p on p.path = b.path
where d = 'l2r' and ls in ('modified','deleted') and b.path like 'en/%' and b.path not like 'en/src1/%'""")
def _(spark, d):
    base, _, right = listing3(spark, d)
    done = A.results(listing_plan(spark, d), ["path"])
    cfg = BackupConfig(backup=("BelowPath en",), backup_not=("BelowPath en/src1",))
    out = BK.stash_preimages(right, done, ["path"], "l2r", F.lit("2024-06-01").cast("timestamp"), "s1", cfg)
    return out.select("path", F.col("payload.fp").alias("old_fp"))


@query("conflict_copies", """
select lang||'/'||source||'/'||doc_id||'.txt' as path, lang||'/'||source||'/'||doc_id||' (conflict on 2024-06-01)'||
  case doc_id%4 when 0 then '' when 1 then '.1' when 2 then '.1' else '.2' end||'.txt' as copy from documents""")
def _(spark, d):
    """Remainder 0: no copy yet; 1: first taken; 2: first and third; 3: two taken."""
    doc = doc_listing(spark, d)
    m = F.col("doc_id") % 4
    numbers = (F.when(m == 1, F.array(F.lit(""))).when(m == 2, F.array(F.lit(""), F.lit(".2")))
               .when(m == 3, F.array(F.lit(""), F.lit(".1"))))
    stem = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    there = doc.select(stem.alias("stem"), F.explode(numbers).alias("n")).select(
        F.concat("stem", F.lit(" (conflict on 2024-06-01)"), "n", F.lit(".txt")).alias("path"))
    existing = doc.select("path").unionByName(there)
    return BK.conflict_copies(doc.select("path"), existing, F.lit("2024-06-01").cast("timestamp"))


# -- history ------------------------------------------------------------------

_ACTION = "case o_orderstatus when 'F' then 'modified' when 'O' then 'created' else 'deleted' end"


def _history(spark, d):
    """Customers as syncs, their orders as entries; fewer paths than entries."""
    o = table(spark, d, "orders")
    status = F.col("o_orderstatus")
    entries = o.select(F.col("o_custkey").cast("string").alias("sync_id"),
                       (F.col("o_orderkey") % 2000).cast("string").alias("path"),
                       F.when(status == "F", "modified").when(status == "O", "created").otherwise("deleted").alias("action"),
                       F.lit("r1to2").alias("direction"), F.col("o_totalprice").cast("long").alias("size"))
    n = lambda s: F.count(F.when(status == s, 1))
    records = o.groupBy(F.col("o_custkey").cast("string").alias("sync_id")).agg(
        F.max("o_orderdate").cast("timestamp").alias("ts"), n("F").alias("propagated"),
        n("O").alias("skipped"), n("P").alias("failed"))
    return records, entries


_RECORDS = """
rec as (select cast(o_custkey as varchar) as sync_id, max(o_orderdate) as ts, count(case when o_orderstatus = 'F' then 1 end) as propagated,
  count(case when o_orderstatus = 'O' then 1 end) as skipped, count(case when o_orderstatus = 'P' then 1 end) as failed, count(*) as n_files
  from orders group by 1),
ent as (select cast(o_custkey as varchar) as sync_id, cast(o_orderkey%2000 as varchar) as path, """ + _ACTION + """ as action from orders)
"""


@query("history_recent", "with " + _RECORDS + "select sync_id, propagated from rec order by ts desc, sync_id desc limit 25")
def _(spark, d):
    return HI.recent(_history(spark, d)[0], 25).select("sync_id", "propagated")


@query("file_history", "with " + _RECORDS + "select sync_id, action, strftime(ts, '%Y-%m-%d') as day from ent join rec using (sync_id) where path = '77'")
def _(spark, d):
    return HI.file_history(*_history(spark, d), "77").select("sync_id", "action", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("all_paths", "with " + _RECORDS + "select distinct path from ent")
def _(spark, d):
    return HI.all_paths(_history(spark, d)[1])


@query("prune_history", "with " + _RECORDS + "select sync_id, n_files from rec order by sync_id desc limit 100")
def _(spark, d):
    records, entries = _history(spark, d)
    kept = HI.prune_history(records)
    return HI.record_summary(kept, HI.prune_entries(entries, kept)).select("sync_id", "n_files")


@query("record_summary", "with " + _RECORDS + "select sync_id, propagated, skipped, failed, n_files from rec")
def _(spark, d):
    return HI.record_summary(*_history(spark, d))


@query("history_entries", LISTING_PLAN_SQL + """
select 's1' as sync_id, path, case when d = 'l2r' then ls else rs end as action,
  case when d = 'l2r' then 'upload' else 'download' end as direction, case when d = 'l2r' then llen else rlen end as size
from p where d in ('l2r','r2l')""")
def _(spark, d):
    return HI.history_entries(A.results(listing_plan(spark, d), ["path"]), ["path"], F.lit("s1"), "remote")


@query("history_record", LISTING_PLAN_SQL + """
select 's1' as sync_id, 'A' as "left", 'B' as "right", count(case when d in ('l2r','r2l') then 1 end) as propagated,
  count(case when d = 'conflict' then 1 end) as skipped, 0 as failed from p""")
def _(spark, d):
    done = A.results(listing_plan(spark, d), ["path"])
    out = HI.history_record(done, F.lit("s1"), F.lit("2024-06-01"), "A", "B")
    return out.select("sync_id", "left", "right", "propagated", "skipped", "failed")


# -- block deltas -------------------------------------------------------------

_BLOCK = """case when {0} <= 0 then 700 else cast(least(greatest(pow(2, round(ln(sqrt({0}))/ln(2))), 700), 131072) as integer) end"""
_DOC_BYTES = "docs as (select doc_id, encode(text) as content, octet_length(encode(text)) as n from documents)"


def _contents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


@query("block_size", "select l_orderkey, l_linenumber, l_partkey, " + _BLOCK.format("cast(l_extendedprice * l_partkey as bigint)") + " as block_size from lineitem")
def _(spark, d):
    n = F.floor(F.round(F.col("l_extendedprice") * F.col("l_partkey"), 0)).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", BL.block_size(n).alias("block_size"))


@query("checksum_size", """
select o_orderkey, case when o_orderkey = 0 or o_custkey = 0 then 2 else cast(least(greatest(ceil(
  (ln(ceil(o_orderkey * 1000.0 / 700) * ceil(o_custkey * 1000.0 / 700)) / ln(2) - 147) / 8), 2), 16) as integer) end as n from orders""")
def _(spark, d):
    src, dst = F.col("o_orderkey") * 1000, F.col("o_custkey") * 1000
    return table(spark, d, "orders").select("o_orderkey", BL.checksum_size(src, dst, F.lit(700)).alias("n"))


@query("block_signatures", "with " + _DOC_BYTES + ", s as (select *, " + _BLOCK.format("n") + """ as block_size from docs),
i as (select *, unnest(range(0, cast(ceil(n / block_size) as bigint))) as block_no from s where n > 0)
select doc_id, block_no, octet_length(array_slice(content, block_no * block_size + 1, (block_no + 1) * block_size)) as block_len,
  md5(array_slice(content, block_no * block_size + 1, (block_no + 1) * block_size)) as strong from i""")
def _(spark, d):
    return D.block_signatures(_contents(spark, d), "doc_id", weak=False).select("doc_id", "block_no", "block_len", "strong")


@query("shared_blocks", "with " + _DOC_BYTES + ", s as (select *, " + _BLOCK.format("n") + """ as block_size from docs),
i as (select *, unnest(range(0, cast(ceil(n / block_size) as bigint))) as block_no from s where n > 0),
h as (select doc_id, octet_length(array_slice(content, block_no * block_size + 1, (block_no + 1) * block_size)) as len,
  md5(array_slice(content, block_no * block_size + 1, (block_no + 1) * block_size)) as strong from i)
select strong, count(distinct doc_id) as n_values, count(*) as n_blocks, max(len) as block_len from h group by 1 having count(distinct doc_id) > 1""")
def _(spark, d):
    return D.shared_blocks(D.block_signatures(_contents(spark, d), "doc_id", weak=False), "doc_id")


@query("weak_hash", """
select doc_id, list_reduce(list_transform(range(1, octet_length(encode(text)) + 1), lambda i:
    cast(('0x' || hex(array_slice(encode(text), i, i))) as bigint)), lambda a, c: (a * 16381 + c) & 2147483647, cast(0 as bigint)) as weak
from documents""")
def _(spark, d):
    return _contents(spark, d).select("doc_id", BL.weak_hash("content").alias("weak"))


@query("rolling_weak", """
with c as (select item_id, list_transform(range(1, octet_length(encode(text)) + 1), lambda i:
    cast(('0x' || hex(array_slice(encode(text), i, i))) as bigint)) as c from benchmark)
select item_id, len(c) - 15 as n_windows, md5(array_to_string(list_transform(range(1, len(c) - 14), lambda o:
    list_reduce(c[o:o + 15], lambda a, x: (a * 16381 + x) & 2147483647, cast(0 as bigint))), ',')) as hashes from c where len(c) >= 16""")
def _(spark, d):
    """The checksums of all windows of 16 bytes."""
    w = BL.rolling_weak(F.encode("text", "UTF-8"), F.lit(16))
    b = table(spark, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 0)
    return b.select("item_id", F.size("w").alias("n_windows"),
                    F.md5(F.array_join(F.col("w").cast("array<string>"), ",")).alias("hashes"))


_INSERT = "<<INSERT>>"


def _docs2(spark, d, doc=None):
    """Old and new version of every document: a text inserted after character 800."""
    doc = table(spark, d, "documents") if doc is None else doc
    new = F.concat(F.substring("text", 1, 800), F.lit(_INSERT), F.expr("substring(text, 801)"))
    return (doc.select("doc_id", F.encode("text", "UTF-8").alias("content")), doc.select("doc_id", F.encode(new, "UTF-8").alias("content")))


def _tokens(spark, d, doc=None):
    old, new = _docs2(spark, d, doc)
    return old, new, materialize(D.delta_tokens(D.match_blocks(
        D.block_signatures(old, "doc_id"), new, "doc_id"), "doc_id"), "tokens")


#: The insertion shifts all that follows: the blocks before it and the whole
#: blocks after it are found again, what lies between is literal.
_SHIFTED = """, docs as (select doc_id, text, octet_length(encode(text)) as n from t),
k as (select docs.*, """ + _BLOCK.format("n") + """ as b, octet_length(encode(substring(text, 1, 800))) as q from docs),
z as (select doc_id, n, b, q // b as before, (q + b - 1) // b as resumed, n // b as whole from k)
"""


#: Texts without repetitions: each 32 characters are followed by their hash with their place.
_PLACED = """with t as (select doc_id, array_to_string(list_transform(range(0, (greatest(length(text), 1) + 31) // 32),
  lambda i: substring(text, i * 32 + 1, 32) || md5(i || ':' || substring(text, i * 32 + 1, 32))), '') as text from documents)"""


@query("delta_tokens", _PLACED + _SHIFTED + """
select doc_id, i as seq, 'block' as token, i as block_index, null as literal_len from z, unnest(range(0, before)) as u(i)
union all select doc_id, before, 'literal', null, case when whole > resumed then resumed * b + 10 else n + 10 end - before * b from z
union all select doc_id, before + 1 + i - resumed, 'block', i, null from z, unnest(range(resumed, whole)) as u(i)
union all select doc_id, before + 1 + whole - resumed, 'literal', null, n - whole * b from z where whole > resumed and n > whole * b""")
def _(spark, d):
    piece = "substring(text, i * 32 + 1, 32)"
    doc = table(spark, d, "documents").select("doc_id", F.expr(
        f"array_join(transform(sequence(0, (greatest(char_length(text), 1) - 1) div 32), i -> concat({piece}, md5(cast(concat(i, ':', {piece}) as binary)))), '')").alias("text"))
    _, _, tokens = _tokens(spark, d, materialize(doc, "placed"))
    return tokens.select("doc_id", "seq", "token", "block_index", F.octet_length("literal").alias("literal_len"))


@query("delta_roundtrip", """
select doc_id, md5(concat(substring(text, 1, 800), '<<INSERT>>', substring(text, 801))) as fp, true as ok from documents""")
def _(spark, d):
    old, new, tokens = _tokens(spark, d)
    rebuilt = D.apply_delta(old, tokens, "doc_id").select("doc_id", F.col("content").alias("got"))
    return new.join(rebuilt, "doc_id", "left").select(
        "doc_id", F.md5("got").alias("fp"), (F.md5("got") == F.md5("content")).alias("ok"))


@query("delta_stats", "with t as (select doc_id, text from documents)" + _SHIFTED + """
select doc_id, n + 10 as new_bytes, before + greatest(0, whole - resumed) as n_blocks,
  n + 10 - (before + greatest(0, whole - resumed)) * b as literal_bytes from z""")
def _(spark, d):
    """How much of each text an insertion leaves to be sent."""
    _, new, tokens = _tokens(spark, d)
    s = D.delta_stats(tokens, "doc_id")
    return new.join(s, "doc_id", "left").select("doc_id", F.octet_length("content").alias("new_bytes"), "n_blocks", "literal_bytes")


@query("match_blocks_appended", "with " + _DOC_BYTES + ", s as (select *, " + _BLOCK.format("n") + """ as block_size from docs)
select doc_id, case when n >= 700 - 4 then n // block_size else 0 end as n_blocks,
  n + 4 - case when n >= 700 - 4 then n // block_size else 0 end * block_size as literal_bytes from s""")
def _(spark, d):
    """Appending four bytes keeps every whole block of the old value."""
    old = _contents(spark, d)
    new = old.select("doc_id", F.concat("content", F.lit(b"tail")).alias("content"))
    m = D.match_blocks(D.block_signatures(old, "doc_id"), new, "doc_id")
    return D.delta_stats(D.delta_tokens(m, "doc_id"), "doc_id").select("doc_id", "n_blocks", "literal_bytes")


@query("delta_candidates", LISTING_PLAN_SQL + """
select path, d as direction, case when d = 'l2r' then llen else rlen end as size from p
where (d = 'l2r' and ls = 'modified' and llen > 300) or (d = 'r2l' and rs = 'modified' and rlen > 300)""")
def _(spark, d):
    from concordat.operators.propagate import source_bytes
    return D.delta_candidates(listing_plan(spark, d), 300).select("path", "direction", source_bytes().alias("size"))


# -- change feeds -------------------------------------------------------------

_EV = """
ev as (select event_type||'/'||user_id as path, user_id, ts, value, event_id,
  case event_type when 'signup' then 'created' when 'view' then 'modified' when 'click' then 'modified'
    when 'error' then 'deleted' else 'moved' end as action from events)
"""


def change_events(df):
    t = F.col("event_type")
    action = (F.when(t == "signup", "created").when(t.isin("view", "click"), "modified")
              .when(t == "error", "deleted").otherwise("moved"))
    return df.select(F.concat_ws("/", t, F.col("user_id").cast("string")).alias("path"), action.alias("action"),
                     F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "value")


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return CH.change_stream(spark, d, schema, "events.parquet")


def _drain(spark, df, name, mode="append"):
    """Run a stream over what is there and return what it wrote."""
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("change_stream", "with " + _EV + "select event_id, path, action from ev")
def _(spark, d):
    return _drain(spark, change_events(_stream(spark, d)).select("event_id", "path", "action"), "events")


@query("relative_and_ignore", "with " + _EV + "select event_id, path from ev where not regexp_matches(path, '^view/') and user_id%3 <> 0")
def _(spark, d):
    """Every third user lies outside the root."""
    ev = change_events(_stream(spark, d))
    root = F.when(F.col("user_id") % 3 == 0, "/other/").otherwise("/data/root/")
    full = ev.withColumn("path", F.concat(root, "path"))
    kept = CH.relative_and_ignore(full, "/data/root", ["Path view/*"])
    return _drain(spark, kept.select("event_id", "path"), "kept")


@query("dual_stream", "with " + _EV + """
select case when user_id%2 = 0 then 1 else 2 end as replica, action, count(*) as n from ev group by 1, 2""")
def _(spark, d):
    ev = change_events(_stream(spark, d))
    both = CH.dual_stream(ev.where(F.col("user_id") % 2 == 0), ev.where(F.col("user_id") % 2 == 1))
    return _drain(spark, both.select("replica", "action", "event_id"), "dual").groupBy("replica", "action").agg(F.count(F.lit(1)).alias("n"))


_SESSIONS = """
g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as o from ev),
s as (select *, sum(o) over (partition by user_id order by ts, event_id) as batch from g),
w as (select user_id, batch, min(ts) as lo, max(ts) as hi, count(*) as n_events from s group by 1, 2)
"""


@query("debounce_bounds", "with " + _EV + "," + _SESSIONS + """
select user_id, epoch_us(lo) as lo, epoch_us(hi) + 1800000000 as hi, n_events from w""")
def _(spark, d):
    ev = change_events(table(spark, d, "events"))
    out = CH.batch_bounds(ev, 1800, ["user_id"])
    return out.select("user_id", F.unix_micros("batch_start").alias("lo"), F.unix_micros("batch_end").alias("hi"), "n_events")


@query("debounce_batch", "with " + _EV + "," + _SESSIONS + """
select s.user_id, epoch_us(w.lo) as lo, s.path, count(*) as n_events from s join w on w.user_id = s.user_id and w.batch = s.batch group by 1, 2, 3""")
def _(spark, d):
    ev = change_events(table(spark, d, "events"))
    out = CH.debounce_batch(ev, 1800, ["user_id"])
    return out.select("user_id", F.unix_micros("batch_start").alias("lo"), "path", "n_events")


def _debounced(spark, d):
    ev = change_events(_stream(spark, d))
    return _drain(spark, CH.debounce(ev, "30 minutes", "1 hour", ["user_id"]), "sessions")


@query("debounce_stream", "with " + _EV + "," + _SESSIONS + """
, wm as (select max(ts) - interval 1 hour as t from ev)
select user_id, epoch_us(lo) as lo, epoch_us(hi) + 1800000000 as hi, n_events from w, wm where hi + interval 30 minute <= wm.t""")
def _(spark, d):
    """Append mode: batches that the watermark has passed."""
    return _debounced(spark, d).select("user_id", F.unix_micros("batch_start").alias("lo"),
                                       F.unix_micros("batch_end").alias("hi"), "n_events")


@query("debounce_paths_stream", "with " + _EV + "," + _SESSIONS + """
, wm as (select max(ts) - interval 1 hour as t from ev)
select s.user_id, epoch_us(w.lo) as lo, s.path, count(*) as n_events from s join w on w.user_id = s.user_id and w.batch = s.batch, wm
where w.hi + interval 30 minute <= wm.t group by 1, 2, 3""")
def _(spark, d):
    """Closed batches with the paths that they touched, as a stream writes them."""
    feed = lambda: change_events(table(spark, d, "events"))
    out = scratch_path(spark, "paths")
    CH.debounced_paths(change_events(_stream(spark, d)), feed, 1800, "1 hour", out, scratch_path(spark, "paths-ck"), ["user_id"]).awaitTermination()
    found = spark.read.schema("user_id long, batch_start timestamp, path string, n_events long").parquet(out)
    return found.select("user_id", F.unix_micros("batch_start").alias("lo"), "path", "n_events")


@query("late_events", "with " + _EV + """,
half as (select min(ts) + (max(ts) - min(ts)) / 2 as t, max(ts) - interval 1 hour as wm from ev),
kept as (select ev.* from ev, half where ts >= half.t),
g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as o from kept),
s as (select *, sum(o) over (partition by user_id order by ts, event_id) as batch from g),
w as (select user_id, batch, min(ts) as lo, max(ts) as hi, count(*) as n_events from s group by 1, 2)
select user_id, epoch_us(lo) as lo, epoch_us(hi) + 1800000000 as hi, n_events from w, half where hi + interval 30 minute <= half.wm""")
def _(spark, d):
    """The earlier half of the events arrives last, behind the watermark, and is
    left out. (A micro-batch judges lateness by the watermark of the one
    before, so the last event comes in between.)"""
    ev = change_events(table(spark, d, "events"))
    us = F.unix_micros("ts")
    half, last = ev.agg(F.min(us) + (F.max(us) - F.min(us)) / 2, F.max(us)).first()
    half, last = half or 0, last or 0
    folder = scratch_path(spark, "late")
    for part in (ev.where((us >= half) & (us < last)), ev.where(us == last), ev.where(us < half)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = CH.change_stream(spark, folder, ev.schema, files_per_trigger=1)
    out = _drain(spark, CH.debounce(stream, "30 minutes", "1 hour", ["user_id"]), "late-out")
    return out.select("user_id", F.unix_micros("batch_start").alias("lo"), F.unix_micros("batch_end").alias("hi"), "n_events")


@query("flush_on_stop", "with " + _EV + "," + _SESSIONS + """
select user_id, epoch_us(lo) as lo, n_events from w""")
def _(spark, d):
    """What the stream emitted plus the flushed rest is everything."""
    ev = change_events(table(spark, d, "events"))
    emitted = _debounced(spark, d)
    rest = CH.flush_on_stop(ev, emitted, 1800, ["user_id"]).groupBy("user_id", "batch_start").agg(F.sum("n_events").alias("n_events"))
    return emitted.select("user_id", "batch_start", "n_events").unionByName(rest).select(
        "user_id", F.unix_micros("batch_start").alias("lo"), "n_events")


@query("last_state_per_key", "with " + _EV + """
select path, arg_max(value, (ts, event_id)) as value, arg_max(event_id, (ts, event_id)) as event_id from ev group by 1
having arg_max(action, (ts, event_id)) <> 'deleted'""")
def _(spark, d):
    ev = change_events(table(spark, d, "events")).select("path", "ts", "event_id", "action", "value")
    return CH.live_state(CH.last_state_per_key(ev, ["path"])).select("path", "value", "event_id")


@query("last_state_stream", "with " + _EV + """
select path, arg_max(value, (ts, event_id)) as value from ev group by 1 having arg_max(action, (ts, event_id)) <> 'deleted'""")
def _(spark, d):
    ev = change_events(_stream(spark, d)).select("path", "ts", "event_id", "action", "value")
    out = scratch_path(spark, "state")
    CH.state_stream(ev, ["path"], out, scratch_path(spark, "state-ck")).awaitTermination()
    return CH.read_state(spark, out, ["path"]).select("path", "value")


@query("state_with_expiry", "with " + _EV + """,
half as (select min(ts) + (max(ts) - min(ts)) / 2 as t, max(ts) - interval 1 hour as wm from ev),
kept as (select ev.* from ev, half where ts >= half.t or ts >= half.wm)
select path, arg_max(value, (ts, event_id)) as value, arg_max(event_id, (ts, event_id)) as event_id from kept group by 1
having arg_max(action, (ts, event_id)) <> 'deleted'""")
def _(spark, d):
    """State of a feed whose earlier half arrives last, too late to count."""
    ev = change_events(table(spark, d, "events")).select("path", "ts", "event_id", "action", "value")
    us = F.unix_micros("ts")
    half, last = ev.agg(F.min(us) + (F.max(us) - F.min(us)) / 2, F.max(us)).first()
    half, last = half or 0, last or 0
    folder = scratch_path(spark, "feed")
    quarter = half + (last - half) / 2
    for part in (ev.where((us >= half) & (us < quarter)), ev.where(us >= quarter), ev.where(us < half)):
        part.coalesce(1).write.mode("append").parquet(folder)
    state = KeyedState(spark, scratch_path(spark, "keyed"), ev.schema, ["path"], 3600)
    stream = CH.change_stream(spark, folder, ev.schema, files_per_trigger=1)
    keyed_state(stream, state, scratch_path(spark, "keyed-ck")).awaitTermination()
    return state.read().select("path", "value", "event_id")


# -- statistics ---------------------------------------------------------------

_LOG = """
lg as (select user_id as run_id, ts, event_id as seq, cast(round(value * 1000) as bigint) as bytes, event_type = 'purchase' as item_done from events),
t as (select *, sum(bytes) over w as done_bytes, count(case when item_done then 1 end) over w as done_items,
  sum(bytes) over (partition by run_id) as total_bytes, count(case when item_done then 1 end) over (partition by run_id) as total_items,
  min(ts) over (partition by run_id) as started from lg window w as (partition by run_id order by ts, seq rows unbounded preceding))
"""


def transfer_log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                    F.round(F.col("value") * 1000).cast("long").alias("bytes"), (F.col("event_type") == "purchase").alias("item_done"))


@query("progress", "with " + _LOG + """
select seq, cast(done_bytes as bigint) as done_bytes, done_items, round(case when total_bytes = 0 then case when total_items = 0 then 1 else done_items / total_items end
  else done_bytes / total_bytes end, 6) as progress from t""")
def _(spark, d):
    t = ST.with_totals(transfer_log(spark, d))
    share = ST.progress(F.col("done_bytes"), F.col("total_bytes"), F.col("done_items"), F.col("total_items"))
    return t.select("seq", "done_bytes", "done_items", F.round(share, 6).alias("progress"))


@query("progress_split_runs", "with " + _LOG + "select seq, cast(done_bytes as bigint) as done_bytes, done_items from t")
def _(spark, d):
    """The same running totals with every run cut into pieces."""
    return ST.with_totals(transfer_log(spark, d)).select("seq", "done_bytes", "done_items")


_RATED = "with recursive " + _LOG + """,
m as (select *, epoch_us(ts) // 1000 as ms from t),
smp as (select run_id, min(ms) as ms, 0 as k from m group by 1
  union all select s.run_id, min(m.ms), any_value(s.k) + 1 from smp s join m on m.run_id = s.run_id and m.ms >= s.ms + 500 group by s.run_id, s.k),
sk as (select s.run_id, s.ms, s.k, arg_min(m.seq, (m.ts, m.seq)) as seq, arg_min(m.done_bytes, (m.ts, m.seq)) as b
  from smp s join m on m.run_id = s.run_id and m.ms = s.ms where s.k > 0 group by 1, 2, 3),
nk as (select m.*, coalesce(count(sk.seq) over (partition by m.run_id order by m.ts, m.seq rows unbounded preceding), 0) as n
  from m left join sk on sk.run_id = m.run_id and sk.seq = m.seq),
rt as (select nk.*, case when n < 2 then case when nk.ms > epoch_us(started) // 1000 then cast(done_bytes as double) / (cast(nk.ms - epoch_us(started) // 1000 as double) / cast(1000 as double)) else 0 end
    when l.ms <= f.ms then 0 else cast(l.b - f.b as double) / (cast(l.ms - f.ms as double) / cast(1000 as double)) end as rate
  from nk left join sk l on l.run_id = nk.run_id and l.k = n left join sk f on f.run_id = nk.run_id and f.k = greatest(n - 19, 1))
"""


@query("rolling_rate", _RATED + "select seq, n as n_samples, round(cast(rate as double), 3) as rate from rt")
def _(spark, d):
    return ST.rolling_rate(transfer_log(spark, d)).select("seq", "n_samples", F.round("rate", 3).alias("rate"))


@query("eta", _RATED + """
select seq, case when rate <= 0 then null when total_bytes <= done_bytes then 0 else cast(ceil(cast(total_bytes - done_bytes as double) / cast(rate as double)) as bigint) end as eta from rt""")
def _(spark, d):
    r = ST.rolling_rate(transfer_log(spark, d))
    return r.select("seq", ST.eta_seconds(F.col("rate"), F.col("done_bytes"), F.col("total_bytes")).alias("eta"))


_FIX1 = "cast(cast({0} as decimal(38,1)) as varchar)"


@query("format_bytes", "select o_orderkey, case when n < 1024 then n||' B' when n < 1048576 then " + _FIX1.format("n/1024") + "||' KB' when n < 1073741824 then "
       + _FIX1.format("n/1048576") + "||' MB' else " + _FIX1.format("n/1073741824") + """||' GB' end as text
from (select o_orderkey, cast(o_orderkey as bigint) * o_orderkey * o_custkey as n from orders)""")
def _(spark, d):
    key = F.col("o_orderkey").cast("decimal(20,0)")  # large keys: the product leaves 64 bits
    n = key * key * F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", TX.format_bytes(n).alias("text"))


@query("format_rate_eta_items", """
select o_orderkey, case when o_custkey%5 = 0 then '--:--' when n >= 3600 then (n // 3600)||'h '||(n % 3600 // 60)||'m' when n >= 60 then (n // 60)||'m '||(n % 60)||'s'
    else n||'s' end as eta, o_custkey||' / '||o_orderkey||' items' as items,
  case when n * 37 < 1024 then (n * 37)||' B/s' when n * 37 < 1048576 then """ + _FIX1.format("n*37/1024") + "||' KB/s' else " + _FIX1.format("n*37/1048576") + """||' MB/s' end as rate
from (select *, cast(o_orderkey as bigint) * 3 as n from orders)""")
def _(spark, d):
    n = F.col("o_orderkey") * 3
    secs = F.when(F.col("o_custkey") % 5 != 0, n)
    return table(spark, d, "orders").select(
        "o_orderkey", TX.format_eta(secs).alias("eta"), TX.items_text(F.col("o_custkey"), F.col("o_orderkey")).alias("items"),
        TX.format_rate(n * 37).alias("rate"))
