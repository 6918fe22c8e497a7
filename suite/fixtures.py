"""Three-snapshot inputs derived from the whole test tables.

A base, and two replicas in which some rows were edited, created or deleted.
Each comes as DataFrames and as SQL common table expressions ``b``, ``l``,
``r``. The remainders below only say which rows were edited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import paths as P
from concordat.operators.snapshots import snapshot_table
from suite.registry import table

ORDER_KEYS = ["o_orderkey"]


def orders3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    m = k % 100

    def edited(lo: int, hi: int, mark: str) -> F.Column:
        return (F.when(m.between(lo, hi), mark).when(m.isin(20, 21), "Z")
                .otherwise(F.col("o_orderstatus")))

    base = o.where(m != 7)
    left = (o.where(~m.isin(15, 30, 40) & ((m != 7) | (k % 200 == 7)))
            .withColumn("o_orderstatus", edited(10, 13, "X")))
    right = o.where(~m.isin(31, 40)).withColumn("o_orderstatus", edited(12, 15, "Y"))
    return base, left, right


ORDERS3_SQL = """
b as (select * from orders where o_orderkey%100 <> 7),
l as (select o_orderkey, o_custkey,
        case when o_orderkey%100 between 10 and 13 then 'X'
             when o_orderkey%100 in (20,21) then 'Z' else o_orderstatus end as o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority
      from orders where o_orderkey%100 not in (15,30,40)
        and (o_orderkey%100 <> 7 or o_orderkey%200 = 7)),
r as (select o_orderkey, o_custkey,
        case when o_orderkey%100 between 12 and 15 then 'Y'
             when o_orderkey%100 in (20,21) then 'Z' else o_orderstatus end as o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority
      from orders where o_orderkey%100 not in (31,40))
"""

ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def order_snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(snapshot_table(t, ORDER_KEYS, ORDER_VALUES) for t in orders3(spark, d))


#: Same, with the order date as modification time, moved on the right.
def dated_order_snapshots(spark: SparkSession, d: str):
    base, left, right = orders3(spark, d)
    shift = F.make_interval(days=(F.col("o_orderkey") % 3 - 1).cast("int"))
    moved = right.withColumn("t", F.col("o_orderdate").cast("timestamp") + shift)
    values = [c for c in ORDER_VALUES if c != "o_orderdate"]
    return (snapshot_table(base, ORDER_KEYS, values, "o_orderdate"),
            snapshot_table(left, ORDER_KEYS, values, "o_orderdate"),
            snapshot_table(moved, ORDER_KEYS, values, "t"))


#: Status and row text per side, pairing and directions, in SQL.
ORDERS_PLAN_SQL = "with " + ORDERS3_SQL + """,
lu as (select * from (
  select coalesce(l.o_orderkey, b.o_orderkey) as k,
    case when l.o_orderkey is null then 'deleted' when b.o_orderkey is null then 'created'
         when (l.o_custkey, l.o_orderstatus, l.o_totalprice, l.o_orderdate, l.o_orderpriority)
            is distinct from (b.o_custkey, b.o_orderstatus, b.o_totalprice, b.o_orderdate, b.o_orderpriority)
         then 'modified' else 'unchanged' end as st,
    (l.o_custkey, l.o_orderstatus, l.o_totalprice, l.o_orderdate, l.o_orderpriority) as v,
    l.o_orderdate as t
  from l full join b on l.o_orderkey = b.o_orderkey) where st <> 'unchanged'),
ru as (select * from (
  select coalesce(r.o_orderkey, b.o_orderkey) as k,
    case when r.o_orderkey is null then 'deleted' when b.o_orderkey is null then 'created'
         when (r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority)
            is distinct from (b.o_custkey, b.o_orderstatus, b.o_totalprice, b.o_orderdate, b.o_orderpriority)
         then 'modified' else 'unchanged' end as st,
    (r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority) as v,
    r.o_orderdate + to_days(cast(r.o_orderkey%3 - 1 as integer)) as t
  from r full join b on r.o_orderkey = b.o_orderkey) where st <> 'unchanged'),
p0 as (
  select coalesce(lu.k, ru.k) as o_orderkey, coalesce(lu.st, 'unchanged') as ls,
    coalesce(ru.st, 'unchanged') as rs, lu.v as lv, ru.v as rv, lu.t as lt, ru.t as rt
  from lu full join ru on lu.k = ru.k),
p as (
  select *, case when rs = 'unchanged' then 'l2r' when ls = 'unchanged' then 'r2l'
    when ls = 'deleted' and rs = 'deleted' then 'equal'
    when ls <> 'deleted' and rs <> 'deleted' and lv = rv then 'equal'
    else 'conflict' end as d,
    case when (ls = 'deleted') <> (rs = 'deleted') then 'deleted on one side, modified on other'
      else 'file changed on both sides' end as why
  from p0)
"""


def _doc_path(folder: F.Column) -> F.Column:
    return F.concat_ws("/", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def listing3_text(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, text, mtime) of the three listings."""
    doc = table(spark, d, "documents")
    m = F.col("doc_id") % 50
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    mtime = (t0 + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("mtime")
    home, text = _doc_path(F.col("source")), F.col("text")
    exclaimed = F.concat(text, F.lit("!"))
    base = doc.where(m != 3).select(home.alias("path"), "text", mtime)
    left = doc.where(m != 9).select(
        F.when(m == 5, _doc_path(F.lit("moved"))).otherwise(home).alias("path"),
        F.when(m.isin(6, 8), exclaimed).otherwise(text).alias("text"), mtime)
    right = doc.where(~m.isin(3, 7)).select(
        home.alias("path"),
        F.when(m == 6, F.concat(text, F.lit("?"))).when(m == 8, exclaimed).otherwise(text).alias("text"),
        mtime)
    return base, left, right


def as_listing(texts: DataFrame) -> DataFrame:
    return texts.select(
        "path", F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("length"),
        "mtime", F.lit(0o644).alias("perms"), F.md5("text").alias("fp"))


def listing3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(as_listing(t) for t in listing3_text(spark, d))


def with_directories(listing: DataFrame) -> DataFrame:
    """Add a row per directory on the way to the files."""
    above = F.explode(P.ancestors(P.parent(F.col("path"))))
    dirs = listing.select(above.alias("path")).distinct().select(
        "path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("length"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"), F.lit(0o755).alias("perms"),
        F.lit(None).cast("string").alias("fp"))
    return listing.unionByName(dirs)


LISTING3_SQL = """
b as (select concat(lang,'/',source,'/',cast(doc_id as varchar),'.txt') as path, text, doc_id as mt
      from documents where doc_id%50 <> 3),
l as (select case when doc_id%50 = 5 then concat(lang,'/moved/',cast(doc_id as varchar),'.txt')
        else concat(lang,'/',source,'/',cast(doc_id as varchar),'.txt') end as path,
        case when doc_id%50 in (6,8) then concat(text,'!') else text end as text, doc_id as mt
      from documents where doc_id%50 <> 9),
r as (select concat(lang,'/',source,'/',cast(doc_id as varchar),'.txt') as path,
        case when doc_id%50 = 6 then concat(text,'?') when doc_id%50 = 8 then concat(text,'!')
          else text end as text, doc_id as mt
      from documents where doc_id%50 not in (3,7))
"""

LISTING_PLAN_SQL = "with " + LISTING3_SQL + """,
lu as (select * from (
  select coalesce(l.path, b.path) as path, case when l.path is null then 'deleted'
    when b.path is null then 'created' when l.text <> b.text then 'modified' else 'unchanged' end as st,
    l.text as text, b.text as old, octet_length(encode(l.text)) as len, l.mt as mt
  from l full join b on l.path = b.path) where st <> 'unchanged'),
ru as (select * from (
  select coalesce(r.path, b.path) as path, case when r.path is null then 'deleted'
    when b.path is null then 'created' when r.text <> b.text then 'modified' else 'unchanged' end as st,
    r.text as text, b.text as old, octet_length(encode(r.text)) as len, r.mt as mt
  from r full join b on r.path = b.path) where st <> 'unchanged'),
p0 as (
  select coalesce(lu.path, ru.path) as path, coalesce(lu.st, 'unchanged') as ls,
    coalesce(ru.st, 'unchanged') as rs, lu.text as ltext, ru.text as rtext, lu.old as lold, ru.old as rold,
    coalesce(lu.len, 0) as llen, coalesce(ru.len, 0) as rlen, lu.mt as lmt, ru.mt as rmt
  from lu full join ru on lu.path = ru.path),
p as (
  select *, case when rs = 'unchanged' then 'l2r' when ls = 'unchanged' then 'r2l'
    when ls = 'deleted' and rs = 'deleted' then 'equal'
    when ls <> 'deleted' and rs <> 'deleted' and ltext = rtext then 'equal'
    else 'conflict' end as d,
    case when (ls = 'deleted') <> (rs = 'deleted') then 'deleted on one side, modified on other'
      else 'file changed on both sides' end as why
  from p0)
"""


def customer3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    m = F.col("c_custkey") % 10
    bal = F.col("c_acctbal")
    left = c.withColumn("c_acctbal", F.when(m.isin(1, 2, 3), bal + 100).otherwise(bal))
    right = (c.withColumn("c_mktsegment", F.when(m == 1, "MERGED").otherwise(F.col("c_mktsegment")))
             .withColumn("c_acctbal", F.when(m == 2, bal + 200).when(m == 3, bal + 100).otherwise(bal)))
    return c, left, right


CUSTOMER3_SQL = """
b as (select * from customer),
l as (select c_custkey, c_name, c_nationkey,
        case when c_custkey%10 in (1,2,3) then c_acctbal + 100 else c_acctbal end as c_acctbal, c_mktsegment
      from customer),
r as (select c_custkey, c_name, c_nationkey,
        case when c_custkey%10 = 2 then c_acctbal + 200 when c_custkey%10 = 3 then c_acctbal + 100
          else c_acctbal end as c_acctbal,
        case when c_custkey%10 = 1 then 'MERGED' else c_mktsegment end as c_mktsegment
      from customer)
"""
