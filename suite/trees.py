"""Paths, patterns, filters, roll-ups, moves, fingerprints, remote listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.config import JobConfig, UpdateConfig
from concordat.functions import fingerprints as FP
from concordat.functions import paths as P
from concordat.functions import patterns as M
from concordat.operators import listings as L
from concordat.operators import moves as H
from concordat.operators import snapshots as SN
from concordat.operators import updates as U
from concordat.operators import views as V
from concordat.plans import remote as RM
from concordat.plans.cycle import make_plan
from concordat.session import materialize, scratch_path
from concordat.sources.remote import remote_listing
from concordat.sources.stores import base_id_column
from concordat.sources.trees import hash_suspects, scan_tree
from suite.core import listing_plan
from suite.fixtures import LISTING3_SQL, LISTING_PLAN_SQL, as_listing, listing3, with_directories
from suite.registry import query, table

_DOCS = """
docs as (select *, concat(lang,'/',source,'/',cast(doc_id as varchar),'.txt') as path from documents)
"""


def doc_listing(spark, d):
    doc = table(spark, d, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return doc.select(path.alias("path"), "doc_id", "text", "lang", "source")


_PARTS = """
parts as (select 'lang='||coalesce(nullif(lang,''),'__HIVE_DEFAULT_PARTITION__') as l, 'source='||coalesce(nullif(source,''),'__HIVE_DEFAULT_PARTITION__') as s,
  coalesce(cast(doc_id as varchar),'') as line from documents)"""


def _tree_of_documents(spark, d):
    """Folder of text files, one directory per lang and source, with the ids."""
    folder = scratch_path(spark, "tree")
    (table(spark, d, "documents").select("lang", "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("line"))
     .write.partitionBy("lang", "source").text(folder))
    return folder


@query("scan_tree", "with " + _PARTS + """
select l as path, 0 as n_bytes from parts group by 1
union all select l||'/'||s, sum(strlen(line) + 1) from parts group by 1""")
def _(spark, d):
    """Directories of a tree on disk with the bytes of the visible files in each."""
    found = scan_tree(spark, _tree_of_documents(spark, d)).where("error is null")
    seen = found.where(~P.name(F.col("path")).rlike("^[._]"))
    held = (seen.where("kind = 'file'").groupBy(P.parent(F.col("path")).alias("path"))
            .agg(F.sum("length").alias("n_bytes")))
    return (seen.where("kind = 'directory'").select("path").join(held, "path", "left")
            .select("path", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")))


@query("scan_and_hash", "with " + _PARTS + """
select count(distinct l) + count(distinct l||'/'||s) as n_directories, sum(strlen(line) + 1) as n_bytes, 0 as n_errors, true as all_hashed from parts""")
def _(spark, d):
    """A tree on disk, listed and read: every file has a fingerprint."""
    folder = _tree_of_documents(spark, d)
    found = scan_tree(spark, folder)
    done = hash_suspects(found.withColumns({"fp": F.lit(None).cast("string"), "suspect": F.col("kind") == "file"}), folder)
    seen = ~P.name(F.col("path")).rlike("^[._]")
    return done.where(seen).agg(
        F.count(F.when(F.col("kind") == "directory", 1)).alias("n_directories"), F.sum(F.when(F.col("kind") == "file", F.col("length"))).alias("n_bytes"),
        F.count("error").alias("n_errors"), F.bool_and((F.col("kind") != "file") | (F.length("fp") == 32)).alias("all_hashed"))


# -- paths --------------------------------------------------------------------

_RAW = """
raw as (select doc_id, case doc_id%9 when 0 then lang||'\\'||source||'\\x.txt' when 1 then lang||'/'||source||'//'
  when 2 then '/'||lang when 3 then 'c:'||lang when 4 then lang||'/./x' when 5 then lang||'/../x'
  when 6 then lang||'//'||source when 7 then '' else lang||'/'||source||'/..x/.hidden' end as raw from documents)
"""


def _raw_paths(spark, d):
    lang, source, m = F.col("lang"), F.col("source"), F.col("doc_id") % 9
    raw = (F.when(m == 0, F.concat(lang, F.lit("\\"), source, F.lit("\\x.txt")))
           .when(m == 1, F.concat(lang, F.lit("/"), source, F.lit("//")))
           .when(m == 2, F.concat(F.lit("/"), lang)).when(m == 3, F.concat(F.lit("c:"), lang))
           .when(m == 4, F.concat(lang, F.lit("/./x"))).when(m == 5, F.concat(lang, F.lit("/../x")))
           .when(m == 6, F.concat(lang, F.lit("//"), source)).when(m == 7, "")
           .otherwise(F.concat(lang, F.lit("/"), source, F.lit("/..x/.hidden"))))
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query("normalize_path", "with " + _RAW + """
select doc_id, case when doc_id%9 in (2,3,4,5,6) then null else rtrim(replace(raw, '\\', '/'), '/') end as path,
  case doc_id%9 when 2 then 'path must be relative' when 3 then 'path must be relative'
    when 4 then 'path must not contain ''.'' or ''..''' when 5 then 'path must not contain ''.'' or ''..'''
    when 6 then 'path must not contain empty components' end as error from raw""")
def _(spark, d):
    return _raw_paths(spark, d).select("doc_id", P.normalize_path(F.col("raw")).alias("path"),
                                       P.path_error(F.col("raw")).alias("error"))


@query("path_columns", "with " + _DOCS + """
select path, array_to_string(string_split(path,'/'), '|') as segments, 3 as depth, lang||'/'||source as parent,
  cast(doc_id as varchar)||'.txt' as name, path as path_key, cast(null as varchar) as error from docs""")
def _(spark, d):
    out = P.with_path_columns(doc_listing(spark, d).select("path"))
    return out.withColumn("segments", F.array_join("segments", "|"))


@query("path_first_rest", "with " + _DOCS + """
select path, lang as first, source||'/'||cast(doc_id as varchar)||'.txt' as rest from docs""")
def _(spark, d):
    p = F.col("path")
    return doc_listing(spark, d).select("path", P.first(p).alias("first"), P.rest(p).alias("rest"))


@query("join_and_suffix_path", "with " + _DOCS + """
select path, path||'/child' as child, 'top/'||path as below, path as at_root, path||'.old' as suffixed from docs""")
def _(spark, d):
    p = F.col("path")
    return doc_listing(spark, d).select(
        "path", P.join_path(p, F.lit("child")).alias("child"), P.join_path(F.lit("top"), p).alias("below"),
        P.join_path(F.lit(""), p).alias("at_root"), P.suffix_name(p, ".old").alias("suffixed"))


@query("path_order", "with " + LISTING3_SQL + """
select path, row_number() over (order by string_split(path, '/')) as position from (
  select path from b union all select replace(path, '/', '-') || '/x' from b)""")
def _(spark, d):
    from concordat.operators.ordered import with_position
    paths = listing3(spark, d)[0].select("path")
    both = paths.unionByName(paths.select(F.concat(F.translate("path", "/", "-"), F.lit("/x")).alias("path")))
    return with_position(both, [P.path_order(F.col("path"))])


@query("absolute_and_relative_path", "with " + _DOCS + """
select path, '/data/root/'||path as absolute, path as back, cast(null as varchar) as outside from docs""")
def _(spark, d):
    a = P.absolute_path(F.lit("/data/root/"), F.col("path"))
    return doc_listing(spark, d).select(
        "path", a.alias("absolute"), P.relative_path(F.lit("/data/root"), a).alias("back"),
        P.relative_path(F.lit("/data/roo"), a).alias("outside"))


@query("path_key_modes", """
select doc_id, text as sensitive, lower(text) as insensitive, nfc_normalize(text) as unicode,
  lower(nfc_normalize(text)) as unicode_insensitive from documents""")
def _(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", *[P.path_key(F.col("text"), m).alias(m) for m in P.CASE_MODES])


@query("nfc_of_nfd", "select doc_id, md5(nfc_normalize(text)) as composed from documents")
def _(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.md5(P.nfc(P.nfd(F.col("text")))).alias("composed"))


@query("ancestors", "with " + _DOCS + """
select path, unnest([lang, lang||'/'||source, path]) as ancestor from docs""")
def _(spark, d):
    return doc_listing(spark, d).select("path", F.explode(P.ancestors(F.col("path"))).alias("ancestor"))


# -- patterns and filters -----------------------------------------------------

_PATTERNS = {
    "name_star": ("Name *7.txt", "regexp_matches(path, '(^|/)[^/]*7\\.txt$')"),
    "bare": ("1?.txt", "regexp_matches(path, '(^|/)1[^/]\\.txt$')"),
    "name_class": ("Name [1-3]*[!05].txt", "regexp_matches(path, '(^|/)[1-3][^/]*[^05]\\.txt$')"),
    "name_braces": ("Name {1,2{3,4}}*.{txt,md}", "regexp_matches(path, '(^|/)(1|2(3|4))[^/]*\\.(txt|md)$')"),
    "path_star": ("Path en/*/1*", "regexp_matches(path, '^en/[^/]*/1[^/]*$')"),
    "below": ("BelowPath {de,fr}/src1", "regexp_matches(path, '^(de|fr)/src1(/.*)?$')"),
    "regex": ("Regex c1/.*9", "regexp_matches(path, 'c1/.*9')"),
    "escaped": ("Name \\*.txt", "regexp_matches(path, '(^|/)\\*\\.txt$')"),
}


@query("pattern_matches", "with " + _DOCS + "select path, " + ", ".join(
    f"{sql} as {n}" for n, (_, sql) in _PATTERNS.items()) + ", " +
    " or ".join(sql for _, sql in _PATTERNS.values()) + " as any_of, false as none_of from docs")
def _(spark, d):
    p = F.col("path")
    return doc_listing(spark, d).select(
        "path", *[M.any_of(p, [spec]).alias(n) for n, (spec, _) in _PATTERNS.items()],
        M.any_of(p, [spec for spec, _ in _PATTERNS.values()]).alias("any_of"), M.any_of(p, []).alias("none_of"))


@query("ignored", "with " + _DOCS + """
select path, regexp_matches(path, '9\\.txt$') and not regexp_matches(path, '^en/src1/[^/]*$') as ignored from docs""")
def _(spark, d):
    p = F.col("path")
    return doc_listing(spark, d).select("path", M.ignored(p, ["Name *9.txt"], ["Path en/src1/*"]).alias("ignored"))


@query("prune_ignored", "with " + _DOCS + """
select path from docs where not (regexp_matches(path, '(^|/)(src2|[^/]*9\\.txt)(/|$)')
  or regexp_matches(path, '^(de/src1|fr)(/|$)'))""")
def _(spark, d):
    return L.prune_ignored(doc_listing(spark, d), ["Name {src2,*9.txt}", "Path de/src1", "BelowPath fr"]).select("path")


@query("prune_ignored_with_exceptions", "with " + _DOCS + """
select path from docs where not (lang = 'de' or source = 'src1' or (path like '%9.txt' and lang <> 'en'))""")
def _(spark, d):
    """An exception on a child does not bring it back from an ignored parent."""
    return L.prune_ignored(doc_listing(spark, d), ["Path de", "Regex /src1$", "Name *9.txt"],
                           ["Path en/*/*", "Path de/src2/*"]).select("path")


@query("select_paths", "with " + _DOCS + "select path from docs where lang = 'de' or (lang = 'en' and source = 'src1')")
def _(spark, d):
    return L.select_paths(doc_listing(spark, d), ["de", "en/src1"]).select("path")


@query("max_size", "with " + LISTING3_SQL + "select path, octet_length(encode(text)) as length from b where octet_length(encode(text)) <= 2048")
def _(spark, d):
    return L.max_size(listing3(spark, d)[0], 2).select("path", "length")


@query("backup_filter", "with " + _DOCS + "select path, lang = 'en' and source <> 'src1' as wanted from docs")
def _(spark, d):
    return doc_listing(spark, d).select("path", L.backup_filter(F.col("path"), ["BelowPath en"], ["BelowPath en/src1"]).alias("wanted"))


def _linked(spark, d):
    """Each document points at the one before; every seventh is a real file,
    and those of one source close a cycle."""
    doc = table(spark, d, "documents")
    n = F.col("doc_id")
    kind = F.when((n % 7 == 0) & (n % 5 != 0), "file").otherwise("symlink")
    target = F.when(n % 35 == 0, (n + 6).cast("string")).otherwise((n - 1).cast("string"))
    return doc.select(F.concat_ws("/", F.lit("d"), n.cast("string")).alias("path"), kind.alias("kind"),
                      F.when(kind == "symlink", target).alias("target"),
                      F.octet_length("text").cast("long").alias("length"))


_A, _B, _C = "[0369]", "[147]", "[258]"
#: Decimal texts divisible by three, as a pattern.
MULTIPLES_OF_THREE = [
    f"Regex ^d/(?:{_A}|{_B}{_A}*{_C}|(?:{_C}|{_B}{_A}*{_B})(?:{_A}|{_C}{_A}*{_B})*(?:{_B}|{_C}{_A}*{_C}))+$"]


@query("follow_links", """
with n as (select doc_id as n, octet_length(encode(text)) as length, max(doc_id) over () as last,
  doc_id%7 = 0 and doc_id%5 <> 0 as is_file from documents),
e as (select *, n - n%7 as root from n),
c as (select *, root%35 = 0 as cyclic, root + 6 <= last as closed from e),
f as (select c.*, t.length as tlen from c left join n t on t.n = c.root)
select 'd/'||n as path, case when is_file then 'file' when not cyclic and n%3 = 0 then 'file' else 'symlink' end as kind,
  case when is_file then length when not cyclic and n%3 = 0 then tlen else length end as length
from f""")
def _(spark, d):
    return L.follow_links(_linked(spark, d), MULTIPLES_OF_THREE).select("path", "kind", "length")


@query("include_links", """
select 'd/'||doc_id as path from documents where doc_id%7 = 0 and doc_id%5 <> 0""")
def _(spark, d):
    return L.include_links(_linked(spark, d), False).select("path")


# -- trees --------------------------------------------------------------------

_UP = """
up as (select unnest(['', lang, lang||'/'||source]) as path, octet_length(encode(text)) as len, path as leaf from docs)
"""


@query("subtree_rollup", "with " + _DOCS + "," + _UP + "select path, count(*) as n_files, cast(sum(len) as bigint) as n_bytes from up group by 1")
def _(spark, d):
    return V.subtree_rollup(with_directories(listing_of_docs(spark, d)))


@query("nest_children", "with " + _DOCS + """,
n as (select lang||'/'||source as dir, cast(doc_id as varchar)||'.txt' as name from docs
  union all select distinct lang, source from docs union all select distinct '', lang from docs),
r as (select *, (row_number() over (partition by dir order by name) - 1) // 40 as part from n)
select dir, part, array_to_string(list(name order by name), ',') as children from r group by 1, 2""")
def _(spark, d):
    rows = with_directories(listing_of_docs(spark, d))
    out = V.nest_children(rows, page=40)
    return out.withColumn("children", F.array_join("children", ","))


def listing_of_docs(spark, d):
    return as_listing(doc_listing(spark, d).select("path", "text", F.lit(None).cast("timestamp").alias("mtime")))


@query("empty_subtrees", "with " + _DOCS + "select distinct lang||'/'||source as path from docs where source = 'src1' and lang <> 'xx'")
def _(spark, d):
    rows = with_directories(listing_of_docs(spark, d))
    return V.empty_subtrees(rows.where(~((F.col("kind") == "file") & F.col("path").contains("/src1/"))))


@query("map_tree", "with " + _DOCS + "select upper(path) as path, octet_length(encode(text)) * 2 as value from docs")
def _(spark, d):
    rows = listing_of_docs(spark, d).select("path", F.col("length").alias("value"))
    label = F.transform(P.segments(F.col("path")), F.upper)
    return V.map_tree(rows, label=label, value=F.col("value") * 2)


# -- moves --------------------------------------------------------------------

_MOVES = LISTING_PLAN_SQL + """,
g as (select path, md5(lold) as fp, row_number() over (partition by md5(lold) order by string_split(path,'/')) as rn from p where ls = 'deleted'),
c as (select path, md5(ltext) as fp, row_number() over (partition by md5(ltext) order by string_split(path,'/')) as rn from p where ls = 'created'),
m as (select g.path as old_path, c.path as new_path, fp from g join c using (fp, rn))
"""


@query("detect_moves", _MOVES + "select 'left' as side, old_path, new_path, fp from m")
def _(spark, d):
    return H.detect_moves(listing_plan(spark, d))


@query("annotate_moves", _MOVES + """
select path, case when path in (select old_path from m) then 'moved_out' when path in (select new_path from m) then 'moved_in' end as left_move,
  coalesce((select any_value(new_path) from m where old_path = path), (select any_value(old_path) from m where new_path = path)) as other_path
from p""")
def _(spark, d):
    plan = listing_plan(spark, d)
    out = H.annotate_moves(plan, H.detect_moves(plan))
    return out.select("path", F.col("left_move.kind").alias("left_move"), F.col("left_move.other_path").alias("other_path"))


@query("move_rows", _MOVES + """
select coalesce(m.new_path, b.path) as path, md5(b.text) as fp from b left join m on m.old_path = b.path""")
def _(spark, d):
    base = listing3(spark, d)[0]
    return H.move_rows(base, H.detect_moves(listing_plan(spark, d))).select("path", "fp")


@query("case_conflicts", "with " + _DOCS + """
select lang||'/'||source as directory, cast(doc_id as varchar)||'.TXT' as name1, cast(doc_id as varchar)||'.txt' as name2
from docs where doc_id%20 = 0""")
def _(spark, d):
    rows = listing_of_docs(spark, d)
    n = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    loud = rows.where(n % 20 == 0).withColumn("path", F.concat(P.parent(F.col("path")), F.lit("/"), F.upper(P.name(F.col("path")))))
    return H.detect_case_conflicts(rows.unionByName(loud))


@query("same_file_guess", """
with e as (select 'p/' || cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) || '/' ||
    cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as varchar) as path,
  l_quantity, l_shipdate from lineitem),
g as (select min(path) as path1, count(*) as n_class, l_quantity, l_shipdate from e group by 3, 4 having count(*) > 1)
select path1, path as path2, n_class from e join g using (l_quantity, l_shipdate) where path <> path1""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("/", F.lit("p"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.row_number().over(w).cast("string")).alias("path"),
        F.lit("file").alias("kind"), F.col("l_quantity").cast("long").alias("length"),
        F.col("l_shipdate").cast("timestamp").alias("mtime"))
    return H.same_file_guess(rows)


# -- fingerprints -------------------------------------------------------------

@query("content_and_range_fp", """
select doc_id, md5(text) as fp, md5(array_slice(encode(text), 11, 50)) as range_fp from documents""")
def _(spark, d):
    doc = table(spark, d, "documents")
    content = F.encode("text", "UTF-8")
    return doc.select("doc_id", FP.content_fp(content).alias("fp"), FP.range_fp(content, 10, 40).alias("range_fp"))


@query("full_fp", """
select a.doc_id, a.lang = b.lang and a.source = b.source as same, a.lang = b.lang as same_data
from documents a join documents b on b.doc_id = a.doc_id + 1""")
def _(spark, d):
    doc = table(spark, d, "documents")
    a = doc.select("doc_id", FP.full_fp(F.md5("lang"), F.nullif(F.md5("source"), F.md5(F.lit("src0")))).alias("a"))
    b = doc.select((F.col("doc_id") - 1).alias("doc_id"), FP.full_fp(F.md5("lang"), F.nullif(F.md5("source"), F.md5(F.lit("src0")))).alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"),
                                      (F.col("a.fp") == F.col("b.fp")).alias("same_data"))


_HASH = """list_reduce(list_transform(string_split({0}, ''), lambda c: cast(unicode(c) as bigint)),
    lambda a, c: (a * 31 + c) & 2147483647, cast(0 as bigint))"""
_LE = " || ".join(f"printf('%02x', ({{0}} >> {8 * i}) & 255)" for i in range(8))


def pseudo_sql(path: str, size: str) -> str:
    return f"('4c454e' || {_LE.format(size)} || printf('%08x', {_HASH.format(path)}) || '00')"


@query("pseudo_fp", "with " + _DOCS + ", f as (select path, " + pseudo_sql("path", "octet_length(encode(text))") + """ as fp from docs)
select path, fp, true as is_pseudo, 5129548 as short_hash from f""")
def _(spark, d):
    fp = FP.pseudo_fp(F.col("path"), F.octet_length("text"))
    return doc_listing(spark, d).select("path", fp.alias("fp")).select(
        "path", "fp", FP.is_pseudo(F.col("fp")).alias("is_pseudo"), FP.short_hash(F.col("fp")).alias("short_hash"))


@query("short_hash", """
select doc_id, (strpos('0123456789abcdef', f[1]) - 1) * 16 + strpos('0123456789abcdef', f[2]) - 1
  + ((strpos('0123456789abcdef', f[3]) - 1) * 16 + strpos('0123456789abcdef', f[4]) - 1) * 256
  + ((strpos('0123456789abcdef', f[5]) - 1) * 16 + strpos('0123456789abcdef', f[6]) - 1) * 65536 as short_hash
from (select doc_id, md5(text) as f from documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", FP.short_hash(F.md5("text")).alias("short_hash"))


@query("fp_reuse", "with " + LISTING3_SQL + """
select l.path, case when c.path is null then null else md5(c.text) end as fp
from l left join b c on c.path = l.path and c.mt = l.mt and octet_length(encode(c.text)) = octet_length(encode(l.text))""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return SN.reuse_fp(left, base.select("path", "length", "mtime", "fp")).select("path", "fp")


@query("update_fp_cache", "with " + LISTING3_SQL + """
select path, md5(text) as fp from l union all select path, md5(text) from b where path not in (select path from l)""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    cols = ["path", "fp", "mtime", "length", "perms"]
    return SN.update_fp_cache(base.select(*cols), left.select(*cols)).select("path", "fp")


@query("invalidate_fp_cache", "with " + LISTING3_SQL + "select path, md5(text) as fp from b where path not in (select path from l)")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return SN.invalidate(base, left).select("path", "fp")


@query("fingerprint_suspects", "with " + LISTING3_SQL + """
select l.path, b.path is null or octet_length(encode(b.text)) <> octet_length(encode(l.text)) as suspect from l left join b on b.path = l.path""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return SN.fingerprint_suspects(left, base).select("path", "suspect")


@query("fingerprint_table", "with " + LISTING3_SQL + """
select l.path, md5(l.text) as fp from l""")
def _(spark, d):
    """Two stages: metadata first, then only the contents that are in doubt."""
    from suite.fixtures import listing3_text
    base, left, _ = listing3(spark, d)
    suspects = SN.fingerprint_suspects(left, base)
    return SN.fingerprint_table(suspects, listing3_text(spark, d)[1], "text").select("path", "fp")


@query("pseudo_first_scan", "with " + LISTING3_SQL + """
select l.path, case when b.path is null then """ + pseudo_sql("l.path", "octet_length(encode(l.text))") + """
  when octet_length(encode(b.text)) = octet_length(encode(l.text)) then md5(b.text) end as fp
from l left join b on b.path = l.path""")
def _(spark, d):
    base, left, _ = listing3(spark, d)
    return SN.fingerprint_suspects(left, base, pseudo_new_files=True).select("path", "fp")


@query("build_base", "with " + LISTING3_SQL + """
select path, md5(text) as fp from l where not regexp_matches(path, '^[^/]*/src1(/|$)')""")
def _(spark, d):
    return SN.build_base(listing3(spark, d)[1], ["Path */src1"]).select("path", "fp")


@query("base_id", """
select o_orderkey, substring(md5(concat(cast(o_custkey as varchar), ';', o_orderpriority, ';1')), 1, 12) as id from orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", base_id_column(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("id"))


# -- remote listings ----------------------------------------------------------


def _remote_pages(spark, d):
    """Pages as rows of a remote listing, one folder per page id."""
    p = table(spark, d, "pages")
    n = F.col("page_id")
    day = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=n.cast("int") % 365)
    http = F.concat(F.date_format(day, "EEE"), F.lit(", "), F.date_format(day, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return p.select(
        F.concat(F.lit("/dav/site/"), n.cast("string"), F.lit("/a%20b+c.html")).alias("href"),
        F.lit(False).alias("is_directory"), F.octet_length("html").cast("string").alias("size"),
        F.when(n % 3 == 0, http).when(n % 3 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("yesterday").alias("last_modified"),
        F.when(n % 7 != 0, F.md5("html")).alias("etag"))


@query("remote_listing", """
select cast(page_id as varchar)||'/a b+c.html' as path, 'file' as kind, octet_length(encode(html)) as length,
  case when page_id%3 <> 2 then strftime(timestamp '2024-01-01' + to_days(cast(page_id%365 as integer)), '%Y-%m-%d') end as day,
  case when page_id%7 <> 0 then md5(html) end as etag from pages""")
def _(spark, d):
    rows = _remote_pages(spark, d)
    itself = rows.select(F.lit("http://host/dav/site").alias("href"), F.lit(True).alias("is_directory"),
                         F.lit("0").alias("size"), F.lit("").alias("last_modified"),
                         F.lit(None).cast("string").alias("etag")).distinct()
    out = remote_listing(rows.unionByName(itself), "https://host/dav/site/")
    return out.select("path", "kind", "length", F.date_format("mtime", "yyyy-MM-dd").alias("day"), "etag")


_ETAG = "case when page_id%7 <> 0 then md5(md5(html)) else " + pseudo_sql(
    "'a b+c.html:' || cast(octet_length(encode(html)) as varchar) || ':' || case when page_id%3 <> 2 then "
    "strftime(timestamp '2024-01-01' + to_days(cast(page_id%365 as integer)), '%Y-%m-%d %H:%M:%S') || '.000Z' else 'null' end",
    "octet_length(encode(html))") + " end"


@query("etag_fp", f"select cast(page_id as varchar)||'/a b+c.html' as path, {_ETAG} as fp from pages")
def _(spark, d):
    rows = remote_listing(_remote_pages(spark, d), "/dav/site")
    return rows.select("path", FP.etag_fp(F.col("etag"), P.name(F.col("path")), F.col("length"), F.col("mtime")).alias("fp"))


def _remote_base(spark, d):
    rows = remote_listing(_remote_pages(spark, d), "/dav/site")
    n = F.substring_index("path", "/", 1).cast("long")
    fp = FP.etag_fp(F.col("etag"), P.name(F.col("path")), F.col("length"), F.col("mtime"))
    edited = F.when(n % 10 < 2, F.md5(fp)).otherwise(fp)
    return rows, rows.select("path", "kind", (F.col("length") + F.when(n % 10 == 0, 1).otherwise(0)).alias("length"),
                             "mtime", edited.alias("fp")).where(n % 10 != 5)


for _name, _trust, _mod in (("remote_updates", False, "page_id%10 < 2"), ("remote_updates_trust_size", True, "page_id%10 = 0")):
    @query(_name, f"""
select cast(page_id as varchar)||'/a b+c.html' as path, case when page_id%10 = 5 then 'created' else 'modified' end as status
from pages where page_id%10 = 5 or {_mod}""")
    def _(spark, d, trust=_trust):
        rows, base = _remote_base(spark, d)
        return U.detect_remote_updates(rows, base, UpdateConfig(trust_size=trust)).select("path", "status")


def _remote_sides(spark, d):
    """Pages as files here and there, edited, deleted and added by the last digit
    of their number: 0 edited on both sides, 1 and 2 edited and deleted here, 3
    and 4 there, 5 new there, 6 new here, 7 uploaded again there at equal size."""
    p = table(spark, d, "pages")
    digit, path = F.col("page_id") % 10, F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit("/a.html"))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def listing(edited, skipped):
        text = F.when(digit.isin(*edited), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
        return p.where(~digit.isin(*skipped)).select(path.alias("path"), F.lit("file").alias("kind"), F.octet_length(text).cast("long").alias("length"),
                                                     t0.alias("mtime"), text.alias("text"), digit.alias("digit"))

    here = lambda rows: rows.withColumn("fp", F.md5("text")).drop("text", "digit")
    there = lambda rows, again=(): rows.withColumn("etag", F.md5(F.concat(F.md5("text"), F.when(F.col("digit").isin(*again, -1), F.lit("again")).otherwise(F.lit(""))))).drop("text", "digit")
    local, remote = here(listing((0, 1), (2, 5))), there(listing((0, 3), (4, 6)), (7,))
    base = RM.remote_base(here(listing((), (5, 6))), there(listing((), (5, 6))))
    after = here(listing((0, 1, 3), (2, 4))), there(listing((0, 1, 3), (2, 4)), (7,))
    return local, remote, base, after


for _name, _trust in (("remote_cycle", False), ("remote_cycle_trust_size", True)):
    @query(_name, f"""
with p as (select 'site' || cast(page_id as varchar) || '/a.html' as path, page_id % 10 as digit from pages)
select 1 as cycle, path, case when digit in (1, 2, 6) then 'l2r' when digit = 0 then 'conflict' else 'r2l' end as direction from p
where digit < 7 or (digit = 7 and {not _trust})
union all select 2, path, 'conflict' from p where digit = 0""")
    def _(spark, d, trust=_trust):
        """Two cycles with a remote side known by tags: in the second one only
        what was in conflict is left."""
        local, remote, base, after = _remote_sides(spark, d)
        cfg = JobConfig(update=UpdateConfig(trust_size=trust))
        first = RM.sync_remote(local, remote, base, cfg)
        learnt = materialize(RM.learn(first.base, *after), "base")
        second = RM.plan_remote(*after, learnt, cfg)
        return first.plan.select(F.lit(1).alias("cycle"), "path", "direction").unionByName(second.select(F.lit(2).alias("cycle"), "path", "direction"))


@query("sync_selected_paths", LISTING_PLAN_SQL + """
select path, d as direction from p where regexp_matches(path, '^(de|en/src1)(/|$)') and not regexp_matches(path, '9\\.txt$')""")
def _(spark, d):
    """A plan restricted to sub-paths, with ignored names."""
    base, left, right = listing3(spark, d)
    plan = make_plan(left, right, base, JobConfig(paths=("de", "en/src1"), ignore=("Name *9.txt",)))
    return plan.select("path", "direction")
