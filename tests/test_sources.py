"""Trees on disk, stores, history files."""

import hashlib
import os

from pyarrow import fs as pa_fs
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import ApplyConfig, JobConfig
from concordat.operators import history as HI
from concordat.operators import propagate as A
from concordat.operators.snapshots import fingerprint_suspects
from concordat.plans.cycle import dry_run
from concordat.sources import stores as ST
from concordat.sources.trees import file_contents, hash_suspects, scan_tree
from tests.test_plan import listing, row, rows_of, two_sides


def make_tree(root):
    for path, text in {"hello.txt": "hello", "docs/readme.md": "doc", ".hidden/.x": "h", "docs/deep/er/z.tmp": "z"}.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    (root / "empty_dir").mkdir()
    os.symlink("hello.txt", root / "link")
    return str(root)


def test_scan_and_hash(spark, tmp_path):
    root = make_tree(tmp_path / "t")
    found = scan_tree(spark, root, tasks=2)
    assert {(r["path"], r["kind"]) for r in found.collect()} == {
        ("hello.txt", "file"), ("docs", "directory"), ("docs/readme.md", "file"), (".hidden", "directory"),
        (".hidden/.x", "file"), ("docs/deep", "directory"), ("docs/deep/er", "directory"), ("docs/deep/er/z.tmp", "file"),
        ("empty_dir", "directory"), ("link", "symlink")}
    assert found.where("kind = 'symlink'").first()["target"] == "hello.txt"
    base = found.where("path = 'hello.txt'").withColumn("fp", F.lit("remembered"))
    marked = fingerprint_suspects(found, base)
    assert {r["path"] for r in marked.where("suspect").collect()} == {"docs/readme.md", ".hidden/.x", "docs/deep/er/z.tmp"}
    os.remove(f"{root}/.hidden/.x")
    done = {r["path"]: r for r in hash_suspects(marked, root, tasks=2).collect()}
    assert done["docs/readme.md"]["fp"] == hashlib.md5(b"doc").hexdigest()
    assert done["hello.txt"]["fp"] == "remembered" and done[".hidden/.x"]["error"]
    visible = {r["path"]: bytes(r["content"]) for r in file_contents(spark, root).collect()}
    assert visible == {"link": b"hello", "hello.txt": b"hello", "docs/readme.md": b"doc", "docs/deep/er/z.tmp": b"z"}


def test_a_root_that_cannot_be_listed(spark, tmp_path):
    found = scan_tree(spark, str(tmp_path / "missing"), tasks=2).collect()
    assert [(r["path"], r["kind"], r["mtime"]) for r in found] == [("", "directory", None)] and found[0]["error"]


def in_store(root):
    """A store that knows only what is below one folder, as a bucket does."""
    scheme, path = root.split("://")
    assert scheme == "bucket"
    return pa_fs.SubTreeFileSystem("/" + path, pa_fs.LocalFileSystem()), ""


def test_a_tree_in_a_store(spark, tmp_path):
    root = make_tree(tmp_path / "t")
    os.symlink("nowhere", f"{root}/dangling")
    plain = {r["path"]: r for r in scan_tree(spark, root, tasks=2).where("kind <> 'symlink'").collect()}
    url = "bucket:/" + root
    found = scan_tree(spark, url, tasks=2, opener=in_store)
    seen = {r["path"]: r for r in found.collect() if r["path"] not in ("link", "dangling")}
    assert seen.keys() == plain.keys()
    for path, r in seen.items():
        assert (r["kind"], r["mtime"], r["error"], r["perms"]) == (plain[path]["kind"], plain[path]["mtime"], None, None)
        assert r["length"] == plain[path]["length"]
    marked = found.withColumns({"fp": F.lit(None).cast("string"), "suspect": F.col("kind") == "file"})
    os.remove(f"{root}/.hidden/.x")
    done = {r["path"]: r for r in hash_suspects(marked, url, tasks=2, opener=in_store).collect()}
    assert done["docs/readme.md"]["fp"] == hashlib.md5(b"doc").hexdigest() and done[".hidden/.x"]["error"] and done["docs"]["fp"] is None
    missing = scan_tree(spark, url + "/missing", tasks=2, opener=in_store).collect()
    assert [(r["path"], r["kind"]) for r in missing] == [("", "directory")] and missing[0]["error"]
    assert {r["path"] for r in scan_tree(spark, "file://" + root, tasks=2).collect()} >= plain.keys() - {".hidden/.x"}


def test_base_versions(spark, tmp_path):
    root = str(tmp_path)
    df = listing(spark, row("a"), row("b"))
    assert ST.load_base(spark, root, "A", "B", df.schema).isEmpty() and not ST.base_exists(spark, root, "A", "B")
    ST.save_base(spark, root, "A", "B", df)
    old = ST.load_base(spark, root, "A", "B", df.schema)
    ST.save_base(spark, root, "A", "B", old.where("path = 'a'"))
    assert old.count() == 2 and ST.load_base(spark, root, "A", "B", df.schema).count() == 1
    # A save that died before its pointer row was written changes nothing.
    df.write.parquet(f"{root}/data/{ST.base_id(spark, 'A', 'B')}/unfinished")
    assert ST.load_base(spark, root, "A", "B", df.schema).count() == 1
    assert ST.load_base(spark, root, "B", "A", df.schema).isEmpty()
    ST.drop_base(spark, root, "A", "B")
    assert not ST.base_exists(spark, root, "A", "B") and ST.load_base(spark, root, "A", "B", df.schema).isEmpty()


def test_fp_cache(spark, tmp_path):
    root = str(tmp_path / "c")
    assert ST.load_fp_cache(spark, root).isEmpty()
    ST.save_fp_cache(listing(spark, row("a"), row("b")), root)
    assert ST.load_fp_cache(spark, root).count() == 2


def test_bucketed_snapshots_join_without_shuffle(spark, tmp_path):
    from concordat.operators.updates import detect_updates
    df = listing(spark, *[row(f"p{i}") for i in range(50)])
    for name in ("snap_a", "snap_b"):
        spark.sql(f"drop table if exists {name}")
        df.repartition(4, "path").write.bucketBy(4, "path").sortBy("path").option("path", str(tmp_path / name)).saveAsTable(name)
    a, b = spark.table("snap_a"), spark.table("snap_b")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = detect_updates(a, b, ["path"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table snap_a"), spark.sql("drop table snap_b")
    assert "Exchange" not in plan


def test_history_files(spark, tmp_path):
    root = str(tmp_path / "h")
    left, right, base = two_sides(spark)
    plan = dry_run(left, right, base, JobConfig())
    done = A.results(plan, ["path"], ApplyConfig())
    for i in range(3):
        sid = F.lit(f"s{i}")
        ST.append_history(HI.history_record(done, sid, F.lit(f"2024-06-0{i + 1}"), "A", "B"),
                          HI.history_entries(done, ["path"], sid), root)
    with open(f"{root}/records/broken.json", "w") as f:
        f.write("{not json\n")
    records, entries = ST.read_history(spark, root)
    assert [r["sync_id"] for r in records.collect()] == ["s2", "s1", "s0"]
    assert records.first()["propagated"] == 4 and entries.count() == 12
    assert rows_of(entries.where("sync_id = 's1'"), "path", "action", "direction") == [
        ("del", "deleted", "r1to2"), ("new", "created", "r1to2"), ("other", "created", "r2to1"), ("touch", "propsChanged", "r1to2")]
    assert [r["sync_id"] for r in HI.file_history(records, entries, "new").collect()] == ["s2", "s1", "s0"]
    kept, kept_entries = ST.kept_history(spark, root, 2)
    assert kept.count() == 2 and kept_entries.count() == 8
    nothing = HI.history_record(done.where("outcome = 'skipped'"), F.lit("x"), F.lit("2024-01-01"))
    assert nothing.isEmpty()
    ST.clear_history(spark, root)
    assert ST.read_history(spark, root)[0].isEmpty()


def test_schema_names():
    assert [f.name for f in S.LISTING][:4] == ["path", "kind", "length", "mtime"]
