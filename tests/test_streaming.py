"""Continuous runs over small event files."""

import random

import pytest
from pyspark.sql import functions as F

from concordat.config import BackupConfig, JobConfig, PlanConfig
from concordat.operators.guards import Refused
from concordat.operators.propagate import replicas_equal
from concordat.sources.stores import ReplicaStore
from concordat.streaming import changes as CH
from concordat.streaming.sync import SyncOnChange, sync_on_change, sync_repeat
from tests.test_plan import listing, row, rows_of
from tests.test_tree import forests, frame

EVENT = "path string, action string, ts timestamp, replica int"


def events(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_debounce_matches_batch(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    rows = [("a", "modified", at(0)), ("b", "modified", at(0.4)), ("a", "modified", at(0.8)), ("c", "created", at(1.3)),
            ("d", "created", at(1.9)), ("e", "created", at(10)), ("z", "created", at(50))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = events(spark, *rows)
    ev.coalesce(1).write.parquet(src)
    stream = CH.change_stream(spark, src, ev.schema)
    q = (CH.debounce(stream, "500 milliseconds", "1 second").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.read.parquet(out)
    bounds = CH.batch_bounds(ev, 0.5)
    assert bounds.count() == 4
    assert emitted.exceptAll(bounds.select(*emitted.columns)).isEmpty() and emitted.count() == 3
    paths = {(r["batch_start"].second, r["path"]) for r in CH.debounce_batch(ev, 0.5).collect()}
    assert paths == {(0, "a"), (0, "b"), (0, "c"), (1, "d"), (10, "e"), (50, "z")}
    assert [r["path"] for r in CH.flush_on_stop(ev, emitted, 0.5).collect()] == ["z"]


def test_late_events_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    first = events(spark, ("a", "modified", "2024-01-01 01:00:00"), ("b", "modified", "2024-01-01 02:00:00"))
    late = events(spark, ("late", "modified", "2024-01-01 00:00:00"), ("c", "modified", "2024-01-01 03:00:00"))

    def run():
        stream = CH.change_stream(spark, str(src), first.schema)
        q = (CH.debounce(stream, "1 minute", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    first.coalesce(1).write.mode("append").parquet(str(src))
    run()
    late.coalesce(1).write.mode("append").parquet(str(src))
    run()
    starts = {r["batch_start"].hour for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert starts == {1, 2}


def test_sync_on_change(spark, tmp_path):
    store = ReplicaStore(spark, str(tmp_path / "store"), ["path"])
    rows = [row(f"p{i}") for i in range(20)]
    store.create(left=listing(spark, *rows, row("new", "n")), right=listing(spark, *rows), base=listing(spark, *rows))
    sink = SyncOnChange(store, JobConfig())
    sink.run()  # initial sync
    assert replicas_equal(store.read("left"), store.read("right"), ["path"]).first()["equal"]

    # Somebody edits p3 on the right and deletes p4 on the left; events follow.
    hit = F.col("path") == "p3"
    edited = store.read("right").withColumns({
        "fp": F.when(hit, "edited").otherwise(F.col("fp")), "length": F.when(hit, 9).otherwise(F.col("length"))})
    store.put(right=edited, left=store.read("left").where("path <> 'p4'"))
    src = str(tmp_path / "events")
    ev = events(spark, ("p3", "modified", "2024-01-01"), ("p4", "deleted", "2024-01-01"))
    ev.coalesce(1).write.parquet(src)
    q = sync_on_change(CH.change_stream(spark, src, ev.schema), sink, str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None and sink.rounds == 3
    assert replicas_equal(store.read("left"), store.read("right"), ["path"]).first()["equal"]
    got = dict(rows_of(store.read("left"), "path", "fp"))
    assert got["p3"] == "edited" and "p4" not in got and len(got) == 20
    assert dict(rows_of(store.read("base"), "path", "fp")) == got


def test_guards_look_at_whole_sides(spark, tmp_path):
    store = ReplicaStore(spark, str(tmp_path / "store"), ["path"])
    df = listing(spark, *[row(f"p{i}") for i in range(10)])
    store.create(left=df.where("path <> 'p1'"), right=df, base=df)
    sink = SyncOnChange(store, JobConfig())
    sink.run(spark.createDataFrame([("p1",)], "path string"))
    assert store.read("right").count() == store.read("base").count() == 9
    store.put(left=df.where("false"))
    with pytest.raises(Refused):
        sink.run(spark.createDataFrame([("p2",)], "path string"))


def with_errors(rng, tree):
    """Some directories that could not be read: their rows say so, what lies in
    them is missing."""
    bad = [p for p, v in tree.items() if v is None and "/" in p and rng.random() < 0.1]
    kept = {p: v for p, v in tree.items() if not any(p.startswith(b + "/") for b in bad)}
    return kept, [b for b in bad if b in kept]


@pytest.mark.parametrize("cfg", [JobConfig(), JobConfig(ignore=("Name c",), plan=PlanConfig(atomic=("Name a",)))])
def test_touched_runs_equal_full_runs(spark, tmp_path, cfg):
    rng = random.Random(9)
    base_tree, *sides = forests(31, 80)
    base, frames, marked = frame(spark, base_tree), [], set()
    for tree in sides:
        kept, bad = with_errors(rng, tree)
        marked |= set(bad) | (set(tree) - set(kept))
        frames.append(frame(spark, kept).withColumn("error", F.when(F.col("path").isin(bad), "denied")))
    changed = {p for tree in sides for p in {*tree, *base_tree} if tree.get(p, 0) != base_tree.get(p, 0)} | marked
    stores = [ReplicaStore(spark, str(tmp_path / n), ["path"]) for n in ("full", "touched")]
    for store in stores:
        store.create(left=frames[0], right=frames[1], base=base)
    SyncOnChange(stores[0], cfg).run()
    sink = SyncOnChange(stores[1], cfg)
    half = {p for p in changed if int(p.split("/")[0][1:]) % 2}
    for batch, part in enumerate((half, changed - half)):
        sink(spark.createDataFrame([(p,) for p in part], "path string"), batch)
    sink(spark.createDataFrame([(p,) for p in half], "path string"), 1)  # a repeated batch
    assert sink.rounds == 2
    for name in ReplicaStore.TABLES:
        full, part = (sorted(map(str, s.read(name).select("path", "kind", "fp", "error").collect())) for s in stores)
        assert full == part, name


def test_history_and_backups_are_pruned_with_the_tables(spark, tmp_path):
    df = listing(spark, *[row(f"p{i}") for i in range(5)])
    store = ReplicaStore(spark, str(tmp_path / "s"), ["path"], keep_records=3, keep_copies=2, fold_sets=2)
    store.create(left=df, right=df, base=df)
    sink = SyncOnChange(store, JobConfig(backup=BackupConfig()))
    for i in range(5):
        hit = F.col("path").isin("p1", f"p{i}")
        store.put(left=store.read("left").withColumns({"fp": F.when(hit, f"v{i}").otherwise(F.col("fp")), "length": F.when(hit, F.lit(10 + i)).otherwise(F.col("length"))}))
        sink(spark.createDataFrame([("p1",), (f"p{i}",)], "path string"), i)
    records, entries = store.history()
    assert records.count() == 3 and entries.select("sync_id").distinct().count() == 3
    assert entries.where("path = 'p1'").count() == 3
    copies = store.backups()
    assert rows_of(copies.where("path = 'p1'"), "version", "payload.fp") == [(0, "v3"), (1, "v2")]
    assert rows_of(copies.where("path = 'p3'"), "version", "payload.fp") == [(0, "x")]
    assert rows_of(store.read("right"), "path", "fp") == rows_of(store.read("left"), "path", "fp")


def test_state_survives_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = events(spark, ("a", "created", "2024-01-01"), ("b", "created", "2024-01-01"), ("c", "created", "2024-01-01"))
    second = events(spark, ("a", "deleted", "2024-01-02"), ("b", "modified", "2024-01-03"), ("b", "created", "2023-12-31"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        CH.state_stream(CH.change_stream(spark, src, first.schema), ["path"], out, ck).awaitTermination()
    assert rows_of(CH.read_state(spark, out, ["path"]), "path", "action") == [("b", "modified"), ("c", "created")]


def test_sync_repeat(spark, tmp_path):
    store = ReplicaStore(spark, str(tmp_path / "store"), ["path"])
    store.create(left=listing(spark, row("a"), row("b")), right=listing(spark, row("a")), base=listing(spark, row("a")))
    ticks = events(spark, ("x", "modified", "2024-01-01"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    sink = SyncOnChange(store, JobConfig())
    q = sync_repeat(CH.change_stream(spark, str(tmp_path / "ticks"), ticks.schema), sink, str(tmp_path / "ck"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sink.rounds == 1 and rows_of(store.read("right"), "path") == [("a",), ("b",)]
