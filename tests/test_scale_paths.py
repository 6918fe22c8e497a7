"""The paths taken for large groups give what the simple ones give."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concordat.config import JobConfig
from concordat.operators import backups as BK
from concordat.operators import listings as L
from concordat.operators import moves as H
from concordat.operators import stats as ST
from concordat.operators.ordered import rank_in_groups, running_totals, with_position
from concordat.plans.cycle import make_plan
from suite import cycles  # noqa: F401
from suite.registry import QUERIES
from tests.test_plan import listing, row


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 30)}", i, rnd.randint(0, 9)) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, i int, v int").repartition(6)


def test_running_totals_in_pieces(skewed):
    args = (["g"], [F.col("v"), F.col("i")], {"s": F.col("v").cast("long"), "n": F.lit(1).cast("long")})
    w = Window.partitionBy("g").orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)
    one = skewed.withColumns({"s": F.sum(F.col("v").cast("long")).over(w), "n": F.count("*").over(w)})
    cut = running_totals(skewed, *args, partitions=9)
    assert one.exceptAll(cut).isEmpty() and cut.exceptAll(one).isEmpty()


def test_rank_with_null_group(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(200)], "g string, i int")
    one = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("i")).cast("long"))
    cut = rank_in_groups(df, ["g"], [F.col("i")], partitions=7)
    assert one.exceptAll(cut).isEmpty() and one.count() == cut.count() == 200


def test_position(skewed):
    got = with_position(skewed, [F.col("v").desc(), F.col("i")], partitions=7).orderBy("position").toPandas()
    want = skewed.toPandas().sort_values(["v", "i"], ascending=[False, True])
    assert got["position"].tolist() == list(range(1, 3001)) and got["i"].tolist() == want["i"].tolist()


def test_many_equal_files_move_one_to_one(spark):
    base = listing(spark, *[row(f"old/{i:03}", "empty", length=0) for i in range(90)], row("keep", "k"))
    left = listing(spark, *[row(f"new/{i:03}", "empty", length=0) for i in range(70)], row("keep", "k"))
    plan = make_plan(left, base, base, JobConfig())
    want = {(f"old/{i:03}", f"new/{i:03}") for i in range(70)}
    assert {(r["old_path"], r["new_path"]) for r in H.detect_moves(plan).collect()} == want


def test_long_link_chains(spark):
    rows = [row(f"c{i:03}", None, "symlink", 0, target=f"c{i + 1:03}") for i in range(120)] + [row("c120", "end", length=7)]
    rows += [row("a", None, "symlink", 0, target="b"), row("b", None, "symlink", 0, target="a"),
             row("into", None, "symlink", 0, target="./a"), row("dangling", None, "symlink", 0, target="nowhere"),
             row("d/up", None, "symlink", 0, target="../c120"), row("d/out", None, "symlink", 0, target="../../x")]
    got = {r["path"]: (r["kind"], r["length"]) for r in L.follow_links(listing(spark, *rows), ["Regex .*"]).collect()}
    assert got["c119"] == got["c020"] == got["d/up"] == ("file", 7)
    assert got["c019"][0] == "symlink"  # 101 hops
    assert {got[p][0] for p in ("a", "b", "into")} == {"symlink"}
    assert got["dangling"][0] == got["d/out"][0] == "symlink"


def brute_samples(times):
    last, out = times[0], []
    for t in times[1:]:
        if t - last >= ST.SAMPLE_MS:
            out.append(t)
            last = t
    return out


def test_samples_across_chunks(spark, monkeypatch):
    rnd = random.Random(11)
    rows, want = [], set()
    for run in range(6):
        t, times = rnd.randint(0, 10 ** 6), []
        for _ in range(400):
            times.append(t)
            t += rnd.choice([0, 1, 3, 90, 180, 260, 499, 500, 501, 700, 4000] if run % 2 else [30, 90, 180, 260])
        rows += [(run, t, i) for i, t in enumerate(times)]
        want |= {(run, s) for s in brute_samples(times)}
    log = spark.createDataFrame(rows, "run_id int, ms long, seq int").select(
        "run_id", F.timestamp_millis("ms").alias("ts"), "seq", F.lit(100).cast("long").alias("bytes"), F.lit(True).alias("item_done"))
    got = {(r["run_id"], r["ms"]) for r in ST.sample_times(log).collect()}
    assert got == want


def test_samples_span_chunk_borders(spark):
    border = ST.CHUNK_SLOTS * ST.SAMPLE_MS
    rnd = random.Random(2)
    t, times = border - 40_000, []
    while t < border + 40_000:
        times.append(t)
        t += rnd.choice([70, 110, 490, 240])
    log = spark.createDataFrame([(1, t) for t in times], "run_id int, ms long").select("run_id", F.timestamp_millis("ms").alias("ts"))
    assert sorted(r["ms"] for r in ST.sample_times(log).collect()) == brute_samples(times)


def test_samples_of_a_long_dense_run(spark):
    """Many chunks in a row, each depending on the one before, beside a run with a gap."""
    rnd = random.Random(4)
    rows, want = [], set()
    for run, (start, stop) in enumerate([(123_456, 20 * 3_600_000), (0, 9 * 3_600_000)]):
        t, times = start, []
        while t < stop:
            times.append(t)
            t += rnd.choice([410, 470, 499, 300, 730])
        if run:
            times = [t for t in times if not 7_000_000 < t < 20_000_000]
        rows += [(run, t) for t in times]
        want |= {(run, s) for s in brute_samples(times)}
    log = spark.createDataFrame(pd.DataFrame(rows, columns=["run_id", "ms"])).select("run_id", F.timestamp_millis("ms").alias("ts"))
    assert {(r["run_id"], r["ms"]) for r in ST.sample_times(log).collect()} == want


def test_rolling_rate_window(spark):
    rows = [(1, 1000 * i, i, 10 * i) for i in range(60)]
    log = spark.createDataFrame(rows, "run_id int, ms long, seq int, bytes long").select(
        "run_id", F.timestamp_millis("ms").alias("ts"), "seq", "bytes", F.lit(False).alias("item_done"))
    got = ST.rolling_rate(log).orderBy("seq").toPandas()
    done = pd.Series([r[3] for r in rows]).cumsum()
    for k in (0, 1, 2, 5, 21, 59):
        if k < 2:
            want = done[k] / k if k else 0.0
        else:
            first = max(k - 19, 1)
            want = (done[k] - done[first]) / (k - first)
        assert got["rate"][k] == pytest.approx(want), k


def test_backup_rotation_limits_before_the_shuffle(spark):
    from concordat.operators.backups import rotate_backups
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("taken_at"), F.lit(0).alias("version"))
    plan = rotate_backups(df, ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_metadata_stage_reads_no_content(spark, tmp_path):
    """The first stage of fingerprinting prunes the content column."""
    from concordat.operators.snapshots import fingerprint_suspects
    files = listing(spark, row("a"), row("b")).withColumn("content", F.lit(b"x"))
    files.write.parquet(str(tmp_path / "l"))
    now = spark.read.parquet(str(tmp_path / "l"))
    plan = fingerprint_suspects(now.drop("content"), now)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_conflict_copies_in_many_tasks(spark, tmp_path):
    """Copies of the names of one small file are made and read in all tasks and
    shuffled once, by name."""
    docs = [(i, "en", "web") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["conflict_copies_many"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(dir") == 1
    got = {r["path"]: r["copy"] for r in out.collect()}
    assert got == {f"en/web/{i}.txt": f"en/web/{i} (conflict on 2024-06-01).{120 + i % 7}.txt" for i in range(40)}


def test_conflict_copies_of_odd_names(spark):
    day = " (conflict on 2024-06-01)"
    files = ["a.txt", "d/a.txt", "a", "a.b.c", ".x", "x.3", "a.", "", None]
    there = [f"a{day}.txt", f"a{day}.1.txt", f"a{day}.1.txt", f"a{day}.3.txt", f"d/a{day}.00.txt", f"a{day}", f"a{day}.01", f"a{day}.x.txt",
             f"a.b{day}.99999999999999999999.c", f".x{day}.0", f".x{day}.1.2", f"x{day}.3", f"a{day}.", "a(conflict on 2024-06-01).2.txt", None]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    out = BK.conflict_copies(frame(files), frame(there), F.lit("2024-06-01").cast("timestamp"))
    assert {r["path"]: r["copy"] for r in out.collect()} == {
        "a.txt": f"a{day}.2.txt", "d/a.txt": f"d/a{day}.1.txt", "a": f"a{day}.2", "a.b.c": f"a.b{day}.1.c", ".x": f".x{day}.1", "x.3": f"x{day}.1.3",
        "a.": f"a{day}.1.", "": day, None: ""}
