"""Decision tables and laws of the cycle."""

import itertools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import ApplyConfig, BackupConfig, JobConfig, PlanConfig, UpdateConfig
from concordat.operators import guards as G
from concordat.operators import propagate as A
from concordat.operators import reconcile as R
from concordat.operators.merge import parse_rule, three_way_merge
from concordat.operators.snapshots import KeyViolation, check_keys, snapshot_table
from concordat.operators.updates import classify
from concordat.plans.cycle import commit, dry_run, make_plan, sync
from concordat.sources import stores

STATE = "path string, kind string, fp string, length long, mtime timestamp, perms int, target string, error string"


def row(path, fp="x", kind="file", length=1, mtime="2024-01-01", perms=0o644, target=None, error=None):
    return path, kind, fp, length, mtime, perms, target, error


def listing(spark, *rows):
    df = spark.createDataFrame([list(r) for r in rows] or [], STATE.replace("mtime timestamp", "mtime string"))
    return df.withColumn("mtime", F.col("mtime").cast("timestamp"))


# What one side looks like against a base file "b" at 2024-01-01, per state.
SIDES = {
    "same": ("b", {}), "edit1": ("e1", {"length": 2}), "edit2": ("e2", {"length": 3}),
    "touch": ("b", {"perms": 0o600}), "gone": None,
    "link": (None, {"kind": "symlink", "target": "t", "length": 0}),
    "dir": (None, {"kind": "directory", "length": 0}), "bad": ("b", {"error": "read error"}),
}
STATUS = {"same": "unchanged", "edit1": "modified", "edit2": "modified", "touch": "propsChanged",
          "gone": "deleted", "link": "modified", "dir": "modified", "bad": "error"}


def expected(l, r):
    if "bad" in (l, r):
        return S.PROBLEM, None
    if l == r == "same":
        return None, None
    if r == "same":
        return S.L2R, None
    if l == "same":
        return S.R2L, None
    if l == r:
        return S.EQUAL, None
    files = ("edit1", "edit2", "touch")
    if "gone" in (l, r):
        return S.CONFLICT, "deleted on one side, modified on other"
    if l in files and r in files:
        return S.CONFLICT, "file changed on both sides"
    return S.CONFLICT, "type changed on both sides"


def test_decision_table(spark):
    base, left, right = [], [], []
    for l, r in itertools.product(SIDES, SIDES):
        path = f"{l}-{r}"
        base.append(row(path, "b"))
        for rows, s in ((left, l), (right, r)):
            if SIDES[s]:
                rows.append(row(path, SIDES[s][0], **SIDES[s][1]))
    plan = make_plan(listing(spark, *left), listing(spark, *right), listing(spark, *base), JobConfig())
    got = {x["path"]: x for x in plan.select("path", "direction", "reason", R.status("left").alias("l"), R.status("right").alias("r")).collect()}
    for l, r in itertools.product(SIDES, SIDES):
        direction, reason = expected(l, r)
        x = got.get(f"{l}-{r}")
        assert (x["direction"], x["reason"]) == (direction, reason) if direction else x is None, (l, r, x)
        if direction:
            assert (x["l"], x["r"]) == (STATUS[l], STATUS[r])


def test_fast_check_and_fat(spark):
    base = listing(spark, row("a", "1"), row("b", "1"), row("c", "1"))
    cur = listing(spark, row("a", "2"), row("b", "1", mtime="2024-01-01 00:00:02"), row("c", "1", mtime="2024-01-01 00:00:03"))
    status = lambda cfg: [r["status"] for r in classify(cur, base, ["path"], cfg).orderBy("path").collect()]
    assert status(UpdateConfig()) == ["unchanged", "propsChanged", "propsChanged"]
    assert status(UpdateConfig(use_fast_check=False)) == ["modified", "propsChanged", "propsChanged"]
    assert status(UpdateConfig(fat_tolerance=True)) == ["unchanged", "unchanged", "propsChanged"]
    assert status(UpdateConfig(compare_times=False)) == ["unchanged"] * 3


# Every combination of the policy switches on every kind of plan row, against
# the rules written down once more in plain Python.
def _policy_rows():
    for d, (l, r) in itertools.product((S.L2R, S.R2L, S.CONFLICT, S.EQUAL, S.PROBLEM),
                                       (("deleted", "unchanged"), ("created", "modified"), ("modified", "deleted"), ("modified", "created"))):
        yield d, l, r


def _policy(d, l, r, cfg, newer):
    if d in (S.EQUAL, S.PROBLEM):
        return d
    if cfg.force:
        return S.L2R if cfg.force == "left" else S.R2L
    if d == S.CONFLICT and cfg.prefer:
        return S.L2R if cfg.prefer == "left" else S.R2L
    if d == S.CONFLICT and cfg.prefer_newer and "deleted" not in (l, r):
        return newer or d
    source = {S.L2R: l, S.R2L: r}.get(d)
    for flag, status in ((cfg.no_deletion, "deleted"), (cfg.no_creation, "created"), (cfg.no_update, "modified")):
        if flag and source == status:
            return S.CONFLICT
    return d


@pytest.mark.parametrize("newer", [S.L2R, S.R2L, None])
def test_policy_switches(spark, newer):
    times = {S.L2R: (2, 1), S.R2L: (1, 2), None: (1, 1)}[newer]
    side = lambda s, t: F.struct(
        F.col(s).alias("status"), F.when(F.col(s) == "deleted", "absent").otherwise("file").alias("kind"),
        F.struct(F.timestamp_seconds(F.lit(t)).alias("mtime")).alias("props"))
    rows = list(_policy_rows())
    plan = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "k int, direction string, ls string, rs string").select(
        "k", "direction", F.lit("why").alias("reason"), side("ls", times[0]).alias("left"), side("rs", times[1]).alias("right"))
    cfgs = [PlanConfig(force=force, prefer=prefer, prefer_newer=nw, no_deletion=nd, no_creation=nc, no_update=nu)
            for force, prefer, nw, nd, nc, nu in itertools.product((None, "left", "right"), (None, "right"), *[(False, True)] * 4)]
    decided = plan.select("k", *[R.policy(["k"], c)[0].alias(f"c{i}") for i, c in enumerate(cfgs)])
    for x in decided.collect():
        d, l, r = rows[x["k"]]
        for i, cfg in enumerate(cfgs):
            assert x[f"c{i}"] == _policy(d, l, r, cfg, newer), (rows[x["k"]], cfg)


def two_sides(spark):
    base = listing(spark, row("keep"), row("del"), row("clash"), row("touch"))
    left = listing(spark, row("keep"), row("clash", "L", length=2), row("touch", perms=0o600), row("new", "n"))
    right = listing(spark, row("keep"), row("del"), row("clash", "R", length=3), row("touch"), row("other", "o"))
    return left, right, base


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("path", "fp", "perms"))).collect())


def test_cycle_and_laws(spark):
    left, right, base = two_sides(spark)
    out = sync(left, right, base, JobConfig())
    assert rows_of(out.left) == [("clash", "L", 0o644), ("keep", "x", 0o644), ("new", "n", 0o644), ("other", "o", 0o644), ("touch", "x", 0o600)]
    assert rows_of(out.right) == [("clash", "R", 0o644), ("keep", "x", 0o644), ("new", "n", 0o644), ("other", "o", 0o644), ("touch", "x", 0o600)]
    assert rows_of(out.base, "path", "fp") == [("clash", "x"), ("keep", "x"), ("new", "n"), ("other", "o"), ("touch", "x")]
    again = sync(out.left, out.right, out.base, JobConfig())
    assert rows_of(again.plan, "path", "direction") == [("clash", S.CONFLICT)]
    done = sync(out.left, out.right, out.base, JobConfig(plan=PlanConfig(prefer="right")))
    assert A.replicas_equal(done.left, done.right, ["path"]).first()["equal"]
    assert make_plan(done.left, done.right, done.base, JobConfig()).isEmpty()


def test_swapping_sides_mirrors_directions(spark):
    left, right, base = two_sides(spark)
    flip = {S.L2R: S.R2L, S.R2L: S.L2R}
    a = rows_of(make_plan(left, right, base, JobConfig()), "path", "direction")
    b = rows_of(make_plan(right, left, base, JobConfig()), "path", "direction")
    assert b == [(p, flip.get(d, d)) for p, d in a]


def test_dry_run_edit_commit(spark):
    from concordat.operators.edits import edit_plan
    left, right, base = two_sides(spark)
    plan = dry_run(left, right, base, JobConfig())
    edits = spark.createDataFrame([("clash", "r2l"), ("new", "conflict")], "path string, direction string")
    out = commit(left, right, base, edit_plan(plan, edits, ["path"]), JobConfig())
    assert ("clash", "R", 0o644) in rows_of(out.left) and ("new", "n", 0o644) not in rows_of(out.right)


def test_failures_and_budget(spark):
    left, right, base = two_sides(spark)
    plan = dry_run(left, right, base, JobConfig())
    fail = spark.createDataFrame([("del", "disk full"), ("new", "disk full")], "path string, message string")
    cfg = JobConfig(apply=ApplyConfig(max_errors=0))
    out = commit(left, right, base, plan, cfg, failures=fail)
    assert rows_of(out.results, "path", "outcome", "detail") == [
        ("clash", "skipped", "Conflict: file changed on both sides"), ("del", "error", "disk full"),
        ("new", "skipped", "Aborted: error limit reached"), ("other", "skipped", "Aborted: error limit reached"),
        ("touch", "skipped", "Aborted: error limit reached")]
    assert rows_of(out.base, "path", "fp") == rows_of(base, "path", "fp")


def test_guards(spark):
    left, right, base = two_sides(spark)
    empty = left.where("false")
    with pytest.raises(G.Refused):
        sync(left, empty, base, JobConfig())
    few = left.where("path = 'keep'")
    with pytest.raises(G.Refused):
        sync(few, base, base, JobConfig(max_delete_fraction=0.5))
    assert not G.may_save_base({"error": 2}) and not G.may_save_base({"skipped": 1})
    assert G.may_save_base({"success": 1, "error": 3}) and G.may_save_base({"skipped": 2})


def test_key_checks(spark):
    with pytest.raises(KeyViolation, match="1 null rows, 1 keys"):
        check_keys(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "path string"), ["path"])


def test_ignored_base_rows_stay(spark):
    left, right, base = two_sides(spark)
    out = sync(left, right, base, JobConfig(ignore=("Name del", "Name clash")))
    assert ("del", "x") in rows_of(out.base, "path", "fp") and out.plan.where("path in ('del','clash')").isEmpty()
    assert ("del", "x", 0o644) in rows_of(out.right)


def test_merge_and_rules(spark):
    assert parse_rule("Name *.txt -> longest") == ("Name *.txt", "longest")
    assert parse_rule("-> x") is None and parse_rule("Name x ->") is None and parse_rule("Name x") is None
    t = lambda *rows: spark.createDataFrame(list(rows), "path string, a int, b string")
    base, left, right = t(("k", 1, "x"), ("m", 1, "x")), t(("k", 2, "x"), ("m", 2, "long")), t(("k", 1, "y"), ("m", 3, "longer"))
    out = {r["path"]: r for r in three_way_merge(base, left, right, ["path"], ["a", "b"], rules=["Name zz -> left"]).collect()}
    assert (out["k"]["a"], out["k"]["b"], out["k"]["clean"]) == (2, "y", True)
    assert (out["m"]["clean"], out["m"]["conflict_columns"]) == (False, ["a", "b"])
    forced = three_way_merge(base, left, right, ["path"], ["a", "b"], rules=["Name m -> longest"]).where("path = 'm'").first()
    assert (forced["b"], forced["clean"]) == ("longer", True)


def test_force_mode(spark):
    left, right, base = two_sides(spark)
    restore = sync(left, right, base, JobConfig(plan=PlanConfig(force="left")))
    assert A.replicas_equal(restore.left, restore.right, ["path"]).first()["equal"]
    skip = sync(left, right, base, JobConfig(plan=PlanConfig(force="left"), apply=ApplyConfig(force_mode="skip")))
    assert ("other", "skipped", "Unchanged") in rows_of(skip.results, "path", "outcome", "detail")
    assert ("other", "o", 0o644) in rows_of(skip.right)


def test_replicas_that_ignore_case(spark):
    from concordat.functions.paths import with_path_columns
    keyed = lambda *rows: with_path_columns(listing(spark, *rows), mode="insensitive").select(
        "path_key", "path", "kind", "fp", "length", "mtime", "perms")
    base = keyed(row("Docs/A.txt"), row("b"))
    out = sync(keyed(row("docs/a.TXT", "new", length=5), row("b")), keyed(row("Docs/A.txt"), row("B")), base, JobConfig(keys=("path_key",)))
    assert rows_of(out.plan, "path_key", "direction") == [("docs/a.txt", S.L2R)]
    assert rows_of(out.right, "path", "fp") == [("B", "x"), ("docs/a.TXT", "new")]


def test_followed_links_and_atomic_directories(spark):
    base = listing(spark, row("target", "t"), row("pkg/a", "1"), row("pkg/b", "1"), row("free", "1"))
    left = listing(spark, row("target", "t2", length=4), row("ln", None, "symlink", 0, target="target"),
                   row("pkg/a", "L", length=2), row("pkg/b", "2", length=2), row("free", "2", length=2))
    right = listing(spark, row("target", "t"), row("pkg/a", "R", length=3), row("pkg/b", "1"), row("free", "1"))
    plan = make_plan(left, right, base, JobConfig(follow=("Name ln",), plan=PlanConfig(atomic=("Path pkg",))))
    got = {r["path"]: r for r in plan.collect()}
    assert got["ln"]["left"]["kind"] == "file" and got["ln"]["left"]["fp"] == "t2"
    assert {p: got[p]["direction"] for p in ("pkg/a", "pkg/b", "free")} == {"pkg/a": S.CONFLICT, "pkg/b": S.CONFLICT, "free": S.L2R}
    assert got["pkg/b"]["reason"] == "conflict inside atomic directory"


def test_forced_deletions_are_guarded_and_kept(spark):
    base = listing(spark, row("a"))
    left, right = base, listing(spark, row("a"), row("n1"), row("n2"))
    cfg = JobConfig(plan=PlanConfig(force="left"), max_delete_fraction=0.5, backup=BackupConfig())
    with pytest.raises(G.Refused):
        sync(left, right, base, cfg)
    out = sync(left, right, base, replace(cfg, max_delete_fraction=None))
    assert rows_of(out.backups, "path", "side") == [("n1", "right"), ("n2", "right")]
    assert rows_of(out.right, "path") == [("a",)]


def test_followed_link_goes_over_once(spark):
    base = listing(spark, row("target", "t"))
    left = listing(spark, row("target", "t"), row("ln", None, "symlink", 0, target="target"),
                   row("out", None, "symlink", 0, target="../elsewhere"))
    cfg = JobConfig(follow=("Name ln", "Name out"))
    out = sync(left, base, base, cfg)
    assert rows_of(out.right, "path", "kind", "fp") == [("ln", "file", "t"), ("out", "symlink", None), ("target", "file", "t")]
    assert make_plan(left, out.right, out.base, cfg).isEmpty()


def test_newer_and_own_merge_strategies(spark):
    make = lambda a, t: spark.createDataFrame([("k", a, t)], "id string, a string, mtime string").select(
        "id", "a", F.col("mtime").cast("timestamp").alias("mtime"))
    base, left, right = (snapshot_table(make(*x), ["id"], ["a"], "mtime") for x in
                         (("o", "2024-01-01"), ("l", "2024-01-02"), ("r", "2024-01-03")))
    for rule, want in (("newer", "r"), ("both", "l+r")):
        cfg = JobConfig(keys=("id",), plan=PlanConfig(merge=("Regex .*",), merge_rules=(f"Regex .* -> {rule}",), merge_mtime="mtime",
                                                     merge_strategies={"both": lambda b, l, r: F.concat(l, F.lit("+"), r)}))
        out = sync(left, right, base, cfg, merge_values=["a"])
        assert [r["a"] for r in out.left.collect()] == [r["a"] for r in out.right.collect()] == [want]
        fps = {r["fp"] for t in (out.left, out.right, out.base) for r in t.collect()}
        assert fps == {r["fp"] for r in snapshot_table(out.left.select("id", "a"), ["id"]).collect()}


def test_unreadable_base_is_empty_and_lost_race_is_told(spark, tmp_path):
    store = stores.VersionedStore(spark, str(tmp_path))
    df = listing(spark, row("a"))
    store.save("p", df)
    for f in (tmp_path / "data" / "p").rglob("*.parquet"):
        f.write_bytes(b"broken")
    assert store.load("p", df.schema).collect() == []
    first = store._seqs(["p"])
    store._point({"p": "aaaa"}, first)
    with pytest.raises(stores.LostRace):
        store._point({"p": "bbbb"}, first)
    assert store._current("p")["version"] == "aaaa"
