from concordat.config import JobConfig, UpdateConfig
from concordat.operators.snapshots import KeyViolation
from concordat.plans import remote as RM
from tests.test_plan import rows_of

LOCAL = "path string, kind string, fp string, length long, mtime timestamp"
REMOTE = "path string, kind string, etag string, length long, mtime timestamp"


def side(spark, schema, *rows):
    return spark.createDataFrame([(p, "file", mark, size, None) for p, mark, size in rows], schema)


def test_what_is_unknown_is_learnt(spark):
    """Transfers leave the other side's fingerprint open until it is listed again."""
    local = side(spark, LOCAL, ("same", "f1", 3), ("up", "f2", 5))
    remote = side(spark, REMOTE, ("same", "t1", 3), ("down", "t3", 7))
    base = RM.remote_base(local.where("path = 'same'"), remote)
    out = RM.sync_remote(local, remote, base)
    assert rows_of(out.plan, "path", "direction") == [("down", "r2l"), ("up", "l2r")]
    assert rows_of(out.base, "path", "fp", "remote_length") == [("down", None, 7), ("same", "f1", 3), ("up", "f2", 5)]
    tag = {r["path"]: r["remote_fp"] for r in out.base.collect()}
    assert tag["up"] is None and tag["same"] and tag["down"]
    now = (side(spark, LOCAL, ("same", "f1", 3), ("up", "f2", 5), ("down", "f3", 7)),
           side(spark, REMOTE, ("same", "t1", 3), ("up", "t2", 5), ("down", "t3", 7)))
    learnt = RM.learn(out.base, *now)
    assert learnt.where("fp is null or remote_fp is null").count() == 0
    assert RM.plan_remote(*now, learnt).count() == 0


def test_changed_between_transfer_and_listing(spark):
    local = side(spark, LOCAL, ("up", "f2", 5), ("keep", "k", 1))
    remote = side(spark, REMOTE, ("keep", "k", 1))
    base = RM.remote_base(local.where("path = 'keep'"), remote)
    out = RM.sync_remote(local, remote, base)
    now = side(spark, REMOTE, ("up", "t9", 6), ("keep", "k", 1))
    learnt = RM.learn(out.base, local, now)
    assert rows_of(learnt.where("path = 'up'"), "remote_fp", "remote_length") == [(None, 5)]
    assert rows_of(RM.plan_remote(local, now, learnt), "path", "direction") == [("up", "r2l")]


def test_same_size_and_other_tag(spark):
    local = side(spark, LOCAL, ("a", "f", 3), ("b", "g", 4))
    base = RM.remote_base(local, side(spark, REMOTE, ("a", "t1", 3), ("b", "t2", 4)))
    now = side(spark, REMOTE, ("a", "t9", 3), ("b", None, 4))
    plan = RM.plan_remote(local, now, base)
    assert rows_of(plan, "path", "direction") == [("a", "r2l"), ("b", "r2l")]
    assert RM.plan_remote(local, now, base, JobConfig(update=UpdateConfig(trust_size=True))).count() == 0


def test_new_on_both_sides_is_a_conflict(spark):
    local, remote = side(spark, LOCAL, ("a", "f", 3)), side(spark, REMOTE, ("a", "t", 3))
    empty = RM.remote_base(local.limit(0), remote)
    out = RM.sync_remote(local, remote, empty)
    assert rows_of(out.plan, "path", "direction") == [("a", "conflict")]
    assert out.base.count() == 0 and rows_of(out.left, "path", "fp") == [("a", "f")]


def test_repeated_paths_are_refused(spark):
    local = side(spark, LOCAL, ("a", "f", 3), ("a", "g", 3))
    remote = side(spark, REMOTE, ("a", "t", 3))
    base = RM.remote_base(local.limit(0), remote)
    try:
        RM.plan_remote(local, remote, base)
    except KeyViolation:
        return
    raise AssertionError("accepted")
