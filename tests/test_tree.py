"""No entry ends up outside a directory, whatever changed and whatever the options."""

import random

import pytest
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.config import JobConfig, PlanConfig
from concordat.operators import guards as G
from concordat.operators.tree import NOT_EMPTY, orphans
from concordat.operators.updates import apply_updates, detect_updates
from concordat.plans.cycle import dry_run, make_plan, sync
from tests.test_plan import listing, row

NAMES = ["a", "b", "c"]


def grow(rng, tree, path, depth):
    """A random tree below ``path``: path -> content, None for directories."""
    for name in NAMES:
        if rng.random() < 0.6:
            at = f"{path}/{name}"
            if depth and rng.random() < 0.5:
                tree[at] = None
                grow(rng, tree, at, depth - 1)
            else:
                tree[at] = rng.choice("xyz")


def cut(tree, path):
    return {p: v for p, v in tree.items() if p != path and not p.startswith(path + "/")}


def edited(rng, tree, top):
    tree = dict(tree)
    for _ in range(rng.randrange(0, 4)):
        inner = [p for p in tree if p != top]
        kind = rng.randrange(5)
        if inner and kind < 4:
            p = rng.choice(inner)
            was = tree[p]
            tree = cut(tree, p)
            if kind == 1:
                tree[p] = rng.choice("uvw")
            elif kind == 2 or (kind == 3 and was is not None):
                tree[p] = None
                grow(rng, tree, p, 1)
        else:
            home = rng.choice([p for p, v in tree.items() if v is None])
            tree.setdefault(f"{home}/{rng.choice(NAMES)}", rng.choice("uvw"))
    return tree


def forests(seed, n=150):
    """Base, left and right with many small trees side by side."""
    rng, out = random.Random(seed), ({}, {}, {})
    for i in range(n):
        top = f"t{i}"
        base = {top: None}
        grow(rng, base, top, 2)
        for all_, one in zip(out, (base, edited(rng, base, top), edited(rng, base, top)), strict=True):
            all_.update(one)
    return out


def frame(spark, tree):
    return listing(spark, *(row(p, v, "directory" if v is None else "file") for p, v in tree.items()))


def read(df):
    return {r["path"]: (r["kind"], r["fp"]) for r in df.collect()}


def loose(tree):
    return [p for p in tree if "/" in p and tree.get(p.rsplit("/", 1)[0], (None,))[0] != "directory"]


CONFIGS = {
    "plain": JobConfig(),
    "ignore": JobConfig(ignore=("Name c",)),
    "policies": JobConfig(plan=PlanConfig(no_deletion=True, prefer_partial=(("Name a", "left"), ("Name b", "right")))),
    "selected": JobConfig(plan=PlanConfig(force_partial=(("Name b", "left"),), no_creation=True), paths=("t1", "t2/a", "t3/a/b", "t4", "t5/b")),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_no_orphans(spark, name):
    trees = forests(len(name))
    base, left, right = (frame(spark, t) for t in trees)
    out = sync(left, right, base, CONFIGS[name])
    new_left, new_right, new_base = read(out.left), read(out.right), read(out.base)
    assert loose(new_left) == [] and loose(new_right) == [] and loose(new_base) == []
    assert orphans(out.left).count() == 0
    done = out.results.collect()
    for r in done:
        if r["outcome"] == "success":
            assert new_left.get(r["path"]) == new_right.get(r["path"]) == new_base.get(r["path"]), r
    planned = {r["path"] for r in out.plan.collect()}
    rest = lambda t: {p: v for p, v in t.items() if p not in planned}
    assert rest(new_left) == rest(read(left)) and rest(new_right) == rest(read(right))
    assert rest(new_base).items() <= rest(read(base)).items()


def test_disputes_cover_subtrees(spark):
    d, f = (lambda p: row(p, None, "directory")), row
    base = listing(spark, d("d"), f("d/a"), d("e"), f("e/a"), f("x"))
    left = listing(spark, f("d", "now a file"), f("x", "edited", length=9), d("e"), f("e/a"), f("n", "file"))
    right = listing(spark, d("d"), f("d/a", "edited", length=9), f("d/new"), d("x"), f("x/y"), d("e"), f("e/a"), f("e/b"), d("n"), f("n/z"))
    plan = {r["path"]: (r["direction"], r["reason"]) for r in make_plan(left, right, base, JobConfig()).collect()}
    gone, kinds = "deleted on one side, modified on other", "type changed on both sides"
    assert plan == {"d": (S.CONFLICT, gone), "d/a": (S.CONFLICT, gone), "d/new": (S.CONFLICT, gone), "x": (S.CONFLICT, kinds),
                    "x/y": (S.CONFLICT, kinds), "n": (S.CONFLICT, kinds), "n/z": (S.CONFLICT, kinds), "e/b": (S.R2L, None)}


def test_below_unreadable_directories(spark):
    d, f = (lambda p, **k: row(p, None, "directory", **k)), row
    base = listing(spark, d("d"), f("d/a"), f("x"))
    left = listing(spark, d("d", error="denied"), f("x"))
    right = listing(spark, d("d"), f("d/a"), f("d/new"), f("x", "edited", length=9))
    plan = {r["path"]: r["direction"] for r in make_plan(left, right, base, JobConfig()).collect()}
    assert plan == {"d": S.PROBLEM, "d/a": S.PROBLEM, "d/new": S.PROBLEM, "x": S.R2L}
    nothing = listing(spark, d("", error="denied"))
    plan = make_plan(nothing, right, base, JobConfig()).collect()
    assert {r["path"]: r["direction"] for r in plan} == dict.fromkeys(["", "d", "d/a", "d/new", "x"], S.PROBLEM)
    with pytest.raises(G.Refused):
        dry_run(nothing, right, base, JobConfig())


def test_ignored_children_keep_their_directory(spark):
    d, f = (lambda p: row(p, None, "directory")), row
    base = listing(spark, d("d"), f("d/a"), d("d/sub"), f("d/sub/skip"), f("d/sub/b"))
    out = sync(listing(spark, f("other")), base, base, JobConfig(ignore=("Name skip",), max_delete_fraction=None))
    assert sorted(read(out.right)) == ["d", "d/sub", "d/sub/skip", "other"]
    assert {r["path"] for r in out.results.where(F.col("detail") == NOT_EMPTY).collect()} == {"d", "d/sub"}


def test_flat_stores_need_no_directories(spark):
    out = sync(listing(spark, row("a/b/c")), listing(spark), listing(spark), JobConfig())
    assert sorted(read(out.right)) == ["a/b/c"]


def test_base_payload_stays(spark):
    base = listing(spark, row("a"), row("b")).withColumns({"note": F.concat(F.lit("note "), "path"), "n": F.lit(1)})
    now = listing(spark, row("a", "new", length=9), row("c"))
    out = apply_updates(base, detect_updates(now, base, ["path"]), ["path"])
    assert out.columns == base.columns
    got = {r["path"]: (r["fp"], r["note"], r["n"]) for r in out.collect()}
    assert got == {"a": ("new", "note a", 1), "c": ("x", None, None)}
