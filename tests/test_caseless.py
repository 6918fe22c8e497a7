from concordat.config import JobConfig
from concordat.plans.caseless import sync_ignoring_case
from tests.test_plan import listing, row, rows_of


def test_names_stay_as_each_side_spells_them(spark):
    d = lambda p: row(p, None, "directory")
    base = listing(spark, d("docs"), row("docs/a"), row("docs/b"), row("x"))
    left = listing(spark, d("docs"), row("docs/a", "new", length=9), row("docs/b"), d("docs/Sub"), row("docs/Sub/File"), row("X"), row("c"), row("C"))
    right = listing(spark, d("Docs"), row("Docs/A"), row("x"), row("c", "other"))
    out = sync_ignoring_case(left, right, base, JobConfig(), "sensitive", "insensitive")
    assert rows_of(out.right, "path", "fp") == [
        ("Docs", None), ("Docs/A", "new"), ("Docs/Sub", None), ("Docs/Sub/File", "x"), ("c", "other"), ("x", "x")]
    assert rows_of(out.left, "path") == [(p,) for p in ("C", "X", "c", "docs", "docs/Sub", "docs/Sub/File", "docs/a")]
    assert rows_of(out.base, "path") == [(p,) for p in ("docs", "docs/Sub", "docs/Sub/File", "docs/a", "x")]
    assert rows_of(out.collisions, "side", "path") == [("left", "C"), ("left", "c"), ("right", "c")]
    again = sync_ignoring_case(out.left, out.right, out.base, JobConfig(), "sensitive", "insensitive")
    assert again.cycle.plan.count() == 0


def test_without_collisions_nothing_is_left_out(spark):
    same = listing(spark, row("É"), row("b"))
    out = sync_ignoring_case(same, listing(spark, row("é"), row("B")), same, JobConfig(), "unicode", "insensitive")
    assert out.collisions.count() == 0 and out.cycle.plan.count() == 0
    assert rows_of(out.right, "path") == [("B",), ("é",)]
