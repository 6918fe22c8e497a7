"""The pipeline on a small table, each stage against brute force on its input."""

import os
import time

import corpus_pipeline as cp
from concordat.llm import queries
from concordat.session import materialize, scratch_dir, scratch_scope
from tests.llm.data import documents
from tests.llm.test_near import brute_all_lines, brute_components


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.materialize(stage(spark, docs, sf), "t")
        assert [c for c in docs.columns if c in columns] == columns, name
        seen[name] = (before, docs)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = seen["language ID"]
    assert set(rows(after)) <= set(rows(before)) and after.count() > 0.95 * before.count()
    before, after = seen["line dedup"]
    want = [(d, t) for (d, t), (_, old) in zip(brute_all_lines(rows(before)), rows(before), strict=True) if t == old or t.strip(" ")]
    assert sorted(rows(after)) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["n-gram Jaccard join"]
    keep = {d for d, _, c in brute_components(rows(before), 5, 80, 100) if d == c}
    assert {d for d, _ in rows(after)} == keep
    before, after = seen["benchmark decontamination"]
    hits = {r["doc"] for r in cp.decontaminate.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {d for d, _ in rows(after)} == {d for d, _ in rows(before)} - hits
    before, after = seen["SentencePiece encoding and decoding"]
    decoded = cp.sentencepieces.decode(after, queries.PIECES).collect()
    assert len(decoded) == before.count() and all(r["decoded"] == r["text"] and r["ids"][-1] == 2 for r in decoded)
    assert after.where("lossless").count() == before.count()
    got = cp.run(spark, sf)
    assert sorted(rows(got)) == sorted(rows(after)) and got.columns == [*columns, "ids", "n_tokens", "lossless"]


def test_rows_with_equal_ids(spark, sf):
    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(0, base), (0, base), (3, base + " more"), (3, other), (None, base), (None, base), (5, None), (6, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component string")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([(0, base), (3, other), (None, base), (None, base), (5, None), (6, ""), (7, None)], key=str)


def test_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "ids")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, None, "s", 0), (2, "x" * 100_000, None, None, None)], docs.schema)
    for rows in (docs.limit(0), odd, odd.unionByName(odd)):
        rows = cp.materialize(rows, "odd")
        for name, stage in cp.STAGES:
            rows = cp.materialize(stage(spark, rows, sf), "t")
            assert set(docs.columns) <= set(rows.columns) | {"ids"}, name


def test_stages_leave_only_what_their_rows_read(spark, sf, tmp_path):
    """Tables in between would stay on disk until the last stage has ended."""
    docs = documents(spark, tmp_path / "d")[0].selectExpr("doc_id", "text", "'en' lang", "'s' source", "char_length(text) n_chars")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    left = lambda: set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    for stage, kept in ((cp.line_dedup, ["gone"]), (cp.near_duplicates, ["copies", "repeats"]), (cp.sentencepiece, ["ids"])):
        before = left()
        found = stage(spark, docs, sf)
        assert sorted(x.rpartition("-")[0] for x in left() - before) == kept
        assert found.count() > 0


def test_results_outlive_their_scope_and_shuffles_go(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for d in disk.localDirs() for _, _, names in os.walk(d.getPath()) for x in names if x.startswith("shuffle_")}
    scratch = lambda: {x.partition("-")[0] for x in os.listdir(scratch_dir(spark).removeprefix("file:"))}
    before = files()
    with scratch_scope(spark):
        with scratch_scope(spark):
            inner = materialize(spark.range(50_000).repartition(3, "id").groupBy("id").count(), "inner")
            kept = materialize(inner.where("id < 10").repartition(2, "id"), "outliving", result=True)
        until = time.time() + 10
        while files() - before and time.time() < until:  # they go in the background
            time.sleep(0.1)
        assert not files() - before
        assert "inner" not in scratch()
        assert kept.count() == 10
    assert "outliving" not in scratch()
