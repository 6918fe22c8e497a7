"""Near-duplicate lines and documents against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from concordat.llm import jaccard, lines, queries
from concordat.llm.components import components
from tests.llm.data import documents, frame, words

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, n):
    w = split(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def brute_components(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations([i for i, (d, _) in enumerate(rows) if d is not None and sets[i]], 2):
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            up[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_links(spark, tmp_path, n, num, den):
    docs, rows = documents(spark, tmp_path / "d", seed=n)
    got = jaccard.link_sets(docs, words=n, threshold=(num, den)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_components(rows, n, num, den)))


def test_failed_buckets_and_shared_passages(spark, tmp_path):
    """Many documents of one passage and a few own words: they share segments but
    few are linked, so the one-deletion neighbourhoods must find the links."""
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = []
    for i in range(140):
        own = words(rng, rng.choice([2, 3, 6, 9, 14]), 40)
        at = rng.randrange(50)
        rows.append((i, " ".join(passage[:at] + own + passage[at:])))
        if i % 3 == 0:
            v = rows[-1][1].split()
            v[rng.randrange(len(v))] = "x"
            rows.append((1000 + i, " ".join(v)))
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for n, num, den in ((1, 90, 100), (3, 80, 100), (2, 70, 100)):
        got = jaccard.link_sets(docs, words=n, threshold=(num, den)).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute_components(rows, n, num, den))


def test_pigeonhole():
    """Linked sets share a used segment, or one of their neighbourhoods does."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(rng.integers(0, size // 10 + 1))
        b = np.unique(np.append(a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        keys = []
        for s in (a, b):
            keys.append({int(k) for band, r, _, n, total, _ in jaccard.segments(s, 9, 10)
                         for k in jaccard.key_of(band, *(lambda u, t: (u, t[u]))(np.flatnonzero(n) if (n == 0).sum() <= r else np.arange(len(n)), total))})
        assert keys[0] & keys[1] or len(a) < 10


def test_chance_buckets_need_no_neighbourhoods(spark, tmp_path, monkeypatch):
    """Phrases that many documents quote make buckets of several components, but
    a linked set would share more segments than these."""
    asked, real = [], jaccard.neighbourhoods
    monkeypatch.setattr(jaccard, "neighbourhoods", lambda affected, *rest: asked.append(affected.count()) or real(affected, *rest))
    rng = random.Random(3)
    phrases = [words(rng, 5) for _ in range(4)]
    rows = []
    for i in range(60):
        w = words(rng, 80, 10**9)
        for phrase in phrases:
            at = rng.randrange(len(w))
            w[at:at] = phrase
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[rng.randrange(len(w))] = "x"
            rows.append((1000 + i, " ".join(w)))
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    got = jaccard.link_sets(spark.read.parquet(str(tmp_path / "d")), words=5, threshold=(80, 100)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 5, 80, 100))
    assert not asked


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sets_share_more_segments_than_have_room(num, den):
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(10, 500))).astype(np.uint64))
        b = np.unique(np.append(a[int(rng.integers(0, len(a) // 5 + 1)):], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 10 + 1))).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if den * both < num * (len(a) + len(b) - both) or not both:
            continue
        keys = [{int(k) for band, _, _, n, total, _ in jaccard.segments(s, num, den) for k in jaccard.key_of(band, np.flatnonzero(n), total[n > 0])} for s in (a, b)]
        if all(keys):
            assert len(keys[0] & keys[1]) > max(jaccard.room(a, num, den), jaccard.room(b, num, den))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.append(a[int(rng.integers(0, len(a))):], rng.integers(0, 2**63, int(rng.integers(0, 500))).astype(np.uint64)))
        assert jaccard.bits_apart(jaccard.wide_sketch(a), jaccard.wide_sketch(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (100, 50), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((50, 98, 99, 100), 50)}
    assert components(edges.limit(0)).collect() == []


def test_components_take_few_tasks(spark):
    """Small tables aren't cut into one file for each of many shuffle partitions."""
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(380)]
    up = {}
    for a, b in pairs:
        group = up.get(a, {a}) | up.get(b, {b})
        up.update(dict.fromkeys(group, group))
    ends = sorted({x for a, b in pairs if a != b for x in (a, b)})
    conf = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame(pairs, "a long, b long"))
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, found.collect())) == [(x, min(up[x])) for x in ends]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_records(spark):
    """Nodes may be records, and null fields come first."""
    node = "struct<id: string, t: long>"
    rows = [((None, 3), ("a", 1)), (("a", 1), ("é", 2)), (("z", 1), ("\U0001f600", 1)), (("x", None), ("x", 0))]
    got = {tuple(r["node"]): tuple(r["component"]) for r in components(spark.createDataFrame(rows, f"a {node}, b {node}")).collect()}
    assert got == {**dict.fromkeys([(None, 3), ("a", 1), ("é", 2)], (None, 3)),
                   **dict.fromkeys([("z", 1), ("\U0001f600", 1)], ("z", 1)), **dict.fromkeys([("x", None), ("x", 0)], ("x", None))}


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_lines(rows, min_words):
    """Texts after the removal, by comparing each line with all earlier ones."""
    by_id = {}
    for d, t in rows:
        if d is not None and t is not None:
            by_id.setdefault(d, []).append(t)
    earlier, gone = [], {}
    for d in sorted(by_id):
        for i, line in enumerate(by_id[d][0].split("\n")):
            w = split(line)
            if len(w) < min_words:
                continue
            if any(edit_at_most_one(w, e) for e in earlier):
                gone.setdefault(d, set()).add(i)
            earlier.append(w)
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in rows]


def test_lines_take_texts_apart_in_slices(monkeypatch):
    """A batch of any size is taken apart some texts at a time, and none is lost."""
    seen, real = [], lines.Lines
    monkeypatch.setattr(lines, "Lines", lambda text, n: seen.append(sum(map(len, text.to_pylist()))) or real(text, n))
    one = " ".join(f"w{i}" for i in range(3000))
    n = 4 * lines.SLICE_BYTES // len(one)
    batch = pa.RecordBatch.from_pydict({"doc": list(range(n)), "text": [f"{one} {i}" for i in range(n)]})
    most = lines.SLICE_BYTES + len(one) + 9
    assert len({d for b in lines._scan(None)([batch]) for d in b.column("doc").to_pylist()}) == n
    packed = pa.Table.from_batches(lines._pack([batch])).combine_chunks().to_batches()[0]
    wanted = pa.array([[{"line": 0, "sides": 1}]] * n, pa.list_(pa.struct([("line", pa.int32()), ("sides", pa.int32())])))
    found = list(lines._variants(None)([packed.append_column("wanted", wanted)]))
    assert {d for b in found for d in b.column("doc").to_pylist()} == set(range(n))
    assert max(seen) <= most
    cut = list(lines._cut("text", ["doc", "text", "n_lines", "n_dropped"])([packed.append_column("gone", pa.nulls(n, pa.list_(pa.int32())))]))
    assert [t for b in cut for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(b.column("text").nbytes for b in cut) <= 2 * most


def test_keys_of_a_batch_are_ordered_in_parts(monkeypatch):
    """However many keys a batch has, few are held at once, and none is lost."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = list(jaccard._keyed([batch], "text", 3, 90, 100))
    monkeypatch.setattr(jaccard, "BATCH_KEYS", 40)
    parts = list(jaccard._keyed([batch], "text", 3, 90, 100))
    flat = lambda found: [k for keys, _, _ in found for x in keys for k in x.tolist()]
    assert len(whole) == 1 and len(parts) >= 10 and flat(parts) == flat(whole)
    assert [c for _, _, seen in parts for c in seen] == list(whole[0][2])


@pytest.mark.parametrize("min_words", [4, 8])
def test_lines(spark, tmp_path, min_words):
    docs, rows = documents(spark, tmp_path / "d", seed=3)
    got = lines.dedup_lines(docs, min_words=min_words)
    assert got.columns == [c for c in docs.columns if c not in ("text", "packed")] + ["text", "n_lines", "n_dropped"]
    want = brute_lines(rows, min_words)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    assert any(a != b for a, b in zip(rows, want, strict=True))


def near_at_any_length(a, b):
    if min(len(a), len(b)) >= lines.MIN_WORDS:
        return edit_at_most_one(a, b)
    a, b = " ".join(a), " ".join(b)
    return a == b or min(len(a), len(b)) >= lines.MIN_CHARACTERS and edit_at_most_one(a, b)


def brute_all_lines(rows):
    """``brute_lines`` without a limit: every line with a word takes part."""
    by_id = {}
    for d, t in rows:
        if d is not None and t is not None:
            by_id.setdefault(d, t)
    earlier, gone = [], {}
    for d in sorted(by_id):
        for i, line in enumerate(by_id[d].split("\n")):
            if w := split(line):
                if any(near_at_any_length(w, e) for e in earlier):
                    gone.setdefault(d, set()).add(i)
                earlier.append(w)
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in rows]


def test_short_and_unspaced_lines(spark, tmp_path):
    rng = random.Random(11)
    short = ["And.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "再配布は次の条件を満たす場合に限り許可されます以上です", "短い行",
             "one two three four five six seven", "aa bb cc dd ee ff gg hh", "𝒳é𝒳é𝒳é𝒳é𝒳é𝒳é𝒳é𝒳é", "จำนวนบรรทัดที่ไม่มีช่องว่างเลยแม้แต่น้อย", "x" * 400]
    rows = []
    for d in range(120):
        picked = []
        for _ in range(rng.randrange(1, 7)):
            c = list(rng.choice(short) if rng.random() < 0.8 else " ".join(words(rng, rng.randrange(1, 9), 3)))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(c))
                c[i:i + rng.randrange(2)] = rng.choice(["", " ", "z", "é", "行", "A", "\t "])
            picked.append(rng.choice(["", "  "]) + "".join(c) + rng.choice(["", " \r", " "]))
        rows.append((d, "\n".join(picked)))
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    got = lines.dedup_lines(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(brute_all_lines(rows))
    docs, rows = documents(spark, tmp_path / "e", seed=3)
    got = lines.dedup_lines(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, brute_all_lines(rows)))


def test_every_line_of_the_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op3_line_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(brute_all_lines(rows))


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "e"))
    docs = spark.read.parquet(str(tmp_path / "e"))
    assert lines.dedup_lines(docs).collect() == []
    assert jaccard.link_sets(docs).collect() == []


def test_queries(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_jaccard_join(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(rows, 3, 90, 100))
    got = queries.op3_line_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(brute_all_lines(rows))


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars, or become stars in one round, aren't gone over again."""
    from concordat.llm import components as C

    written, plain = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: written.append(label) or plain(df, label))
    assert {tuple(r) for r in components(spark.createDataFrame([(2, 1), (1, 3), (8, 9), (1, 2)], "a long, b long")).collect()} == {
        (1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert written == ["edges"]
    written.clear()
    assert {tuple(r) for r in components(spark.createDataFrame([(2, 1), (2, 3)], "a long, b long")).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert written == ["edges", "large_star", "small_star"]
