"""Language labels, decontamination, licenses, fingerprints."""

import hashlib
import math
import random
import re
import textwrap
import tracemalloc
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from concordat.llm import decontaminate, langid, lempelziv, licenses, queries
from tests.llm.data import ODD, documents, frame, words
from tests.oracle import compare, connect


# ---------------------------------------------------------------- language

def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    k, lens = 3, np.array([4, 1, 5, 2])
    e, codes = rng.random((6, k)) + 0.1, rng.integers(0, 6, lens.sum())
    a, start = rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    got = langid._marginals(e.astype(np.float32), codes, lens, a, start)
    at = 0
    for n in lens:
        total, sums = 0.0, np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            p = start[path[0]] * np.prod([e[codes[at + i], y] for i, y in enumerate(path)]) * np.prod([a[x, y] for x, y in pairwise(path)])
            total += p
            for i, y in enumerate(path):
                sums[i, y] += p
        assert np.allclose(got[at:at + n], sums / total, atol=1e-4)
        at += n


def test_training_gradient_pairs():
    rng = np.random.default_rng(1)
    e, a = rng.random((5, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    gamma, pairs = langid._forward_backward(e, a, np.ones(3))
    assert np.allclose(gamma.sum(2), 1) and np.isclose(pairs.sum(), 5 * 3)


def test_labels_held_out(spark, sf):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_switched_text_and_odd_texts(spark, tmp_path, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = queries.language_model(docs)
    english = next(r["text"] for r in docs.where("lang = 'en' and n_chars > 900").orderBy("doc_id").collect()).split()[:60]
    german = next(r["text"] for r in docs.where("lang = 'de' and n_chars > 900").orderBy("doc_id").collect()).split()[:60]
    rows = [*enumerate(ODD), (99, " ".join(english + german)), (None, "the and of"), (99, " ".join(english + german))]
    got = langid.label(frame(spark, rows), model)
    out = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert len(out) == len(rows) - 1 and got.count() == len(rows)
    for t in (None, "", "123 456", "!!! ???", "\n\n"):
        r = next(r for (_, x), r in out.items() if x == t)
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    spans = out[99, " ".join(english + german)]["lang_spans"]
    tags = [s["lang"] for s in spans for _ in range(s["end"] - s["start"])]
    assert len(tags) == 120 and tags[:60].count("en") > 50 and tags[60:].count("de") > 50


def test_nothing_to_learn_from(spark):
    model = langid.fit(frame(spark, [(1, "a b"), (2, None)]))
    assert [r["lang_pred"] for r in langid.label(frame(spark, [(1, "a b")]), model).collect()] == ["und"]
    assert langid.label(frame(spark, []), model).collect() == []


# ---------------------------------------------------------- decontamination

def brute_hits(docs, items, min_score, min_overlap):
    index = decontaminate.Index([(i, t) for i, t in items if t and len(decontaminate._hashes(t))])
    matrix = np.zeros((len(index.ids), len(index.terms)))
    matrix[index.item, np.repeat(np.arange(len(index.terms)), np.diff(index.start))] = index.weight
    out = {}
    for d, t in docs:
        h = decontaminate._hashes(t or "")
        stride = index.window // 2
        for w in range(max(1, -(-len(h) // stride) - 1) if len(h) else 0):
            part = h[w * stride:w * stride + index.window]
            scores = matrix[:, np.isin(index.terms, part)].sum(1)
            for i in np.flatnonzero(scores >= min_score - 1e-12):
                q, a = index.overlap(int(i), part)
                if q >= min_overlap and a >= min_overlap:
                    out[d, index.ids[i]] = max(out.get((d, index.ids[i]), 0), round(min(1.0, scores[i]), 9))
    return out


@pytest.mark.parametrize(("score", "overlap"), [(0.5, 0.5), (0.3, 0.0), (0.15, 0.1)])
def test_wand_finds_all(spark, tmp_path, score, overlap):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(6, 40), 4)) + ". " + " ".join(words(rng, 4, 4)) + ".") for i in range(40)]
    items += [(50, None), (51, ""), (52, "!!!"), (53, items[0][1])]
    rows = [(100 + i, t) for i, t in enumerate(ODD)]
    for i in range(120):
        w = words(rng, rng.randrange(3, 300), 4)
        if i % 3 == 0:
            quoted = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(3)):
                quoted[rng.randrange(len(quoted))] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = quoted
        rows.append((i, " ".join(w)))
    rows.append(rows[-1])
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), min_score=score, min_overlap=overlap)
    found = {(r["doc"], r["item"]): round(r["score"], 9) for r in got.collect()}
    want = brute_hits(rows, items, score, overlap)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want) and want


@pytest.mark.parametrize("shard_words", [10, 150, 1_000_000])
def test_weights_are_those_of_all_items(spark, shard_words):
    """BM25 by its formula, over items of mixed lengths, in any number of shards."""
    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.choice([3, 8, 20, 90, 300]), 3)) + "." for _ in range(30)]
    texts += [texts[0], texts[5]]
    items = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, "?!")], "item_id long, text string").repartition(4)
    bags = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    mean, want = sum(map(len, bags)) / len(bags), {}
    for i, bag in enumerate(bags):
        raw = {}
        for w in set(bag):
            df, tf = sum(w in b for b in bags), bag.count(w)
            raw[w] = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
        want |= {(i, int(decontaminate._hashes(w)[0])): x / sum(raw.values()) for w, x in raw.items()}
    got, n = {}, 0
    for index in decontaminate.shards(items, "item_id", "text", shard_words):
        n += 1
        for t, term in enumerate(index.terms.tolist()):
            for k in range(index.start[t], index.start[t + 1]):
                got[index.ids[index.item[k]], term] = index.weight[k]
    assert n > 1 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_shards_and_clean(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs, items).collect()}
    many = {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs, items, shard_words=200).collect()}
    assert one == many and one
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items, shard_words=200).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in one}
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []
    plain = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    assert plain <= {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, sf).collect()}


# ------------------------------------------------------------------ licenses

def brute_templates(text, threshold):
    out = []
    split = lambda t: [int(x) for x in licenses.hashes(t)]
    for n, line in enumerate((text or "").split("\n")):
        have = set(split(line))
        for label, t in licenses.TEMPLATES:
            want = set(split(t))
            share = len(want & have) / len(want)
            if len(want & have) * threshold[1] >= len(want) * threshold[0]:
                out.append((label, n, round(share, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [(80, 100), (50, 100), (100, 100)])
def test_templates_against_brute_force(spark, tmp_path, threshold):
    rng = random.Random(1)
    rows = list(enumerate(ODD))
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            w = [x for x in w if rng.random() < 0.9] + words(rng, rng.randrange(4))
            rng.shuffle(w)
            lines.append(" ".join(w))
        rows.append((100 + i, "\n".join(lines) + rng.choice(["", "\nCC-BY all\nrights reserved", " General Public License cc by cc by"])))
    rows += [(None, "All Rights Reserved."), rows[30]]
    got = licenses.scan(frame(spark, rows), threshold=threshold).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sorted((x["label"], x["line"], round(x["containment"], 9)) for x in r["templates"]) == brute_templates(r["text"], threshold)
        w = licenses.hashes(r["text"] or "").tolist()
        want = [(k, i) for i in range(len(w)) for k, p in licenses.BASE if w[i:i + len(p.split())] == licenses.hashes(p).tolist()]
        assert r["n_words"] == len(w) and [(x["label"], x["word"]) for x in r["phrases"]] == want
    assert licenses.scan(frame(spark, [])).collect() == []


def test_wrapped_notices(spark, tmp_path):
    """Notices wrapped as in source headers, at any width and place."""
    rng, rows, want = random.Random(4), [], {}
    for i, (label, t) in enumerate(licenses.NOTICES):
        for j, width in enumerate((20, 40, 72, 10_000)):
            body = textwrap.fill(t, width, break_long_words=False).replace("\n", rng.choice(["\n", "\n# ", "\n * ", "\r\n"]))
            rows.append((10 * i + j, " ".join(words(rng, rng.randrange(300))) + f"\n/* {body} */\n" + " ".join(words(rng, 20))))
            want[10 * i + j] = label
    other = {1000: ("Licensed under CC BY 4.0", "cc-by-4.0"), 1001: ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"), 1002: ("Licensed under CC BY-NC-SA 4.0", ""),
             1003: ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
             1004: ("Released under the BSD License", ""), 1005: (" ".join(f"{w} {' '.join(words(rng, 9))}" for w in "released under the mit license".split()), ""), 1006: (None, "")}
    rows += [(k, t) for k, (t, _) in other.items()]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    for k, label in want.items():
        assert (label, 1.0) in {(x["label"], round(x["containment"], 9)) for x in got[k]["notices"]}, k
    assert {k: ",".join({x["label"] for x in got[k]["notices"]}) for k in other} == {k: v for k, (_, v) in other.items()}
    for r in queries.op6_license_scan(spark, str(tmp_path)).collect():
        assert r["doc_id"] not in want or want[r["doc_id"]] in r["labels"].split(",") and r["score"] == 1


def test_labels_are_true(spark, tmp_path):
    """Lines that share words with a template of another license, against SQL."""
    rng = random.Random(7)
    want = {0: ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), 1: ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), 2: ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
            3: ("It was released under the city council's license to the public", ""), 4: ("Released under the MIT License", "mit"),
            5: ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
            6: ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), 7: ("The MIT License (MIT)", "mit"), 8: ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "gpl,gpl-2.0"),
            9: ("GNU LESSER GENERAL PUBLIC LICENSE Version 3", "gpl"), 10: ("CC0 1.0 Universal", "cc0-1.0"), 11: (None, ""), 12: ("", "")}
    rows = [(k, t) for k, (t, _) in want.items()]
    for i in range(150):  # notices torn, shuffled and mixed
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = [x for x in rng.choice(licenses.NOTICES)[1].split() if rng.random() < 0.93] + rng.choices(["NC", "SA", "Lesser", "word", "Affero"], k=rng.randrange(2))
            if rng.random() < 0.3:
                rng.shuffle(w)
            parts.append(textwrap.fill(" ".join(w), rng.choice([30, 70, 1000])))
        rows.append((100 + i, rng.choice(["\n", " ", " ".join(words(rng, 9))]).join(parts)))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["labels"] for r in queries.op6_license_scan(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in want} == {k: v for k, (_, v) in want.items()}
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(queries.op6_license_scan(spark, str(tmp_path)), con, queries.ORACLES["op6_license_scan"]) is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


# -------------------------------------------------------------- fingerprints

def test_parse_and_likeness():
    phrases, left = lempelziv.parse("aababcab", set())
    assert (phrases, left) == (["a", "ab", "abc"], "ab")
    rng = random.Random(0)
    a = " ".join(words(rng, 400))
    fp = lambda t: lempelziv.smallest(lempelziv.hash_phrases(lempelziv.parse(t, set())[0]))
    full = lambda t: set(lempelziv.hash_phrases(lempelziv.parse(t, set())[0]).tolist())
    b = a[: len(a) * 3 // 4] + " ".join(words(rng, 100))
    exact = len(full(a) & full(b)) / len(full(a) | full(b))
    assert abs(lempelziv.likeness(fp(a), fp(b)) - exact) < 0.15
    assert lempelziv.likeness(fp(a), fp(a)) == lempelziv.likeness(fp(""), fp("")) == 1 and lempelziv.likeness(fp(""), fp(a)) == 0
    assert lempelziv.smallest(np.arange(5000, dtype=np.uint32)[::-1]).tolist() == list(range(lempelziv.SIZE))


@pytest.mark.parametrize("nulls", [False, True])
def test_neighbours(spark, tmp_path, nulls):
    docs, rows = documents(spark, tmp_path / "d", nulls=nulls)
    got = lempelziv.with_neighbour(docs, run_rows=7).collect()
    fp = lambda t: lempelziv.smallest(lempelziv.hash_phrases(lempelziv.parse(t, set())[0]))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + n[:k]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), lempelziv.to_text(fp(t)), lempelziv.to_text(fp(edited)),
                     lempelziv.likeness(fp(t), fp(edited)), lempelziv.likeness(fp(t), fp(n))))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_few_rows(spark):
    assert lempelziv.with_neighbour(frame(spark, [])).collect() == []
    one = lempelziv.with_neighbour(frame(spark, [(5, "some text of one document")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert lempelziv.fingerprints(frame(spark, [(1, None), (1, "")])).select("fingerprint").distinct().count() == 1
    only = lempelziv.with_neighbour(frame(spark, [(None, "a"), (None, "b")])).collect()
    assert len(only) == 2


def test_language_features_are_held_for_a_run_of_words():
    rng = np.random.default_rng(1)
    words = pa.array(["".join(w) for w in rng.choice(list("abcdefghijkl"), (60_000, 9))], pa.string())
    weights = rng.normal(size=(langid.BUCKETS, 4)).astype(np.float32)
    none = pa.array([], pa.string())
    feats, per = langid._features(words, none)
    want = langid._sums(weights[feats], per)
    model = langid.Model(["a", "b", "c", "d"], [], weights, np.zeros((4, 4)), np.zeros(4))
    text = " ".join(words.to_pylist())
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
    del feats, per
    tracemalloc.start()
    got = list(langid._label(model, "text", langid.SLICE_BYTES)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000 and got[0].num_rows == 1
    assert (langid._emissions(words, none, weights) == want).all()
