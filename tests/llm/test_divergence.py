"""Source divergence against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from concordat.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [g for g in counts if g[0] == lang]
        whole = sum((counts[g] for g in groups), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = {g: share(counts[g]) for g in groups}, share(whole)
        for g in groups:
            pairs = [(sum(abs(p[g][t] - p[o][t]) for t in kept), o[1]) for o in groups if o != g]
            words = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(*g, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents(seed, n=400):
    rng = random.Random(seed)
    pool = ["the", "The", "ÉTÉ", "été", "don't", "x1y", "日本語", "a b", "word"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", "Ü", None])
        rows.append((" ".join(rng.choices(pool, k=rng.randrange(0, 40))), rng.choice(["en", "en", "de", None]), source))
    return rows + [(None, "en", "silent"), ("", "xx", "empty"), ("1 2 3", "xx", None), rows[0], rows[0], ("z" * 5000 + " " + "end " * 3000, "en", "a")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, *"abcdefg") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n string, a string, b string, "
                               "value string, kept string, total string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


def test_brute_force(spark):
    rows = documents(5)
    assert run(spark, rows, min_docs=20, top=7) == brute(rows, 20, 7)
    assert run(spark, rows, min_docs=20, top=7, block=3) == brute(rows, 20, 7)


def test_no_kept_terms_and_empty(spark):
    rows = documents(6, 20)
    assert run(spark, rows, min_docs=1000) == brute(rows, 1000, 50)
    assert run(spark, []) == []


def test_pieces_of_long_texts(monkeypatch):
    text = ("some wörds, " * 50 + "x" * 300 + " ").encode() * 3
    want = [w for part in divergence.terms(text) for w in part]
    monkeypatch.setattr(divergence, "PIECE", 64)
    got = list(divergence.terms(text))
    assert len(got) > 5 and [w for part in got for w in part] == want


def test_large_counts_are_exact():
    count = np.array([10**10, 3, 10**12], np.int64)
    total, kept = 10**13, 7
    assert divergence.shares(count, total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in count.tolist()]
    a, b = np.array([1, 2, 9]), np.array([2, 4])
    na, nb = np.array([5, 6, 7]), np.array([1, 2])
    assert divergence.sparse_distance(a, na, b, nb, 18, 3, 5) == divergence.sparse_distance(b, nb, a, na, 3, 18, 5)
