"""Prefix tries against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from concordat.llm import prefixtrie


def rebuild(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: tuple(turns.get(c - c % 100, [])[:heads[c]] + own[heads[c]:]) for c, own in turns.items()}


def brute(rows):
    paths = rebuild(rows)
    members, below, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                below[p[:d - 1]].add(p[:d])
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], ends[p]) for p, m in members.items())


def conversations(seed, n=250, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c += rng.choice([0, 0, 400])
        length = rng.randrange(1, longest) if c % 17 else 3 * longest
        for t in range(length):
            text = "same" if c % 3 == 0 and c % 17 else rng.choice(["yes", "no", "", None, "ü😀", "long " * 30])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if c % 5 == 0 else "user", text))
    return rows + [(None, 1, "user", "no conversation"), rows[0], rows[0]]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "k", "n", "i", "p") for r in rows],
                               "conv_id long, turn long, role string, text string, key string, next string, id string, place string").repartition(4)
    return sorted(tuple(r) for r in prefixtrie.trie(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"size": 1}, {"size": 2, "shard_turns": 40}, {"size": 5, "shard_turns": 7}])
def test_brute_force(spark, options):
    rows = conversations(len(options))
    assert run(spark, rows, **options) == brute(rows)


def test_one_conversation_many_times(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 3000, 7) for t in range(4)]
    assert run(spark, rows, shard_turns=100) == brute(rows)


def test_turnless_and_empty(spark):
    assert run(spark, []) == []
    few = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "alone") for c in few]  # without their hundred's first, one turn isn't enough
    assert run(spark, rows) == brute(rows)
    assert [r[1] for r in run(spark, rows)] == [0]


def test_negative_and_large_ids(spark):
    rows = [(c, t, "user", str(t % 2)) for c in (-250, -200, -1, 0, 99, 1 << 60) for t in range(8)]
    got = run(spark, rows, size=3)
    assert {r[0] for r in got if r[1] == 0} == {-250} and sum(r[3] for r in got if r[1] == 0) == 6
