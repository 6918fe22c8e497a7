"""Block deltas: round trips and brute force."""

import hashlib
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from concordat.functions import blocks as B
from concordat.operators import delta as D


def noise(n, seed):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


BIG = noise(100_000, 1)
PAIRS = {
    "same": (BIG, BIG), "edit": (BIG, BIG[:50_000] + noise(1000, 2) + BIG[51_000:]), "append": (BIG, BIG + noise(3000, 3)),
    "prepend": (BIG, noise(777, 4) + BIG), "insert": (BIG, BIG[:33_333] + b"hello" + BIG[33_333:]),
    "delete": (BIG, BIG[:20_000] + BIG[40_000:]), "other": (BIG, noise(5000, 5)), "empty_old": (b"", noise(5000, 6)),
    "empty_new": (BIG, b""), "short_new": (BIG, BIG[:699]), "zeros": (bytes(50_000), bytes(60_001)),
    "repeat": (noise(700, 7) * 20, noise(700, 7) * 31 + b"x"), "unknown": (None, noise(2000, 8)),
}


def brute(old, new):
    """Tokens by the plain sliding window."""
    if not old or len(new) < B.MIN_BLOCK:
        return [("literal", new)] if new else []
    size = int(min(max(2 ** round(np.log2(np.sqrt(len(old)))), B.MIN_BLOCK), B.MAX_BLOCK))
    known = {}
    for i in range(0, len(old), size):
        known.setdefault(hashlib.md5(old[i:i + size]).digest(), i // size)
    out, start, off = [], 0, 0
    while off + size <= len(new):
        n = known.get(hashlib.md5(new[off:off + size]).digest())
        if n is None:
            off += 1
            continue
        if off > start:
            out.append(("literal", new[start:off]))
        out.append(("block", n))
        off += size
        start = off
    if start < len(new):
        out.append(("literal", new[start:]))
    return out


@pytest.fixture(scope="module")
def tokens(spark):
    old = spark.createDataFrame([(k, bytearray(o)) for k, (o, _) in PAIRS.items() if o is not None], "path string, content binary")
    new = spark.createDataFrame([(k, bytearray(n)) for k, (_, n) in PAIRS.items()], "path string, content binary")
    t = D.delta_tokens(D.match_blocks(D.block_signatures(old), new)).cache()
    return old, new, t


def test_tokens_against_brute_force(tokens):
    got = {}
    for r in tokens[2].orderBy("path", "seq").collect():
        got.setdefault(r["path"], []).append((r["token"], r["block_index"] if r["token"] == "block" else bytes(r["literal"])))
    for name, (old, new) in PAIRS.items():
        assert got.get(name, []) == brute(old, new), name


def test_round_trip(tokens):
    old, new, t = tokens
    got = {r["path"]: bytes(r["content"]) for r in D.apply_delta(old, t).collect()}
    for name, (_, n) in PAIRS.items():
        assert got.get(name, b"") == n, name


def test_small_edit_is_cheap(tokens):
    s = {r["path"]: r for r in D.delta_stats(tokens[2]).collect()}
    assert s["edit"]["literal_bytes"] < 0.3 * len(BIG)
    assert s["same"]["n_blocks"] == len(BIG) // 700 and s["same"]["literal_bytes"] == len(BIG) % 700
    assert s["zeros"]["literal_bytes"] < 700 and s["other"]["n_blocks"] == 0


def test_chunked_scan(monkeypatch):
    data = noise(5000, 9)
    wanted = B.weak_at_every_offset(data, 700)[::500]
    hits = lambda: np.concatenate(list(B._hits(data, 700, wanted))).tolist()
    whole = hits()
    monkeypatch.setattr(B, "SCAN_CHUNK", 333)
    assert hits() == whole and len(whole) == 9


def test_repetitive_values_match_like_others(spark):
    rng = np.random.default_rng(1)
    took = {}
    for name, data in {"random": rng.bytes(4_000_000), "zeros": bytes(4_000_000)}.items():
        old = spark.createDataFrame([("v", bytearray(data))], "path string, content binary")
        new = spark.createDataFrame([("v", bytearray(data[:3_000_000] + b"new" + data[3_000_000:]))], "path string, content binary")
        start = time.time()
        m = D.match_blocks(D.block_signatures(old), new).first()
        took[name] = time.time() - start
        size, places = m["block_size"], [x["off"] for x in m["m"]]
        assert all(b - a >= size for a, b in zip(places, places[1:], strict=False))
        assert 4_000_003 - len(places) * size < 3 * size
    assert took["zeros"] < 2 * took["random"] + 5


def test_matches_hold_one_value_of_a_batch_at_a_time():
    values = [noise(60_000, i) for i in range(400)]
    strong = [hashlib.md5(v[:700]).hexdigest() for v in values]
    weak = [B.weak_of(v[:700]) for v in values]
    batch = [pa.array(values, pa.binary()), pa.array([700] * 400, pa.int32()), pa.array([[w] for w in weak], pa.list_(pa.int32())),
             pa.array([[s] for s in strong]), pa.array([[0]] * 400, pa.list_(pa.int32()))]
    tracemalloc.start()
    found = B.matching_offsets.func(*batch)
    sums = B.block_weak_hashes.func(*batch[:2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [[{"off": 0, "block": 0}]] * 400
    assert [x[0] for x in sums.to_pylist()] == weak and len(sums[0]) == -(-60_000 // 700)
    assert peak < 8_000_000  # of 24 MB
