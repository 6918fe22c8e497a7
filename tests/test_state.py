"""State of a feed by key: late rows, deletions that expire, restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from concordat.streaming import changes as CH
from concordat.streaming.state import KeyedState, keyed_state


def frame(spark, rows):
    plain = spark.createDataFrame(rows, "path string, action string, s long, n int")
    return plain.select("path", "action", F.timestamp_seconds("s").alias("ts"), "n")


def brute(batches, late):
    """Live rows of a feed, read one batch after another."""
    state, newest = {}, None
    for rows in batches:
        floor = None if newest is None else newest - late
        for path, action, s, n in rows:
            if s is None or floor is not None and s < floor:
                continue
            newest = s if newest is None else max(newest, s)
            row = s, action, n
            if path not in state or row > state[path]:
                state[path] = row
    return sorted((p or "", a, s, n) for p, (s, a, n) in state.items() if a != "deleted")


def live(state):
    return sorted((r["path"] or "", r["action"], r["s"], r["n"]) for r in
                  state.read().select("path", "action", F.unix_seconds("ts").alias("s"), "n").collect())


@pytest.mark.parametrize(("seed", "fold"), [(0, 2), (1, 3)])
def test_random_feeds(spark, tmp_path, seed, fold):
    rng = random.Random(seed)
    schema = frame(spark, []).schema
    batches, root = [], str(tmp_path / "s")
    for b in range(9):
        rows = [(rng.choice([None, *"abcdefgh"]), rng.choice(["created", "modified", "deleted"]), max(0, b * 10 - rng.randrange(40)), rng.randrange(9))
                for _ in range(rng.choice([0, 3, 12]))]
        rows += [("x", "modified", None, 1)] + ([(f"long{i}", "created", b * 10, i) for i in range(40)] if b == 1 else [])
        batches.append(rows)
        state = KeyedState(spark, root, schema, ["path"], 15, fold=fold)  # each batch after a restart
        state(frame(spark, rows), b)
        state(frame(spark, [("again", "created", 10_000, 0)]), b)  # a repeated batch
        assert live(state) == brute(batches, 15), b


def test_size_follows_live_keys(spark, tmp_path):
    schema = frame(spark, []).schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["path"], 5, fold=3, grace=2)
    for b in range(14):
        rows = [(f"p{b}-{i}", a, b * 10 + j, i) for i in range(20) for j, a in enumerate(("created", "deleted"))] + [("kept", "modified", b * 10, b)]
        state(frame(spark, rows), b)
    assert live(state) == [("kept", "modified", 130, 13)]
    assert state.rows_held() <= 45  # 280 keys were seen
    assert len(os.listdir(tmp_path / "s" / "manifest")) == 2
    assert len(os.listdir(tmp_path / "s" / "data")) <= 8


def test_lost_batch_is_done_again(spark, tmp_path):
    schema = frame(spark, []).schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["path"], 5)
    assert state.read().collect() == [] and state.rows_held() == 0
    state(frame(spark, [("a", "created", 1, 1)]), 0)
    frame(spark, [("b", "created", 2, 2)]).write.parquet(str(tmp_path / "s" / "data" / "1-dead"))  # wrote a part, then died
    os.makedirs(tmp_path / "s" / "manifest" / "1")
    assert live(state) == [("a", "created", 1, 1)]
    state(frame(spark, [("c", "created", 3, 3)]), 1)
    assert live(state) == [("a", "created", 1, 1), ("c", "created", 3, 3)]
    assert not os.path.exists(tmp_path / "s" / "data" / "1-dead")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    first = frame(spark, [("a", "created", 1, 1), ("b", "created", 2, 1), ("c", "created", 100, 1)])
    second = frame(spark, [("a", "modified", 90, 2), ("b", "deleted", 95, 2), ("c", "deleted", 10, 2)])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        state = KeyedState(spark, str(tmp_path / "s"), first.schema, ["path"], 20)
        keyed_state(CH.change_stream(spark, src, first.schema), state, str(tmp_path / "ck")).awaitTermination()
    assert live(state) == [("a", "modified", 90, 2), ("c", "created", 100, 1)]
