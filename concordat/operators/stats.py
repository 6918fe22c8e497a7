"""Transfer statistics over a log table (run_id, ts, bytes, item_done)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.ordered import running_totals
from concordat.session import materialize

# Spacing and number of rate samples.
SAMPLE_MS = 500
MAX_SAMPLES = 20

#: Sampling slots (of SAMPLE_MS) handled as one piece: half an hour.
CHUNK_SLOTS = 3600


def progress(done_bytes: Column, total_bytes: Column, done_items: Column, total_items: Column) -> Column:
    """Share of the bytes, else of the items, else complete."""
    by_items = F.when(total_items == 0, F.lit(1.0)).otherwise(done_items / total_items)
    return F.when(total_bytes == 0, by_items).otherwise(done_bytes / total_bytes)


def with_totals(log: DataFrame) -> DataFrame:
    """Log rows with running and total bytes and items of their run."""
    order = [F.col("ts"), F.col("seq")]
    done = running_totals(log, ["run_id"], order, {
        "done_bytes": F.col("bytes"), "done_items": F.col("item_done").cast("long")})
    totals = log.groupBy("run_id").agg(
        F.sum("bytes").alias("total_bytes"), F.sum(F.col("item_done").cast("long")).alias("total_items"),
        F.min("ts").alias("started"))
    return done.join(totals, "run_id")  # adaptive execution splits a run with very many rows


def eta_seconds(rate: Column, done_bytes: Column, total_bytes: Column) -> Column:
    """Whole seconds left; 0 when done, null when nothing moves."""
    left = total_bytes - done_bytes
    return (F.when((rate <= 0) | rate.isNull(), None).when(left <= 0, F.lit(0).cast("long"))
            .otherwise(F.ceil(left / rate)))


# -- sampling ----------------------------------------------------------------
#
# A sample is taken at the first row at least 500 ms after the last one. That
# choice is sequential, but it can be cut: time is divided into slots of
# 500 ms, a slot holds at most one sample and at most 500 distinct
# milliseconds, and what happens in a chunk of slots depends on earlier ones
# only through the sample in the slot just before it. Chunks are reduced to
# "sample before -> sample in the last slot" tables, these are composed by
# doubling, and then every chunk places its samples knowing where it starts. A slot with
# empty neighbours needs none of this: its first row is the sample.

NONE = -1  # no sample in the slot before


def _next_sample(ms: np.ndarray) -> np.ndarray:
    return np.searchsorted(ms, ms + SAMPLE_MS)


def _walk(ms: np.ndarray, entry: int, first: int) -> list[int]:
    """Samples among ``ms[first:]`` after a sample at ``entry``."""
    pos = first if entry == NONE else int(np.searchsorted(ms, entry + SAMPLE_MS))
    pos, out = max(pos, first), []
    while pos < len(ms):
        out.append(int(ms[pos]))
        pos = int(np.searchsorted(ms, ms[pos] + SAMPLE_MS))
    return out


def _chunk_bounds(chunk: int) -> tuple[int, int]:
    start = chunk * CHUNK_SLOTS * SAMPLE_MS
    return start, start + CHUNK_SLOTS * SAMPLE_MS


def _transitions(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For every possible sample before the chunk: the one in its last slot."""
    run, chunk = key
    start, stop = _chunk_bounds(int(chunk))
    ms = np.sort(pdf["ms"].to_numpy())
    nxt = np.append(_next_sample(ms), len(ms))
    first = int(np.searchsorted(ms, start))
    entries = [NONE, *ms[:first].tolist()]
    pos = np.array([first, *nxt[:first]], dtype=np.int64)
    pos = np.maximum(pos, first)
    last_slot = int(np.searchsorted(ms, stop - SAMPLE_MS))
    while (pos < last_slot).any():
        pos = np.where(pos < last_slot, nxt[pos], pos)
    exits = [int(ms[p]) if p < len(ms) else NONE for p in pos]
    return pd.DataFrame({"run_id": run, "chunk": chunk, "entry": entries, "exit": exits})


def _chunk_entries(tables: DataFrame) -> DataFrame:
    """``run_id, chunk, entry``: the sample before each chunk, from the transition
    tables of all chunks.

    A row of a table is a node whose successor is the node of the next chunk that
    its exit leads to. What the first chunks of each stretch reach is found by
    doubling: in every round the reached nodes jump, and the jumps are composed
    with themselves. So a run of n chunks takes log2(n) rounds of joins, and no
    run is gathered in one place.
    """
    node = ["run_id", "chunk", "entry"]
    here = materialize(tables.select("run_id", "chunk").distinct(), "chunks")
    started = tables.where("started is not null").select("run_id", "chunk", F.col("started").cast("long").alias("entry"),
                                                         F.col("first_exit").cast("long").alias("exit")).distinct()
    after = here.select("run_id", (F.col("chunk") + 1).alias("chunk"))
    fresh = (here.join(after, ["run_id", "chunk"], "left_anti").join(started, ["run_id", "chunk"], "left_anti")
             .withColumn("entry", F.lit(NONE).cast("long")))
    second = started.select("run_id", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).join(here, ["run_id", "chunk"], "left_semi")
    reached = materialize(started.select(*node).unionByName(fresh).unionByName(second), "reached")
    jumps = materialize(tables.select(*node, (F.col("chunk") + 1).alias("to_chunk"), F.col("exit").alias("to_entry"))
                        .join(here.withColumnRenamed("chunk", "to_chunk"), ["run_id", "to_chunk"], "left_semi"), "jumps")
    while not jumps.isEmpty():
        moved = reached.join(jumps, node).select("run_id", F.col("to_chunk").alias("chunk"), F.col("to_entry").alias("entry"))
        reached = materialize(reached.unionByName(moved).distinct(), "reached")
        further = jumps.select("run_id", F.col("chunk").alias("to_chunk"), F.col("entry").alias("to_entry"),
                               F.col("to_chunk").alias("far_chunk"), F.col("to_entry").alias("far_entry"))
        jumps = materialize(jumps.join(further, ["run_id", "to_chunk", "to_entry"])
                            .select(*node, F.col("far_chunk").alias("to_chunk"), F.col("far_entry").alias("to_entry")), "jumps")
    return reached


def _first_transition(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Like :func:`_transitions`, plus the exit when the run starts here: the
    clock starts with the first row, which is not a sample itself."""
    out = _transitions(key, pdf)
    start, stop = _chunk_bounds(int(key[1]))
    ms = np.sort(pdf["ms"].to_numpy())
    started = pdf["started"].dropna()
    out["started"], out["first_exit"] = np.nan, np.nan
    if len(started):
        t0 = int(started.iloc[0])
        taken = _walk(ms, t0, int(np.searchsorted(ms, start)))
        inside = [t for t in taken if t >= stop - SAMPLE_MS]
        out["started"] = float(t0)
        out["first_exit"] = float(inside[-1] if inside else (t0 if t0 >= stop - SAMPLE_MS else NONE))
    return out


def _place(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or entry.empty:
        return pd.DataFrame({"run_id": [], "ms": []})
    start, _ = _chunk_bounds(int(key[1]))
    ms = np.sort(rows["ms"].to_numpy())
    taken = _walk(ms, int(entry["entry"].iloc[0]), int(np.searchsorted(ms, start)))
    return pd.DataFrame({"run_id": key[0], "ms": taken})


def sample_times(log: DataFrame) -> DataFrame:
    """(run_id, ms) of the rate samples."""
    run_type = log.schema["run_id"].dataType.simpleString()
    times = log.select("run_id", F.unix_millis("ts").alias("ms")).distinct()
    slot = F.floor(F.col("ms") / SAMPLE_MS)
    times = materialize(times.withColumn("slot", slot), "times")
    slots = times.groupBy("run_id", "slot").agg(F.min("ms").alias("ms"))
    beside = slots.select("run_id", F.explode(F.array(F.col("slot") - 1, F.col("slot") + 1)).alias("slot")).distinct()
    first = times.groupBy("run_id").agg(F.min("ms").alias("ms"))
    alone = (slots.join(beside, ["run_id", "slot"], "left_anti").select("run_id", "ms")
             .join(first, ["run_id", "ms"], "left_anti"))
    dense = times.join(beside, ["run_id", "slot"], "left_semi")

    at = F.col("slot")
    chunk = F.floor(at / CHUNK_SLOTS)
    homes = F.when(at % CHUNK_SLOTS == CHUNK_SLOTS - 1, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    pieces = dense.select("run_id", "ms", F.explode(homes).alias("chunk"))
    # A chunk that holds nothing but the slot before it has no samples.
    own = F.col("ms") >= F.col("chunk") * (CHUNK_SLOTS * SAMPLE_MS)
    alive = pieces.where(own).select("run_id", "chunk").distinct()
    pieces = pieces.join(alive, ["run_id", "chunk"], "left_semi")
    starts = first.select("run_id", F.col("ms").alias("started"),
                          F.floor(F.col("ms") / (CHUNK_SLOTS * SAMPLE_MS)).alias("chunk"))
    # The clock of a run whose first slot stands alone does not reach further.
    starts = starts.join(dense.select("run_id", F.col("ms").alias("started")), ["run_id", "started"], "left_semi")
    seeded = pieces.join(starts, ["run_id", "chunk"], "left")
    tables = materialize(seeded.groupBy("run_id", "chunk").applyInPandas(
        _first_transition,
        f"run_id {run_type}, chunk long, entry long, exit long, started double, first_exit double"), "transitions")
    entries = _chunk_entries(tables)
    placed = (pieces.groupBy("run_id", "chunk").cogroup(entries.groupBy("run_id", "chunk"))
              .applyInPandas(_place, f"run_id {run_type}, ms long"))
    return alone.unionByName(placed)


def rolling_rate(log: DataFrame) -> DataFrame:
    """Log rows with totals, the number of samples so far and the rate in
    bytes per second: between the first and last of the latest 20 samples, or
    total over elapsed time while there are fewer than two."""
    totals = materialize(with_totals(log).withColumn("ms", F.unix_millis("ts")), "totals")
    firsts = totals.groupBy("run_id", "ms").agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"))
    taken = sample_times(log).join(firsts, ["run_id", "ms"]).select(
        "run_id", "seq", F.lit(1).cast("long").alias("_taken"))
    flagged = (totals.join(taken, ["run_id", "seq"], "left")
               .withColumn("_taken", F.coalesce("_taken", F.lit(0).cast("long"))))
    counted = materialize(running_totals(flagged, ["run_id"], [F.col("ts"), F.col("seq")],
                                         {"n_samples": F.col("_taken")}), "counted")
    samples = counted.where(F.col("_taken") == 1).select(
        "run_id", "n_samples", F.col("ms").alias("s_ms"), F.col("done_bytes").alias("s_bytes"))
    oldest = samples.select("run_id", F.col("n_samples").alias("_k"), F.col("s_ms").alias("o_ms"),
                            F.col("s_bytes").alias("o_bytes"))
    window = (samples.withColumn("_k", F.greatest(F.col("n_samples") - (MAX_SAMPLES - 1), F.lit(1)))
              .join(oldest, ["run_id", "_k"]).drop("_k"))
    j = counted.join(window, ["run_id", "n_samples"], "left")
    dt = (F.col("s_ms") - F.col("o_ms")) / 1000
    elapsed = (F.col("ms") - F.unix_millis("started")) / 1000
    plain = F.when(elapsed > 0, F.col("done_bytes") / elapsed).otherwise(F.lit(0.0))
    rate = (F.when(F.col("n_samples") < 2, plain).when(dt <= 0, F.lit(0.0))
            .otherwise((F.col("s_bytes") - F.col("o_bytes")) / dt))
    return j.withColumn("rate", rate).drop("_taken", "s_ms", "s_bytes", "o_ms", "o_bytes", "ms")
