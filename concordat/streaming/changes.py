"""Change events: streams, filters, debouncing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from concordat.functions import paths as P
from concordat.functions import patterns as M
from concordat.operators.ordered import session_starts
from concordat.session import materialize

ACTIONS = ("created", "modified", "deleted", "moved")


def change_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Stream over event files."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def as_events(df: DataFrame, path: Column, action: Column, ts: Column) -> DataFrame:
    """(path, action, ts); times without a zone become instants, which
    watermarks need."""
    return df.select(path.alias("path"), action.alias("action"), ts.cast("timestamp").alias("ts"))


def relative_and_ignore(events: DataFrame, root: str, ignore: Sequence[str] = (),
                        ignore_not: Sequence[str] = ()) -> DataFrame:
    """Make absolute event paths relative; drop those outside the root and
    ignored ones. Stateless, works on streams and tables."""
    inside = events.withColumn("path", P.relative_path(F.lit(root), F.col("path")))
    return inside.where(F.col("path").isNotNull()).where(
        ~M.ignored(F.col("path"), ignore, ignore_not))


def dual_stream(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events of both replicas, tagged 1 and 2."""
    return (left.withColumn("replica", F.lit(1))
            .unionByName(right.withColumn("replica", F.lit(2))))


def debounce(events: DataFrame, gap: str, late: str,
             keys: Sequence[str] = ("replica",)) -> DataFrame:
    """Streaming batches per replica: a batch closes after ``gap`` without an
    event. Rows later than ``late`` are dropped by the engine. State per open
    batch is its bounds and a count; :func:`batch_paths` looks up which paths
    it touched. A busy replica is one key, so sessions are merged inside each
    input task before the shuffle (set in the session settings).
    """
    marked = events.withWatermark("ts", late)
    return (marked.groupBy(F.session_window("ts", gap).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(*keys, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"),
                    "n_events"))


def batch_bounds(events: DataFrame, gap_seconds: float, keys: Sequence[str] = ("replica",)) -> DataFrame:
    """The batches of :func:`debounce` over a finished feed.

    Events closer than the gap always share a batch, so each key is first
    reduced to one row per gap-length slot (map-side). These rows are sorted over
    all tasks, so a single busy replica is no single task's work.
    """
    keys = list(keys)
    gap = int(gap_seconds * 1_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (events.select(*keys, at.alias("us"))
             .groupBy(*keys, F.floor(F.col("us") / gap).alias("slot"))
             .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")))
    return (session_starts(slots, keys, "lo", "hi", gap).groupBy(*keys, "start")
            .agg(F.max("hi").alias("hi"), F.sum("n").alias("n_events"))
            .select(*keys, F.timestamp_micros("start").alias("batch_start"),
                    F.timestamp_micros(F.col("hi") + gap).alias("batch_end"), "n_events"))


def batch_paths(events: DataFrame, batches: DataFrame, gap_seconds: float,
                keys: Sequence[str] = ("replica",)) -> DataFrame:
    """Distinct paths of each batch. Batches and events meet on the gap-length
    slots they cover, and events are reduced to one row per slot and path
    before the join."""
    keys = list(keys)
    gap = int(gap_seconds * 1_000_000)
    slot = lambda us: F.floor(us / gap)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    per_path = (events.select(*keys, "path", at.alias("us")).groupBy(*keys, slot(F.col("us")).alias("slot"), "path")
                .agg(F.min("us").alias("us"), F.count(F.lit(1)).alias("n")))
    start, last = F.unix_micros("batch_start"), F.unix_micros("batch_end") - gap
    covered = batches.select(*keys, "batch_start", "batch_end", start.alias("lo"), last.alias("hi"),
                             F.explode(F.sequence(slot(start), slot(last))).alias("slot"))
    # All events of a key in one slot are in one batch, so the first one decides.
    return (per_path.join(covered, [*keys, "slot"])
            .where(F.col("us").between(F.col("lo"), F.col("hi")))
            .groupBy(*keys, "batch_start", "batch_end", "path").agg(F.sum("n").alias("n_events")))


def debounce_batch(events: DataFrame, gap_seconds: float, keys: Sequence[str] = ("replica",)) -> DataFrame:
    """Debounced batches of a finished feed, one row per (batch, path)."""
    return batch_paths(events, batch_bounds(events, gap_seconds, keys), gap_seconds, keys)


def debounced_paths(stream: DataFrame, feed: Callable[[], DataFrame], gap_seconds: float, late: str, folder: str, checkpoint: str,
                    keys: Sequence[str] = ("replica",), then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """The batches of :func:`debounce` with their paths, written to ``folder`` as
    they close and handed to ``then`` (a :class:`SyncOnChange`, say).

    The state per open batch stays its bounds. The paths of batches that have
    closed are looked up in ``feed``, the events as a table, of which only the
    files and row groups of that time are read; so no batch, however many paths
    it touches, is gathered in one place. A repeated micro-batch rewrites its own
    folder and hands over the same number.
    """
    spark = stream.sparkSession
    path_type = stream.schema["path"].dataType.simpleString()
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)

    def write(closed: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch={batch_id}"
        closed = materialize(closed.select(*keys, "batch_start", "batch_end"), "closed")
        span = closed.agg(F.min("batch_start").alias("lo"), F.max("batch_end").alias("hi")).first()
        if span["lo"] is None:
            return
        of_time = feed().where(F.col("ts").between(F.lit(span["lo"]), F.lit(span["hi"])))
        batch_paths(of_time, closed, gap_seconds, keys).write.mode("overwrite").parquet(path)
        if then is not None:
            then(spark.read.schema(f"{kinds}, batch_start timestamp, batch_end timestamp, path {path_type}, n_events long").parquet(path), batch_id)

    closing = debounce(stream, f"{int(gap_seconds * 1_000_000)} microseconds", late, keys)
    return (closing.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def flush_on_stop(events: DataFrame, emitted: DataFrame, gap_seconds: float,
                  keys: Sequence[str] = ("replica",)) -> DataFrame:
    """Batches that a stopped stream still held back: those of the finished
    feed that were not emitted."""
    done = emitted.select(*keys, "batch_start").distinct()
    return debounce_batch(events, gap_seconds, keys).join(done, [*keys, "batch_start"], "left_anti")


def last_state_per_key(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Latest row per key of a change feed; keys whose last action is a
    deletion drop out when read through :func:`live_state`. A plain
    aggregation: on a stream its state is kept and restored by Spark."""
    others = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(ts, *[c for c in others if c != ts]))
    return events.groupBy(*keys).agg(newest.alias("s")).select(*keys, "s.*")


def live_state(state: DataFrame) -> DataFrame:
    return state.where(F.col("action") != "deleted")


def state_stream(events: DataFrame, keys: Sequence[str], folder: str, checkpoint: str,
                 **trigger) -> StreamingQuery:
    """Keep :func:`last_state_per_key` of a stream: every micro-batch appends
    the keys that changed in it. State and offsets are in the checkpoint, so a
    restarted run goes on where it stopped; a repeated batch rewrites its own
    folder."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (last_state_per_key(events, keys).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_state(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Current row per live key of a :func:`state_stream` folder."""
    rows = spark.read.parquet(folder)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("s"))
    return live_state(newest.select(*keys, "s.*"))
