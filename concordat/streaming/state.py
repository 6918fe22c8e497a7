"""The latest row of each live key of a feed, kept as tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from concordat.streaming.changes import last_state_per_key, live_state

_MANIFEST = "path string, level int, rows long, newest long"
_HEAD, _SNAPSHOT = -2, -1


class Part(NamedTuple):
    path: str
    level: int
    rows: int


class KeyedState:
    """State of a feed whose size follows the live keys, not the feed's length.

    Rows that are older than ``late_seconds`` before the newest time of earlier
    batches are left out, and so are rows without a time. Of the others the newest
    one of each key counts, ties as in
    :func:`~concordat.streaming.changes.last_state_per_key`.

    A micro-batch writes the keys that it has (one aggregation, nothing is kept in
    executors). ``fold`` parts of one level become one of the next level. When all
    parts together have half as many rows as the snapshot, everything becomes the
    new snapshot, and deletions leave it once nothing older than them can arrive.
    So every row is rewritten a bounded number of times per level.

    What is current stands in the manifest of the last batch, which is written
    last: a batch that dies is done again, one that is repeated does nothing.
    Parts that no manifest of the last ``grace`` batches names are removed, later
    than any reader of them should take.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], late_seconds: float,
                 ts: str = "ts", fold: int = 8, grace: int = 3):
        if fold < 2 or grace < 1:
            raise ValueError("fold must be at least 2, grace at least 1")
        self.spark, self.root, self.keys, self.ts = spark, root.rstrip("/"), list(keys), ts
        self.schema = T.StructType([schema[k] for k in keys] + [f for f in schema if f.name not in keys])
        self.late, self.fold, self.grace = int(late_seconds * 1_000_000), fold, grace

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def _finished(self) -> list[int]:
        """Batches whose manifest is whole, in order."""
        def whole(name: str) -> bool:
            path, fs = self._path(f"manifest/{name}/_SUCCESS")
            return fs.exists(path)
        return sorted(int(name) for name in self._names("manifest") if name.isdigit() and whole(name))

    def _manifest(self, batch: int) -> tuple[list[Part], int | None]:
        """Parts and newest time after a batch."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{batch}").collect()  # a few per level
        newest = next(r["newest"] for r in rows if r["level"] == _HEAD)
        return sorted((Part(*r[:3]) for r in rows if r["level"] != _HEAD), key=lambda p: p.path), newest

    def _current(self) -> tuple[int, list[Part], int | None]:
        done = self._finished()
        return (done[-1], *self._manifest(done[-1])) if done else (-1, [], None)

    def _load(self, parts: Sequence[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/data/{p.path}" for p in parts))

    def _newest(self, rows: DataFrame) -> DataFrame:
        return last_state_per_key(rows, self.keys, self.ts).select(*self.schema.names)

    def _write(self, rows: DataFrame, batch: int, level: int) -> Part:
        name = f"{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/data/{name}")
        part = Part(name, level, 0)
        return part._replace(rows=self._load([part]).count())  # from the footers

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done, parts, newest = self._current()
        if batch_id <= done:
            return
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        rows = batch.where(us.isNotNull() if newest is None else us >= newest - self.late)
        fresh = self._write(self._newest(rows), batch_id, 0)
        if fresh.rows:
            parts.append(fresh)
            last = self._load([fresh]).agg(F.max(us)).first()[0]
            newest = last if newest is None else max(newest, last)
        parts = self._folded(parts, batch_id, None if newest is None else newest - self.late)
        head = (None, _HEAD, 0, newest)
        self.spark.createDataFrame([head, *((*p, None) for p in parts)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/{batch_id}")
        self._vacuum()

    def _folded(self, parts: list[Part], batch: int, horizon: int | None) -> list[Part]:
        loose = [p for p in parts if p.level != _SNAPSHOT]
        held = sum(p.rows for p in parts if p.level == _SNAPSHOT)
        if loose and 2 * sum(p.rows for p in loose) >= held:
            us = F.unix_micros(F.col(self.ts).cast("timestamp"))
            # Not even a row of the horizon itself is older than these deletions.
            gone = (F.col("action") == "deleted") & (us < horizon)
            return [self._write(self._newest(self._load(parts)).where(~F.coalesce(gone, F.lit(False))), batch, _SNAPSHOT)]
        level = 0
        while len(same := [p for p in parts if p.level == level]) >= self.fold:
            merged = self._write(self._newest(self._load(same)), batch, level + 1)
            parts = [p for p in parts if p.level != level] + [merged]
            level += 1
        return parts

    def _vacuum(self) -> None:
        done = self._finished()
        kept = done[-self.grace:]
        named = {p.path for b in kept for p in self._manifest(b)[0]}
        for name in self._names("data"):
            if name not in named and int(name.split("-")[0]) <= kept[-1]:
                self._remove(f"data/{name}")
        for b in done[:-self.grace]:
            self._remove(f"manifest/{b}")

    def rows_held(self) -> int:
        """Rows in all current parts, deletions and older rows included."""
        return sum(p.rows for p in self._current()[1])

    def read(self) -> DataFrame:
        """Current row of each live key."""
        return live_state(self._newest(self._load(self._current()[1])))


def keyed_state(events: DataFrame, state: KeyedState, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a :class:`KeyedState` of a stream."""
    return (events.writeStream.foreachBatch(state).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
