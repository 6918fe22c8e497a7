"""Continuous reconciliation."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from concordat.config import JobConfig
from concordat.operators.guards import guard_empty_side
from concordat.operators.tree import deciding_paths
from concordat.plans.cycle import sync
from concordat.session import materialize, scratch_scope
from concordat.sources.stores import ReplicaStore


class SyncOnChange:
    """``foreachBatch`` sink: reconcile what a batch of change events touches.

    A cycle reads the touched keys and all that decides with them
    (:func:`concordat.operators.tree.deciding_paths`), so it does what a cycle
    over everything would do for them. Followed links make every cycle read
    everything. Micro-batches run one after another, so changes that arrive
    meanwhile are in the next one. Tables, history, backups and the batch's number
    are published together: a batch that is repeated after a crash either
    finds nothing published or is left out.

    Events must name every key whose row on a side has changed. Empty sides and
    deletions are judged against the whole sides."""

    def __init__(self, store: ReplicaStore, cfg: JobConfig, stream: str = "changes"):
        self.store, self.stream = store, stream
        self.cfg = replace(cfg, guard_empty=False)  # a part may well be empty; whether a side is, run() asks
        self.guard = cfg.guard_empty
        self.rounds = 0

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        if self.store.done(self.stream, batch_id):
            return
        with scratch_scope(self.store.spark):
            touched = materialize(events.select(*self.store.keys).distinct(), "touched")
            if not touched.isEmpty():
                self.run(touched, batch_id)

    def run(self, touched: DataFrame | None = None, batch_id: int | None = None) -> None:
        """One cycle over the touched keys, or over everything (the initial sync)."""
        left, right, base = (self.store.read(name) for name in self.store.TABLES)
        if self.guard:
            guard_empty_side(left, base, "left")
            guard_empty_side(right, base, "right")
        with scratch_scope(self.store.spark):
            looked_at = None if self.cfg.follow else touched
            if looked_at is not None and self.store.keys == ["path"]:
                looked_at = deciding_paths(looked_at, left, right, base, atomic=self.cfg.plan.atomic)
            parts = (left, right, base)
            if looked_at is not None:
                parts = tuple(t.join(looked_at, self.store.keys, "left_semi") for t in parts)
            out = sync(*parts, self.cfg, counted=(left, right), sync_id=f"{datetime.now(UTC):%Y%m%dT%H%M%S.%f}")
            self.store.publish(out, looked_at, None if batch_id is None else self.stream, batch_id)
        self.rounds += 1


def sync_on_change(events: DataFrame, sink: SyncOnChange, checkpoint: str,
                   **trigger) -> StreamingQuery:
    """Initial sync, then a cycle per batch of changes."""
    sink.run()
    sink.stream = checkpoint
    return (events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def sync_repeat(ticks: DataFrame, sink: SyncOnChange, checkpoint: str, interval: str) -> StreamingQuery:
    """The same cycle over everything on a timer; ``ticks`` is any stream that
    yields rows (the rate source, say)."""
    return (ticks.writeStream.foreachBatch(lambda df, n: sink.run())
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start())
