"""Persisted state: bases, fingerprint caches, plans, replicas, history."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat import schemas as S
from concordat.operators.backups import rotate_backups
from concordat.operators.history import KEEP_RECORDS, prune_entries, prune_history


def base_id_column(left, right, version: int = S.FORMAT_VERSION):
    """12 hex characters naming a pair of replicas."""
    return F.substring(F.md5(F.concat_ws(";", left, right, F.lit(str(version)))), 1, 12)


def base_id(spark: SparkSession, left: str, right: str) -> str:
    return spark.range(1).select(base_id_column(F.lit(left), F.lit(right))).first()[0]


def _read_or_none(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
        df.isEmpty()
        return df
    except (PySparkException, Py4JJavaError):  # missing, or files that can't be read
        return None


class LostRace(RuntimeError):
    """Another writer published at the same time and came first."""


_POINTER = "pair string, version string, format_version int, seq long"


class VersionedStore:
    """Tables of which a reader sees either the old or the new version.

    A save writes a fresh directory and then appends one pointer row; a save
    that dies in between leaves the old version current. The path being read
    is never overwritten.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        return _read_or_none(self.spark, f"{self.root}/pointers", _POINTER)

    def _current(self, pair: str):
        pointers = self._pointers()
        if pointers is None:
            return None
        return pointers.where(F.col("pair") == pair).orderBy(F.col("seq").desc(), "version").first()

    def save(self, pair: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        self.save_all({pair: df}, partition_by)

    def save_all(self, tables: Mapping[str, DataFrame], partition_by: Sequence[str] = (), drop: Sequence[str] = ()) -> None:
        """Publish several tables, and forget others, with one pointer file:
        readers see all of it or nothing."""
        versions: dict[str, str | None] = {pair: uuid.uuid4().hex for pair in tables}
        last = self._seqs([*tables, *drop])
        for pair, df in tables.items():
            writer = df.write.partitionBy(*partition_by) if partition_by else df.write
            writer.parquet(f"{self.root}/data/{pair}/{versions[pair]}")
        self._point(versions | dict.fromkeys(drop), last)

    def _seqs(self, pairs: Sequence[str]) -> dict[str, int]:
        pointers = self._pointers()
        found = {} if pointers is None else {
            r["pair"]: r["seq"] for r in pointers.where(F.col("pair").isin(*pairs)).groupBy("pair").agg(F.max("seq").alias("seq")).collect()}
        return {pair: found.get(pair, 0) for pair in pairs}

    def pairs(self, prefix: str) -> list[str]:
        """Names of the published tables that start with ``prefix``."""
        pointers = self._pointers()
        if pointers is None:
            return []
        now = pointers.where(F.col("pair").startswith(prefix)).groupBy("pair").agg(F.max("seq").alias("seq"))
        held = pointers.join(now, ["pair", "seq"]).groupBy("pair").agg(F.min("version").alias("version"))
        return sorted(r["pair"] for r in held.where("version is not null").collect())

    def _point(self, versions: Mapping[str, str | None], last: Mapping[str, int]) -> None:
        """Append the pointers after the state that was seen when the save began.
        Of two savers with the same number the one with the smaller version
        stands, and the other is told."""
        rows = [(pair, version, S.FORMAT_VERSION, last[pair] + 1) for pair, version in versions.items()]
        self.spark.createDataFrame(rows, _POINTER).coalesce(1).write.mode("append").parquet(
            f"{self.root}/pointers")
        mine = self.spark.createDataFrame(rows, _POINTER).select("pair", "seq", F.col("version").alias("mine"))
        lost = (self._pointers().join(mine, ["pair", "seq"]).groupBy("pair", "mine").agg(F.min("version").alias("first"))
                .where(~F.col("first").eqNullSafe(F.col("mine"))).collect())
        if lost:
            raise LostRace(f"{lost[0]['pair']}: another save came first")

    def load(self, pair: str, schema: T.StructType | None = None) -> DataFrame | None:
        """Current version; missing, unreadable or of another format gives an
        empty table when a schema is known, else None."""
        found = self._current(pair)
        df = None
        if found and found["version"] and found["format_version"] == S.FORMAT_VERSION:
            df = _read_or_none(self.spark, f"{self.root}/data/{pair}/{found['version']}", schema)
        if df is None and schema is not None:
            return self.spark.createDataFrame([], schema)
        return df

    def exists(self, pair: str) -> bool:
        found = self._current(pair)
        return bool(found and found["version"])

    def drop(self, pair: str) -> None:
        """Make the pair unknown; old files stay until storage is cleaned."""
        if self.exists(pair):
            self._point({pair: None}, self._seqs([pair]))


def save_base(spark: SparkSession, root: str, left: str, right: str, df: DataFrame) -> None:
    VersionedStore(spark, root).save(base_id(spark, left, right), df)


def load_base(spark: SparkSession, root: str, left: str, right: str,
              schema: T.StructType) -> DataFrame:
    return VersionedStore(spark, root).load(base_id(spark, left, right), schema)


def base_exists(spark: SparkSession, root: str, left: str, right: str) -> bool:
    return VersionedStore(spark, root).exists(base_id(spark, left, right))


def drop_base(spark: SparkSession, root: str, left: str, right: str) -> None:
    VersionedStore(spark, root).drop(base_id(spark, left, right))


def save_fp_cache(cache: DataFrame, root: str) -> None:
    rows = cache.select("path", "fp", "mtime", "length", "perms",
                        F.lit(S.FORMAT_VERSION).alias("format_version"))
    VersionedStore(cache.sparkSession, root).save("fp_cache", rows)


def load_fp_cache(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the current format; a missing or broken cache is empty."""
    df = VersionedStore(spark, root).load("fp_cache", S.FP_CACHE)
    return df.where(F.col("format_version") == S.FORMAT_VERSION)


def write_replicas(left: DataFrame, right: DataFrame, root: str,
                   keys: Sequence[str] = (), buckets: int = 0) -> None:
    """Publish new replicas. With ``buckets`` they are clustered by key, so a
    later cycle reads them in key ranges of even size."""
    VersionedStore(left.sparkSession, root).save_all(
        {name: df.repartition(buckets, *keys) if buckets else df for name, df in (("left", left), ("right", right))})


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Save a snapshot as a catalog table bucketed and sorted by key. Snapshots
    bucketed alike are joined without a shuffle or a sort."""
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)
     .sortBy(*keys).format("parquet").saveAsTable(table))


def append_history(record: DataFrame, entries: DataFrame, root: str) -> None:
    """Append a record (JSON) and its entries (parquet). Entries come first: a
    record is only visible with all its entries written."""
    entries.write.mode("append").parquet(f"{root}/entries")
    record.coalesce(1).write.mode("append").json(f"{root}/records")


def read_history(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records, newest first, unreadable ones skipped; and all entries."""
    try:
        records = (spark.read.schema(S.HISTORY_RECORD).option("mode", "DROPMALFORMED")
                   .json(f"{root}/records").where(F.col("sync_id").isNotNull()))
    except AnalysisException:
        records = spark.createDataFrame([], S.HISTORY_RECORD)
    entries = _read_or_none(spark, f"{root}/entries", S.HISTORY_ENTRY)
    if entries is None:
        entries = spark.createDataFrame([], S.HISTORY_ENTRY)
    return records.orderBy(F.col("ts").desc(), F.col("sync_id").desc()), entries


def kept_history(spark: SparkSession, root: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """History after pruning, to be published elsewhere."""
    records, entries = read_history(spark, root)
    kept = prune_history(records, keep)
    return kept, prune_entries(entries, kept)


def clear_history(spark: SparkSession, root: str) -> None:
    spark.createDataFrame([], S.HISTORY_ENTRY).write.mode("overwrite").parquet(f"{root}/entries")
    spark.createDataFrame([], S.HISTORY_RECORD).write.mode("overwrite").json(f"{root}/records")


class ReplicaStore:
    """Left, right and base of a pair with their history and backups; what a cycle
    brings is published at once.

    A table is a snapshot and the changes since: the current rows, or their
    absence, of the keys that cycles have looked at. A cycle rewrites the
    changes only; when they have grown to a tenth of the snapshot, both are
    folded. History keeps its newest records, backups their newest copies.
    """

    TABLES = ("left", "right", "base")

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], keep_records: int = KEEP_RECORDS, keep_copies: int = 2, fold_sets: int = 16):
        self.spark, self.keys = spark, list(keys)
        self.store = VersionedStore(spark, root)
        self.keep_records, self.keep_copies, self.fold_sets = keep_records, keep_copies, fold_sets

    def create(self, **tables: DataFrame) -> None:
        self.store.save_all(tables)

    def put(self, **tables: DataFrame) -> None:
        """Replace whole tables (new listings of a side, say)."""
        self.store.save_all(tables, drop=[f"{name}.changes" for name in tables])

    def read(self, name: str) -> DataFrame:
        whole, changes = self.store.load(name), self.store.load(f"{name}.changes")
        return whole if changes is None else self._over(whole, changes)

    def _over(self, whole: DataFrame, changes: DataFrame) -> DataFrame:
        kept = whole.join(changes.select(*self.keys), self.keys, "left_anti")
        return kept.unionByName(changes.where("not _gone").select(*whole.columns))

    def _changed(self, name: str, looked_at: DataFrame, new: DataFrame) -> tuple[str, DataFrame]:
        rows = looked_at.join(new.withColumn("_here", F.lit(True)), self.keys, "left").withColumn("_gone", F.col("_here").isNull()).drop("_here")
        old = self.store.load(f"{name}.changes")
        if old is not None:
            rows = old.join(looked_at, self.keys, "left_anti").unionByName(rows)
            if old.count() * 10 > self.store.load(name).count():
                return name, self._over(self.store.load(name), rows)
        return f"{name}.changes", rows

    def publish(self, out, looked_at: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> None:
        """Everything that a cycle (``out``) brings, for the keys ``looked_at``
        or, without them, for all. ``stream`` and ``batch`` mark a batch as done."""
        tables, drop = {}, []
        for name in self.TABLES:
            new = getattr(out, name)
            where, rows = (name, new) if looked_at is None else self._changed(name, looked_at, new)
            tables[where] = rows
            if where == name:
                drop.append(f"{name}.changes")
        record = out.record.first()
        if record:
            records = self.store.load("records")
            fresh = out.record if records is None else records.unionByName(out.record)
            tables["records"] = kept = self.spark.createDataFrame(prune_history(fresh, self.keep_records).collect(), S.HISTORY_RECORD)
            ids = {f"entries.{r['sync_id']}" for r in kept.collect()}  # at most keep_records
            drop += [p for p in self.store.pairs("entries.") if p not in ids]
            tables[f"entries.{record['sync_id']}"] = out.entries
            if out.backups is not None:
                sets = self.store.pairs("backups.")
                added = out.backups
                if len(sets) >= self.fold_sets:
                    added = self.backups(added)
                    drop += sets
                tables[f"backups.{record['sync_id']}"] = added
        if stream is not None:
            done = {r["stream"]: r["batch"] for r in self._progress()} | {stream: batch}
            tables["progress"] = self.spark.createDataFrame(list(done.items()), "stream string, batch long")
        self.store.save_all(tables, drop=drop)

    def _progress(self) -> list:
        found = self.store.load("progress")
        return [] if found is None else found.collect()  # one row per stream

    def done(self, stream: str, batch: int) -> bool:
        return any(r["stream"] == stream and r["batch"] >= batch for r in self._progress())

    def history(self) -> tuple[DataFrame, DataFrame]:
        """Records, newest first, and their entries."""
        entries = self.spark.createDataFrame([], S.HISTORY_ENTRY)
        for pair in self.store.pairs("entries."):
            entries = entries.unionByName(self.store.load(pair))
        return self.store.load("records", S.HISTORY_RECORD).orderBy(F.col("sync_id").desc()), entries

    def backups(self, more: DataFrame | None = None) -> DataFrame | None:
        """The newest copies of each key and side, numbered from 0."""
        found = more
        for pair in self.store.pairs("backups."):
            rows = self.store.load(pair).drop("version")
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return None if found is None else rotate_backups(found, [*self.keys, "side"], self.keep_copies, [F.col("taken_at").desc(), F.col("sync_id").desc()])
