"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators assume. None of them depends on the data size;
#: partition counts are left to adaptive execution.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


#: Shuffle files of a query go when it ends, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_CONF` to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to a folder
    on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="concordat-")
    return _local_dirs[app]


_local_dirs: dict[str, str] = {}
#: Open scopes of this thread or task; other streaming queries have their own.
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("_open_scopes", default=())


def scratch_path(spark: SparkSession, label: str, result: bool = False) -> str:
    """A new path; a ``result`` belongs to the scope around the innermost one."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    scopes = _open_scopes.get()[:-1] if result else _open_scopes.get()
    if scopes:
        scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside the block when it ends, but
    for results. What is used after the block must have been written as one."""
    made: list[str] = []
    before = _open_scopes.set((*_open_scopes.get(), made))
    try:
        yield
    finally:
        _open_scopes.reset(before)
        for path in made:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, label: str = "stage", result: bool = False, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result has no lineage beyond the files, survives lost executors, and
    carries real size statistics, so Catalyst broadcasts it only when it is
    measurably small. Columnar files keep column pruning for later readers.
    The shuffle files behind it go at once; a ``result`` outlives the innermost
    :func:`scratch_scope`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, result)
    with _shuffles_freed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
