"""Directory trees on a file system that all executors can see: one that is mounted
on them, or a store that is named by a scheme (``s3``, ``gs``, ``hdfs`` ...), which
tasks open themselves."""

from __future__ import annotations

import hashlib
import os
import stat
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.session import materialize

_COLUMNS = [f.name for f in S.LISTING]
_KINDS = ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"))

#: Rows a listing task hands over at a time; a huge flat directory streams.
BATCH_ROWS = 10_000

# Fixed value: bits of the mode that are kept.
PERM_BITS = 0o777


def _entry(path: str, full: str) -> dict | None:
    try:
        st = os.lstat(full)
        kind = next((k for test, k in _KINDS if test(st.st_mode)), None)
        if kind is None:
            return None
        target = os.readlink(full) if kind == "symlink" else None
        return {"path": path, "kind": kind, "length": st.st_size if kind == "file" else 0,
                "mtime": pd.Timestamp(st.st_mtime_ns // 1_000_000, unit="ms"),
                "perms": st.st_mode & PERM_BITS, "owner": st.st_uid, "grp": st.st_gid,
                "target": target, "error": None}
    except OSError as e:
        return {"path": path, "kind": "file", "error": e.strerror}


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows with typed columns, also where no row has a value."""
    df = pd.DataFrame([dict.fromkeys(_COLUMNS) | row for row in rows], columns=_COLUMNS)
    numbers = dict.fromkeys(("length", "perms", "owner", "grp"), "Int64")
    return df.astype(numbers).assign(mtime=pd.to_datetime(df["mtime"]))


#: Gives a store and the path in it that a root names; called in tasks.
Opener = Callable[[str], tuple[stores.FileSystem, str]]

_KIND_OF = {stores.FileType.File: "file", stores.FileType.Directory: "directory"}


class _Mounted:
    """A tree below a folder on this machine."""

    def __init__(self, root: str):
        self.root = root

    def _full(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def children(self, parent: str) -> Iterator[dict]:
        with os.scandir(self._full(parent)) as found:
            for child in found:
                row = _entry(f"{parent}/{child.name}" if parent else child.name, child.path)
                if row:
                    yield row

    def open(self, path: str) -> BinaryIO:
        return open(self._full(path), "rb")


class _Store:
    """A tree below a path in a store. Stores know neither links nor owners and
    permissions; what is no file and no directory is left out."""

    def __init__(self, store: stores.FileSystem, base: str):
        self.store, self.base = store, base.rstrip("/")

    def _full(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base or "/"

    def children(self, parent: str) -> Iterator[dict]:
        for info in self.store.get_file_info(stores.FileSelector(self._full(parent))):
            kind = _KIND_OF.get(info.type)
            if kind:
                yield {"path": f"{parent}/{info.base_name}" if parent else info.base_name, "kind": kind, "length": info.size or 0,
                       "mtime": pd.Timestamp(info.mtime_ns // 1_000_000, unit="ms") if info.mtime_ns is not None else None}

    def open(self, path: str) -> BinaryIO:
        return self.store.open_input_stream(self._full(path))


def _tree(root: str, opener: Opener | None) -> _Mounted | _Store:
    scheme = re.match(r"([a-zA-Z][-+.\w]*):", root)
    if opener is None and (scheme is None or scheme[1].lower() == "file"):
        return _Mounted(re.sub("^file:/*", "/", root, flags=re.I))
    return _Store(*(opener or stores.FileSystem.from_uri)(root))


def _why(e: OSError) -> str:
    return e.strerror or str(e)


def _list_directories(root: str, opener: Opener | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        tree = _tree(root, opener)
        for batch in batches:
            for parent in batch["path"]:
                try:
                    for row in tree.children(parent):
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS:
                            yield _frame(rows)
                            rows = []
                except OSError as e:
                    rows.append({"path": parent, "kind": "unreadable", "error": _why(e)})
        yield _frame(rows)
    return run


def scan_tree(spark: SparkSession, root: str, tasks: int | None = None, opener: Opener | None = None) -> DataFrame:
    """Listing of everything under ``root``, hidden entries and empty
    directories included; unreadable entries carry an ``error``. Only a root that
    could not be listed has a row itself. A ``root`` with a scheme other than
    ``file`` is opened in the tasks by ``opener`` (by default, by its scheme).

    The tree is listed level by level: the directories of one level are rows
    that Spark spreads over tasks, so no subtree is bound to one task. Each
    level is written to shared scratch space before the next one starts.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    while True:
        listed = frontier.repartition(tasks).mapInPandas(_list_directories(root, opener), S.LISTING)
        level = materialize(listed, "level")
        levels.append(level)
        frontier = level.where((F.col("kind") == "directory") & F.col("error").isNull()).select("path")
        if frontier.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    # A directory that could not be listed is one row with the error.
    failed = found.where(F.col("kind") == "unreadable").select("path", F.col("error").alias("_error"))
    rows = found.where(F.col("kind") != "unreadable").join(failed, "path", "left")
    root_failed = found.where((F.col("kind") == "unreadable") & (F.col("path") == "")).withColumn("kind", F.lit("directory"))
    return rows.withColumn("error", F.coalesce("error", "_error")).drop("_error").unionByName(root_failed)


#: Bytes of a file read at a time.
READ_BYTES = 1 << 20


def _hash_files(root: str, opener: Opener | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = _tree(root, opener)
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with tree.open(path) as f:
                        digest = hashlib.md5()
                        while piece := f.read(READ_BYTES):
                            digest.update(piece)
                    out.append((path, digest.hexdigest(), None))
                except OSError as e:
                    out.append((path, None, _why(e)))
            yield pd.DataFrame(out, columns=["path", "_fp", "_error"])
    return run


def hash_suspects(suspects: DataFrame, root: str, tasks: int | None = None, opener: Opener | None = None) -> DataFrame:
    """Read and hash the suspect files only, in blocks, so file size does not
    matter; unreadable files become error rows. ``root`` and ``opener`` as in
    :func:`scan_tree`."""
    tasks = tasks or suspects.sparkSession.sparkContext.defaultParallelism
    todo = suspects.where("suspect").select("path").repartition(tasks)
    fresh = todo.mapInPandas(_hash_files(root, opener), "path string, _fp string, _error string")
    out = suspects.join(fresh, "path", "left")
    return (out.withColumns({"fp": F.coalesce("fp", "_fp"), "error": F.coalesce("error", "_error")})
            .drop("_fp", "_error", "suspect"))


def file_contents(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of the visible files under a root through Spark's own
    binary reader. It skips hidden names, follows links and holds one file per row; the
    ``content`` column is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    prefix = "file:" + root.rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    return reader.load(root).select(
        F.substring(full, F.lit(len(prefix) + 1), F.length(full)).alias("path"),
        "length", F.col("modificationTime").alias("mtime"), "content")
