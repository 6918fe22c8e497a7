"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``size`` bytes of ``text``; a
    longer text stands alone. The same input gives the same cuts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        run = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes ``starts[i] .. starts[i] + lens[i] - 1`` for all i, one after another."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def offsets(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def int_lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(lens).astype(np.int32)), pa.array(values, type=kind))


def added(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    """``schema`` with further columns, which replace columns of the same name."""
    kept = [f for f in schema.fields if f.name.lower() not in {c.lower() for c in columns}]
    return T.StructType(kept + [T.StructField(k, v) for k, v in columns.items()])


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch for :func:`added`."""
    names = {c.lower() for c in columns}
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns.values()),
                                      names=[batch.schema.names[i] for i in kept] + list(columns))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
