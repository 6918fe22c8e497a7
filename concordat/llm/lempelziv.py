"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases, each the shortest run of characters that isn't a
phrase yet; the phrases' hashes form a set, of which the fingerprint keeps the
``SIZE`` smallest (all, for short texts) as hex digits. The likeness of two
fingerprints estimates the Jaccard similarity of the phrase sets, which is high
where one text helps to compress the other. It is exact for texts of at most
``SIZE`` phrases each. Equal texts have equal fingerprints; two empty ones have
likeness 1, an empty one and another 0.

:func:`with_neighbour` compares each text with an edited form and with the next
document in order of id. Rows are dealt into runs of ids, each of which also
gets the first row of the following run, so no order over all rows is needed and
a run is read as a stream. Null texts are empty. Null ids come first; rows that
share an id stand in order of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.arrow import added, slices, spread, with_columns
from concordat.llm.grams import U, _factors, mix

SIZE = 128
SLICE_BYTES = 400_000
RUN_ROWS = 4096
MAX_RUNS = 20_000


def parse(text: str, seen: set[str], part: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` in order, and the unfinished one at its end.
    ``seen`` gets the phrases; ``part`` was left unfinished before."""
    out = []
    add, new = out.append, seen.add
    for c in text:
        part += c
        if part not in seen:
            new(part)
            add(part)
            part = ""
    return out, part


def hash_phrases(phrases: list[str]) -> np.ndarray:
    """32-bit hashes of non-empty phrases."""
    if not phrases:
        return np.zeros(0, np.uint32)
    lens = np.fromiter(map(len, phrases), np.int64, len(phrases))
    points = np.frombuffer("".join(phrases).encode("utf-32-le"), "<u4").astype(U)
    factors = _factors(1 << max(4, int(lens.max()).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((points + U(1)) * factors[spread(np.zeros(len(lens)), lens)], np.cumsum(lens) - lens)
        return (mix(sums + lens.astype(U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    h = np.unique(hashes) if len(hashes) <= 4 * size else np.unique(np.partition(hashes, 2 * size)[:2 * size])
    return h[:size] if len(h) >= size else np.unique(hashes)[:size]


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the smallest hashes of the union that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def _fingerprints(text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [to_text(smallest(hash_phrases(parse(t or "", set())[0]), size)) for t in batch.column(text).to_pylist()]
            yield with_columns(batch, fingerprint=pa.array(out, pa.string()))
    return run


def fingerprints(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``fingerprint``."""
    return docs.mapInArrow(_fingerprints(text, size), added(docs.schema, fingerprint=T.StringType()))


def _compare(rows: list[tuple], share: int, size: int) -> pa.RecordBatch:
    """All rows but the last, which is only the neighbour of the one before."""
    prefix, tails, edits, edited, counts = [], [], [], [], []
    for (_, t), (_, following) in zip(rows, rows[1:], strict=False):
        k = len(t) // share
        head, tail, other = t[:len(t) - k], t[len(t) - k:], following[:k]
        seen: set[str] = set()
        first, left = parse(head, seen)
        own, _ = parse(tail, seen, left)
        seen.difference_update(own)
        changed, _ = parse(other, seen, left)
        prefix.append(first)
        tails.append(own)
        edits.append(changed)
        edited.append(hashlib.sha256((head + other).encode()).hexdigest())
        counts.append(len(t))
    last = parse(rows[-1][1], set())[0]
    parts = [*prefix, *tails, *edits, last]
    ends = np.cumsum([len(p) for p in parts])
    hashes = np.split(hash_phrases([x for p in parts for x in p]), ends[:-1])
    n = len(prefix)
    own = [smallest(np.concatenate([hashes[i], hashes[n + i]]), size) for i in range(n)]
    changed = [smallest(np.concatenate([hashes[i], hashes[2 * n + i]]), size) for i in range(n)]
    following = [*own[1:], smallest(hashes[-1], size)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows[:-1]]), pa.array(counts, pa.int64()), pa.array(edited, pa.string()),
         pa.array(map(to_text, own), pa.string()), pa.array(map(to_text, changed), pa.string()),
         pa.array([likeness(a, b, size) for a, b in zip(own, changed, strict=True)], pa.float64()),
         pa.array([likeness(a, b, size) for a, b in zip(own, following, strict=True)], pa.float64())],
        names=["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _neighbours(share: int, size: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held, done = None, [], 0, False

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                out = _compare(rows, share, size)
                yield out.set_column(0, "doc", out.column(0).cast(kind))
                del rows[:-1]

        for batch in batches:
            for piece in slices(iter([batch]), "text", SLICE_BYTES):
                for g, guest, doc, text in zip(*(piece.column(c).to_pylist() for c in ("group", "guest", "doc", "text")), strict=True):
                    if g != group:
                        yield from flush()
                        group, done, held = g, False, 0
                        rows.clear()
                    if done:
                        continue
                    done = guest
                    rows.append((doc, text or ""))
                    held += len(text or "")
                    if held >= SLICE_BYTES and len(rows) > 1:
                        yield from flush()
                        held = len(text or "")
        yield from flush()
    return run


def _deal(borders: np.ndarray, nulls: bool):
    """Rows with their run; the first row of each run also closes the run before,
    and the very first one the last run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            missing = np.asarray(doc.is_null())
            ids = np.asarray(doc.fill_null(int(borders[0]) if len(borders) else 0), dtype=np.int64)
            group = np.maximum(np.searchsorted(borders, ids, side="right") - 1, 0)
            group[missing] = 0
            opens = (borders[group] == ids) & ~missing if len(borders) else np.zeros(len(ids), bool)
            guest = np.where(missing | (opens & (group == 0) & (not nulls)), max(len(borders) - 1, 0), group - 1)
            also = np.flatnonzero(missing | (opens & ((group > 0) | (not nulls))))
            every = np.concatenate([np.arange(len(ids)), also])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([group, guest[also]]).astype(np.int32)), pa.array(np.arange(len(every)) >= len(ids)),
                 doc.take(pa.array(every)), batch.column("text").take(pa.array(every))], names=["group", "guest", "doc", "text"])
    return run


def with_neighbour(docs: DataFrame, doc: str = "doc_id", text: str = "text", share: int = 4, size: int = SIZE, run_rows: int = RUN_ROWS) -> DataFrame:
    """``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has its last ``1/share`` replaced by as many
    first characters of the next document. Ids are whole numbers."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    counts = rows.agg(F.count("doc").alias("n"), F.sum(F.col("doc").isNull().cast("int")).alias("nulls"), F.min("doc").alias("first")).first()
    runs = min(MAX_RUNS, max(1, counts["n"] // run_rows))
    borders = []
    if counts["n"]:
        at = [i / runs for i in range(1, runs)]
        inner = rows.agg(F.percentile_approx("doc", at, max(10_000, 10 * runs)).alias("p")).first()["p"] if at else []
        borders = sorted({counts["first"], *inner})
    dealt = rows.mapInArrow(_deal(np.array(borders, np.int64), bool(counts["nulls"])), "group int, guest boolean, doc long, text string")
    return (dealt.repartition("group").sortWithinPartitions("group", "guest", "doc", "text")
            .mapInArrow(_neighbours(share, size, pa.int64()),
                        "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
