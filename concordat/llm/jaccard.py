"""Exact Jaccard join of word-shingle sets, and its connected components.

The method is a universe-partition pigeonhole:

* Equal sets are one class, so a group of copies is one record.
* Sizes are cut into bands such that linked sets lie in one band or in two
  neighbouring ones. In a band, linked sets differ in at most H shingles.
* The universe of shingles is hashed into ``H + 1 + r`` segments per band, so
  at least ``r + 1`` segments of two linked sets are equal. r allows for
  segments that are empty in both sets: empty segments aren't indexed, except
  those of the rare sets that have more than r of them.
* Sets that share a segment meet in a bucket. Candidates are a star around the
  bucket's smallest member, first within each batch of rows and then among the
  batches, so a bucket of n members gives n - 1 pairs, and its key travels once
  per batch.
* Candidates are verified on the whole sets, in rounds, until no unverified one
  joins two components. A bucket that is then connected is done: pairs that it
  doesn't list change no component.
* A bucket with several components costs more than it gives, unless it has two
  members only, whose one pair is known. A member with s such buckets and e empty
  segments has no unseen link while ``s + e <= r``: a linked set shares more
  segments. Such members drop out, with them buckets whose other members are of
  one component, and so on.
* Those that are left move their failed buckets' credit to others (the
  cost-based allocation): at most
  ``s + e - r - 1`` of the segments that differ do so by two or more shingles,
  so among any ``s + e - r`` of the remaining segments one differs by a single
  shingle. The member probes the first ones with their one-deletion
  neighbourhoods, and the others of its buckets are indexed as far as that
  reaches. Where too few segments remain, members look in the failed buckets
  themselves; a pair that meets in several of them is made in the first one
  only, as far as the smallest failed keys of both tell.
* Candidates must pass a parity sketch (the number of differing bits never
  exceeds the number of differing shingles) before texts are fetched for them.

Texts without words have empty sets and link with nothing. Rows with a null id
get a null component. Rows that share an id are told apart by their sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.arrow import partitions, slices
from concordat.llm.components import components, in_fewer_tasks
from concordat.llm.grams import U, mix, shingles, word_hashes
from concordat.session import materialize, scratch_scope

SLICE_BYTES = 500_000
SKETCH = 256
#: Keys of one range, which a task holds together.
PART_KEYS = 1_000_000
#: Keys that a task puts in order at once.
BATCH_KEYS = 400_000
#: Bytes of texts whose sets a task keeps while it verifies.
KNOWN_BYTES = 16_000_000
#: Smallest failed keys that a row carries to tell where its pairs met before.
#: More of them save repeated pairs, which are dropped afterwards anyway.
MET_BEFORE = 16
_ALL = (1 << 64) - 1


@lru_cache(4)
def bands(num: int, den: int, top: int = 1 << 26) -> list[tuple[int, int, int]]:
    """``(smallest size, segments, r)`` of each band for a threshold ``num / den``."""
    out, low = [], 1
    while low < top:
        high = low * den // num
        differ = 2 * high * (den - num) // (den + num)
        least, m, r = low * num // den, differ + 1, 0
        for _ in range(3):
            r = math.ceil(4 * m * math.exp(-least / m)) + 1 if differ else 0
            m = differ + 1 + r
        out.append((low, m if differ else 0, r))
        low = high + 1
    return out


def _cut(s: np.ndarray, num: int, den: int):
    """For each band in which the set takes part: its number, r, each shingle's
    segment, the shingles of each segment, and the hashes that tell."""
    table = bands(num, den)
    own = np.searchsorted([b[0] for b in table], len(s), side="right") - 1
    for band in (int(own), int(own) + 1):
        low, m, r = table[band]
        if not m or (band > own and len(s) * den // num < low):
            continue
        h = mix(s ^ U((band + 1) * 0x9E3779B97F4A7C15 & _ALL))
        seg = ((h >> U(32)) % U(m)).astype(np.int64)
        yield band, r, seg, np.bincount(seg, minlength=m), h


def segments(s: np.ndarray, num: int, den: int):
    """For each band in which the set takes part: its number, r, the key of each
    segment, the shingles of each segment, and each shingle's segment."""
    for band, r, seg, size, h in _cut(s, num, den):
        low_half = np.bincount(seg, (h & U(0xFFFFFFFF)).astype(np.float64), len(size)).astype(U)
        high_half = np.bincount(seg, (h >> U(32)).astype(np.float64), len(size)).astype(U)
        yield band, r, seg, size, low_half + (high_half << U(32)), h


def room(s: np.ndarray, num: int, den: int) -> int:
    """How many failed buckets the set may have without an unseen link, in each band."""
    return min((r - int((size == 0).sum()) for _, r, _, size, _ in _cut(s, num, den)), default=0)


def key_of(band: int, seg: np.ndarray, total: np.ndarray) -> np.ndarray:
    return mix(mix(total) + U(band * 0xC2B2AE3D27D4EB4F & _ALL) + seg.astype(U) * U(0x165667B19E3779F9)).view(np.int64)


def identity(s: np.ndarray) -> tuple[int, int]:
    both = np.array([mix(s).sum(dtype=U), mix(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=U)], U).view(np.int64)
    return int(both[0]), int(both[1])


def sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(s ^ U(77)) >> U(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes:
    """Parity bits, at least twice as many as shingles. The first half xor the
    second is the sketch of half the width."""
    width = 1 << max(8, (2 * len(s) - 1).bit_length())
    place = (mix(s ^ U(78)) >> U(32)).astype(np.int64) & (width - 1)
    bits = (np.bincount(place, minlength=width) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches in the width of the shorter one."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    wide, narrow = 8 * max(len(a), len(b)), 8 * min(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while wide > narrow:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (x ^ y).bit_count()


def sets_of(batch: pa.RecordBatch, text: str, words: int) -> Iterator[np.ndarray]:
    for part in slices(iter([batch]), text, SLICE_BYTES):
        h, counts, _ = word_hashes(part.column(text))
        at = 0
        for n in counts.tolist():
            yield shingles(h[at:at + n], words)
            at += n


def _sets(text: str, doc: str, words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in sets_of(batch, text, words):
                rows.append((len(s), *identity(s), *sketch(s).tolist(), room(s, num, den), wide_sketch(s)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(doc), *(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())],
                                             names=["doc", "n", "c1", "c2", "k0", "k1", "k2", "k3", "room", "wide"])
    return run


def _star(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in order of (key, c) without repeats, and each row's first member."""
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    keep = new.copy()
    keep[1:] |= c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return key[keep], c[keep], c[first][keep], new[keep]


def _keyed(batches: Iterator[pa.RecordBatch], text: str, words: int, num: int, den: int):
    """Keys of the segments of a batch's distinct sets, the place of each one's
    set, and the sets. A batch with more than BATCH_KEYS counts as several."""
    for batch in batches:
        keys, owner, seen, held = [], [], {}, 0
        for s in sets_of(batch, text, words):
            c = identity(s)[0]
            if not len(s) or c in seen:
                continue
            if held > BATCH_KEYS:
                yield keys, owner, seen
                keys, owner, seen, held = [], [], {}, 0
            seen[c] = len(seen)
            for band, r, _, size, total, _ in segments(s, num, den):
                used = np.flatnonzero(size) if (size == 0).sum() <= r else np.arange(len(size))
                keys.append(key_of(band, used, total[used]))
                owner.append((seen[c], len(used)))
                held += len(used)
        if keys:
            yield keys, owner, seen


def _keys(text: str, words: int, num: int, den: int, parts: int):
    """One row per batch and range of keys: the keys in order, as differences,
    with the place of each one's first member among the batch's sets; the keys
    and places of further members and of their firsts; and the places in use, as
    differences, with the sets there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner, seen in _keyed(batches, text, words, num, den):
            key, c, pivot, new = _star(np.concatenate(keys).view(U), np.repeat(*(np.array(x, np.int64) for x in zip(*owner, strict=True))))
            part = ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)  # ranges of keys, so in order too
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            members = np.array(list(seen), np.int64)
            rows = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                k, n, w = key[x:y], new[x:y], c[x:y]
                used = np.unique(w)  # the members that the row refers to
                rows.append((int(part[x]), _pack(np.diff(k[n], prepend=U(0)).view(np.int64)), _pack(w[n]),
                             _pack(np.diff(k[~n], prepend=U(0)).view(np.int64)), _pack(w[~n]), _pack(pivot[x:y][~n]),
                             _pack(np.diff(used, prepend=0)), members[used].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows, strict=True))],
                                             names=["part", *_PACKED])
    return run


_PACKED = ["keys", "firsts", "more_keys", "more", "more_firsts", "used", "members"]


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes are mostly equal."""
    raw = values.astype("<i8").view(np.uint8).reshape(-1, 8)
    width = 8 if not len(values) else max(1, 8 - int(np.argmax(np.append(raw.any(0)[::-1], True))))
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(raw[:, :width].T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<i8").ravel()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of each range of keys, among the firsts of all batches, and the
    stars that the batches had found."""
    part, keys, firsts, pairs = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        all_keys, members = np.concatenate(keys), np.concatenate(firsts)
        keys.clear()
        firsts.clear()
        key, c, first, new = _star(all_keys, members)
        del all_keys, members
        found = [np.stack([key[~new].view(np.int64), c[~new], first[~new]]), *pairs]
        pairs.clear()
        for out in found:
            for i in range(0, out.shape[1], 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out[:, i:i + 500_000]], names=["key", "c", "pivot"])

    for batch in batches:
        for now, *packed, members in zip(*(batch.column(x).to_pylist() for x in ("part", *_PACKED)), strict=True):
            if now != part:
                yield from close()
                part = now
            k, f, mk, m, mf, used = (_unpack(x) for x in packed)
            used, who = np.cumsum(used), np.frombuffer(members, "<i8")
            name = lambda x: who[np.searchsorted(used, x)]  # noqa: B023, E731
            keys.append(np.cumsum(k.view(U), dtype=U))
            firsts.append(name(f))
            pairs.append(np.stack([np.cumsum(mk.view(U), dtype=U).view(np.int64), name(m), name(mf)]))
    yield from close()


def _verify(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known, held = [], {}, 0
            for a, b, ca, cb in zip(*(batch.column(x).to_pylist() for x in ("text_a", "text_b", "a", "b")), strict=True):
                pair = []
                for c, t in ((ca, a), (cb, b)):
                    if (c, t) not in known:
                        held += 4 * len(t or "")
                        if held > KNOWN_BYTES:
                            known, held = {}, 0
                        s = next(sets_of(pa.RecordBatch.from_arrays([pa.array([t], pa.string())], names=["t"]), "t", words))
                        known[c, t] = s if identity(s)[0] == c else s[:0]
                    pair.append(known[c, t])
                x, y = pair
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x) and len(y)) and den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["rep_a", "rep_b", "a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _possible(num: int, den: int):
    """Pairs whose sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b"))
            keep = [bits_apart(x, y) * (den + num) <= (n + m) * (den - num) for x, y, n, m in zip(*cols, strict=True)]
            yield batch.select(["a", "b", "rep_a", "rep_b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _allocations(batch: pa.RecordBatch, words: int, num: int, den: int):
    """For each member of failed buckets and each band where it may have an
    unseen link: what :func:`segments` gives, the failed segments, the segments
    that it probes (the first ones that are neither failed nor empty) and
    whether they are enough."""
    for s, c, failed in zip(sets_of(batch, "text", words), batch.column("c").to_pylist(), batch.column("failed").to_pylist(), strict=True):
        if not len(s) or identity(s)[0] != c:
            continue
        failed = {f["key"]: f.get("reach") or 0 for f in failed}
        names = np.array(list(failed), np.int64)
        for band, r, seg, size, total, h in segments(s, num, den):
            exact = key_of(band, np.arange(len(size)), total)
            bad = np.flatnonzero(np.isin(exact, names))
            need = len(bad) + int((np.delete(size, bad) == 0).sum()) - r
            if not len(bad) or need <= 0:
                continue
            free = size > 0
            free[bad] = False
            free = np.flatnonzero(free)
            # A deletion that leaves nothing has a key that many sets share: such segments come last.
            free = np.concatenate([free[size[free] > 1], free[size[free] == 1]])
            reach = max(failed[k] for k in exact[bad].tolist())
            yield c, band, seg, total, h, exact, bad, free[:need], len(free) >= need, reach


def _reach(words: int, num: int, den: int):
    """How far the members of each failed bucket probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = [(k, int(chosen.max()) + 1 if enough else 0) for _, _, _, _, _, exact, bad, chosen, enough, _ in _allocations(batch, words, num, den)
                    for k in exact[bad].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["key", "reach"])
    return run


def _neighbourhoods(words: int, num: int, den: int):
    """Probes and index rows of members of failed buckets. A member is indexed
    in the segments that others of its buckets probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            rows, lists = [[np.zeros(0, np.int64)] for _ in range(5)], [np.zeros(0, np.int64)]
            for c, band, seg, total, h, exact, bad, chosen, enough, reach in _allocations(batch, words, num, den):
                less = key_of(band, seg, total[seg] - h)
                # role: 0 stands in the index as it is, 1 with a deletion; 2 and 3 look for 0 and 1
                found = [(0, exact[:reach]), (0, exact[bad[bad >= reach]]), (1, less[seg < reach])]
                if enough:
                    found += [(3, exact[chosen]), (2, less[np.isin(seg, chosen)])]
                else:  # too few segments are left: the failed buckets themselves
                    found.append((2, exact[bad]))
                failed = np.sort(exact[bad])
                low = failed[:MET_BEFORE]
                for role, keys in found:
                    open_ = np.isin(keys, failed) & (role == 0 or (role == 2 and not enough))
                    met = np.where(open_, np.searchsorted(low, keys), 0)
                    for out, x in zip(rows, (keys, np.full(len(keys), c), np.full(len(keys), role), open_ & (not enough), met), strict=True):
                        out.append(x)
                    lists += [low[:n] for n in met.tolist()]
            key, c, role, asks, met = (np.concatenate(x).astype(np.int64) for x in rows)
            before = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(met)]).astype(np.int32), np.concatenate(lists))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(role), pa.array(asks.astype(bool)), before],
                                             names=["key", "c", "role", "asks", "before"])
    return run


def _could_link(num: int, den: int) -> Column:
    """Sizes and sketches of two sets, in columns with suffix _a and _b, allow a link."""
    bits = sum((F.bit_count(F.col(f"k{i}_a").bitwiseXOR(F.col(f"k{i}_b"))) for i in range(1, 4)), F.bit_count(F.col("k0_a").bitwiseXOR(F.col("k0_b"))))
    n = F.col("n_a") + F.col("n_b")
    return ((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (bits * (den + num) <= n * (den - num)))


def _open(members: DataFrame, least: int) -> DataFrame:
    """Rows of buckets with several components and at least ``least`` members."""
    found = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    return members.join(found.where(f"x < y and n >= {least}").select("key"), "key", "left_semi")


def _unsettled(members: DataFrame) -> DataFrame:
    """``c, component, failed``: members that may have unseen links, with the
    failed buckets in which these would be. ``members`` has all members of each
    bucket ``key``, once. They drop out in rounds, as long as a tenth goes."""
    left = materialize(_open(members, 3), "failed")
    now = left.count()
    while now:
        before = now
        few = left.groupBy("c", "room").count().where("count <= room").select("c")
        left = materialize(_open(left.join(few, "c", "left_anti"), 2), "failed")
        now = left.count()
        if now > 0.9 * before:
            break
    return left.groupBy("c", "component").agg(F.collect_set(F.struct("key")).alias("failed"))


def neighbourhoods(affected: DataFrame, rows: DataFrame, words: int, num: int, den: int, parts: int) -> DataFrame:
    """``key, c, role`` of the members of failed buckets; ``asks`` where the
    member looks in the failed bucket ``key`` itself, and ``before``, the smaller
    ones among its smallest failed keys."""
    near = affected.join(rows, affected.rep == rows.doc).select("c", "text", "failed").repartition(parts, "c")
    reach = near.mapInArrow(_reach(words, num, den), "key long, reach long").groupBy("key").agg(F.max("reach").alias("reach"))
    reach = materialize(reach, "reach")  # texts are on the way once at a time
    named = affected.select("c", F.explode("failed.key").alias("key")).join(reach, "key", "left")
    reached = named.groupBy("c").agg(F.collect_set(F.struct("key", "reach")).alias("failed"))
    return materialize(near.select("c", "text").join(reached, "c").mapInArrow(_neighbourhoods(words, num, den), "key long, c long, role long, asks boolean, before array<long>"), "neighbourhoods")


def _components_of(classes: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return classes.select("c1", "rep", "room", F.col("rep").alias("component"))
    return (classes.join(label, classes.rep == label.node, "left")
            .select("c1", "rep", "room", F.coalesce("component", "rep").alias("component")))


def _settle(near: DataFrame, verified: Callable[[DataFrame], DataFrame], label: DataFrame | None = None) -> DataFrame | None:
    """Verify candidates until none is left that could join two components: in
    each round the first few open ones of each set (one, then four times as
    many), so that sets which are connected already aren't compared over and
    over. Returns the components; those known are stars already, so further
    links take few rounds."""
    done, few, pairs = None, 1, near.count()
    while True:
        open_ = near
        if label is not None:
            for x in ("a", "b"):
                open_ = open_.join(label.select(F.col("node").alias(f"rep_{x}"), F.col("component").alias(f"in_{x}")), f"rep_{x}", "left")
            open_ = open_.where(F.coalesce("in_a", "rep_a") != F.coalesce("in_b", "rep_b")).select(near.columns)
        if done is not None:
            open_ = open_.join(done, ["a", "b"], "left_anti")
        first = F.row_number().over(Window.partitionBy("b").orderBy("a", "rep_a", "rep_b"))
        picked = open_.withColumn("_i", first).where(F.col("_i") <= few).select(near.columns)
        picked = materialize(in_fewer_tasks(picked, pairs), "picked")
        if picked.isEmpty():
            return label
        found = verified(picked)
        if not found.isEmpty():
            links = found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
            label = components(links if label is None else links.union(label.select("node", "component")))
        done = picked.select("a", "b") if done is None else materialize(in_fewer_tasks(done.union(picked.select("a", "b")), pairs), "verified")
        few *= 4


def link_sets(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5,
              threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``doc, n, component``: each row's id, set size, and the smallest id that
    links reach. ``threshold`` is a fraction."""
    num, den = threshold
    g = math.gcd(num, den)
    num, den = num // g, den // g
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    sets = materialize(rows.mapInArrow(_sets("text", "doc", words, num, den), f"doc {rows.schema['doc'].dataType.simpleString()}, n long, c1 long, c2 long, k0 long, k1 long, k2 long, k3 long, room long, wide binary"), "sets")
    with scratch_scope(docs.sparkSession):
        final = materialize(_class_components(rows, sets, words, num, den), "class_components", result=True)
    return (sets.select("doc", "n", "c1", "c2").join(final, ["c1", "c2", "n"], "left")
            .select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component")))


def _class_components(rows: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``c1, c2, n, component`` of each class of equal sets."""
    classes = materialize(sets.where("n > 0").groupBy("c1", "c2", "n", "k0", "k1", "k2", "k3").agg(F.min("doc").alias("rep"), F.min("wide").alias("wide"), F.min("room").alias("room")), "classes")
    shingles_in_all = sets.agg(F.sum("n")).first()[0] or 0
    keys_in_all = 4 * shingles_in_all * (den - num) / (den + num) * den / num + 4 * classes.count()  # about
    parts = max(partitions(rows), math.ceil(keys_in_all / PART_KEYS))
    stars = materialize(rows.select("text").mapInArrow(_keys("text", words, num, den, parts), f"part int, {', '.join(f'{c} binary' for c in _PACKED)}")
                        .repartition(parts, "part").sortWithinPartitions("part")
                        .mapInArrow(_buckets, "key long, c long, pivot long"), "stars")
    kind = rows.schema["doc"].dataType.simpleString()
    side = lambda x: classes.select(F.col("c1").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in ("n", "wide", "rep")))
    could = lambda pairs, label: materialize(
        pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        .mapInArrow(_possible(num, den), f"a long, b long, rep_a {kind}, rep_b {kind}"), label)
    pairs = materialize(stars.select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct(), "pairs")
    check = _verify(words, num, den)

    def texts(reps: DataFrame) -> DataFrame:
        """The rows with one of these ids."""
        return materialize(rows.join(reps.distinct(), "doc", "left_semi"), "texts", compression="zstd")

    def verified(candidates: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Tells which pairs are links, by their whole texts."""
        known = texts(candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("doc")))

        def links(picked: DataFrame) -> DataFrame:
            full = (picked.join(known.select(F.col("doc").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
                    .join(known.select(F.col("doc").alias("rep_b"), F.col("text").alias("text_b")), "rep_b"))
            found = full.select("rep_a", "rep_b", "a", "b", "text_a", "text_b").mapInArrow(
                check, f"rep_a {kind}, rep_b {kind}, a long, b long").select("rep_a", "rep_b").distinct()
            return materialize(in_fewer_tasks(found, picked.count()), "links")
        return links

    near = could(pairs, "candidates")
    label = _settle(near, verified(near))
    members = stars.select("key", "c").union(stars.select("key", "pivot")).distinct()
    of_class = _components_of(classes, label)
    affected = materialize(_unsettled(members.join(of_class.select(F.col("c1").alias("c"), "component", "room"), "c"))
                           .join(of_class.select(F.col("c1").alias("c"), "rep"), "c"), "affected")
    if not affected.isEmpty():
        found = neighbourhoods(affected, texts(affected.select(F.col("rep").alias("doc"))), words, num, den, partitions(rows))
        sketches = (affected.select("c", "component").join(classes.withColumnRenamed("c1", "c"), "c"))
        known = lambda x: sketches.select(*(F.col(k).alias(f"{k}_{x}") for k in ("c", "component", "n", "k0", "k1", "k2", "k3")))
        probe = found.where("role >= 2").select("key", "c", (F.col("role") - 2).alias("role"), F.col("asks").alias("asks_a"), F.col("before").alias("before_a"))
        index = found.where("role < 2").join(probe.select("key", "role").distinct(), ["key", "role"], "left_semi")
        probe = probe.join(known("a").withColumnRenamed("c_a", "c"), "c").withColumnRenamed("c", "a")
        index = index.join(known("b").withColumnRenamed("c_b", "c"), "c").withColumnRenamed("c", "b")
        # Of two that look in the same bucket only the smaller one asks, and a pair that met in a smaller key isn't made again.
        again = F.col("asks_a") & ((F.col("asks") & (F.col("a") > F.col("b"))) | F.arrays_overlap("before_a", "before"))
        more = probe.join(index, ["key", "role"]).where((F.col("component_a") != F.col("component_b")) & _could_link(num, den) & ~again)
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = could(more, "more")
        label = _settle(near, verified(near), label)
        of_class = _components_of(classes, label)
    return (classes.select("c1", "c2", "n", "rep").join(of_class.select("rep", "c1", "component"), ["c1", "rep"])
            .select("c1", "c2", "n", "component"))
