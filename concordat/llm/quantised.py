"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

* A rotation is learned on a sample of at most ``SAMPLE`` unit vectors per
  length: principal axes, then alternating sign codes and the rotation that
  fits them best, so that the bits are balanced. Every vector gets a code of up
  to 64 bits.
* Equal vectors under one label are a class, classes with one code are a cell.
  Codes are cut into tables of about ``PART_BITS`` bits. A cell stands in each
  table as it is and looks there for itself and for all parts that differ in one
  bit, so codes up to ``2 * tables - 1`` bits apart always meet. The index and
  the probes hold codes only; a pair counts in the first table where it meets.
* Vectors of cells that met are compared with each other in tiles of ``TILE``,
  by cosine in double precision. A tile pair gives the number of links of each
  class and a forest over its links, never the pairs.

Links are exact in one direction: none is below the threshold. Those above it
are found unless the codes lie at least ``2 * tables`` bits apart in such a way
that every part differs twice (``tests/llm/test_vectors.py`` measures recall).

Rows without a label, with a null or empty vector, a zero vector, or null or
non-finite components link with nothing. Vectors of different lengths don't
link. Rows with equal or null ids take part as rows of their own; a component's
id is its smallest id that isn't null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.components import components
from concordat.session import materialize

SAMPLE = 8192
ROUNDS = 40
BITS = 64
PART_BITS = 13
#: Vectors of a cell that are compared with those of another at once.
TILE = 64
#: Codes further apart than this share of their bits aren't compared.
FAR = 0.25


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors: principal axes turned so that the
    signs of the projections are as near to them as they can be."""
    dim = x.shape[1]
    bits = min(bits, dim)
    mean = x.mean(0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    z = centred @ axes
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return mean, axes @ turn


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes of unit vectors, as signed 64-bit numbers."""
    mean, projection = model
    on = (x - mean) @ projection > 0
    packed = np.zeros((len(x), 8), np.uint8)
    bits = np.packbits(on, axis=1, bitorder="little")
    packed[:, :bits.shape[1]] = bits
    return packed.view("<i8").ravel()


def tables(bits: int, part: int = PART_BITS) -> list[tuple[int, int]]:
    """First bit and width of each table's part of a code."""
    n = max(1, round(bits / part))
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Place and components of each vector that can link."""
    lists = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    ends, flat = np.asarray(lists.offsets), lists.values
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    for i, ok in enumerate(lists.is_valid().to_pylist()):
        v = values[ends[i]:ends[i + 1]]
        if ok and len(v) and np.isfinite(v).all() and v.any():
            yield i, v


def fit(vectors: DataFrame, vector: str = "embedding", sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A model for each vector length in the sample. The sample is bounded and
    spread evenly by hash; it decides how even the codes are, never which links
    hold."""
    order = F.xxhash64(vector)
    picked = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(order).limit(sample).toArrow()
    by_length: dict[int, list[np.ndarray]] = {}
    for chunk in picked.column(0).chunks:
        for _, v in _usable(chunk):
            by_length.setdefault(len(v), []).append(v)
    return {n: learn(unit(np.stack(vs))) for n, vs in by_length.items()}


def _coded(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            key, code, dim, raw = ([None] * batch.num_rows for _ in range(4))
            by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, v in _usable(batch.column("vector")):
                if labels[i] is not None:
                    by_length.setdefault(len(v), []).append((i, v))
            for n, found in by_length.items():
                if n not in models:  # a length that the sample lacks: an unlearned rotation
                    turn = np.linalg.qr(np.random.default_rng(n).normal(size=(n, min(n, BITS))))[0]
                    models[n] = (np.zeros(n), turn)
                x = np.stack([v for _, v in found]) + 0.0  # no negative zeros
                for (i, _), c, v in zip(found, codes(unit(x), models[n]).tolist(), x, strict=True):
                    raw[i], code[i], dim[i] = v.tobytes(), c, n
                    key[i] = hashlib.blake2b(f"{labels[i]}\n".encode() + raw[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("label"), pa.array(key, pa.binary()), pa.array(code, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())],
                names=["vec", "label", "key", "code", "dim", "raw"])
    return run


def candidates(cells: DataFrame) -> DataFrame:
    """``label, dim, a, b``: pairs of different codes ``a < b`` that meet in a table."""
    dims = [r["dim"] for r in cells.select("dim").distinct().collect()]  # a handful of lengths
    found = []
    for dim in dims:
        bits = min(dim, BITS)
        cuts = tables(bits)
        mine = cells.where(F.col("dim") == dim)
        part = lambda c, t: F.shiftrightunsigned(c, cuts[t][0]).bitwiseAND((1 << cuts[t][1]) - 1)  # noqa: B023, E731
        rows = mine.select("label", "dim", "code", F.explode(F.array(*(
            F.struct(F.lit(t).alias("t"), part(F.col("code"), t).alias("part")) for t in range(len(cuts))))).alias("at")).select("label", "dim", "code", "at.*")
        masks = F.array(*(F.array(F.lit(0), *(F.lit(1 << i) for i in range(w))) for _, w in cuts)).cast("array<array<bigint>>")
        probes = rows.select("label", "dim", "t", F.col("code").alias("a"), "part", F.explode(masks[F.col("t")]).alias("mask")).select(
            "label", "dim", "t", "a", F.col("part").bitwiseXOR(F.col("mask")).alias("part"))
        # neither side is small: what explode adds isn't in Spark's estimate, which would broadcast it
        met = probes.join(rows.withColumnRenamed("code", "b").hint("merge"), ["label", "dim", "t", "part"])
        apart = F.col("a").bitwiseXOR(F.col("b"))
        near = lambda t: F.bit_count(part(apart, t)) <= 1  # noqa: B023, E731
        earlier = F.lit(False)
        for t in range(len(cuts) - 1):
            earlier = earlier | ((F.col("t") > t) & near(t))
        found.append(met.where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= max(2, int(bits * FAR))) & ~earlier)
                     .select("label", "dim", "a", "b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest node that it reaches."""
    least = np.arange(len(linked))
    while True:
        best = np.where(linked, least[None, :], len(linked)).min(1)
        best = np.minimum(best, least)
        best = best[best]
        if (best == least).all():
            return least
        least = best


def _compared(threshold: float):
    """Links of each class in a pair of tiles, and a class of its tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, links, tops = [], [], []
            for dim, same, ka, kb, na, nb, xa, xb in zip(*(batch.column(c).to_pylist() for c in ("dim", "same", "keys_a", "keys_b", "n_a", "n_b", "raw_a", "raw_b")), strict=True):
                x = unit(np.frombuffer(xa, "<f8").reshape(-1, dim))
                y = x if same else unit(np.frombuffer(xb, "<f8").reshape(-1, dim))
                hit = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                if same:
                    names, full, count = ka, hit, hit @ np.array(na)
                else:
                    names = ka + kb
                    full = np.zeros((len(names), len(names)), bool)
                    full[:len(ka), len(ka):] = hit
                    full[len(ka):, :len(ka)] = hit.T
                    count = np.concatenate([hit @ np.array(nb), hit.T @ np.array(na)])
                top = _forest(full)
                for i in np.flatnonzero(count).tolist():
                    keys.append(names[i])
                    links.append(int(count[i]))
                    tops.append(names[top[i]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(tops, pa.binary())], names=["key", "links", "top"])
    return run


def near_vectors(vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """``vec, n_links, component, kept``: one row per row of ``vectors``."""
    rows = vectors.select(F.col(vec).alias("vec"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec", "label")}
    coded = materialize(rows.mapInArrow(_coded(fit(vectors, vector)), f"vec {kinds['vec']}, label {kinds['label']}, key binary, code long, dim int, raw binary"), "coded")
    classes = materialize(coded.where("key is not null").groupBy("label", "dim", "code", "key").agg(
        F.count("*").alias("n"), F.min("vec").alias("least"), F.first("raw").alias("raw")), "classes")
    if classes.isEmpty():
        return coded.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"), F.lit(True).alias("kept"))
    cells = materialize(classes.groupBy("label", "dim", "code").agg(F.count("*").alias("size")), "cells")
    pairs = candidates(cells).unionByName(cells.where("size > 1").select("label", "dim", F.col("code").alias("a"), F.col("code").alias("b")))
    # a class's tile goes by its hash, so that a cell of any size falls into even tiles
    tiled = classes.join(cells, ["label", "dim", "code"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / tile)))
    tiles = materialize(tiled.groupBy("label", "dim", "code", "tile").agg(F.sort_array(F.collect_list(F.struct("key", "n", "raw"))).alias("m")).select(
        "label", "dim", "code", "tile", F.col("m.key").alias("keys"), F.col("m.n").alias("n"), F.expr("unhex(array_join(transform(m.raw, x -> hex(x)), ''))").alias("raw")), "tiles")
    places = tiles.select("label", "dim", "code", "tile")
    side = lambda df, x: df.withColumnsRenamed({"code": x, **{c: f"{c}_{x}" for c in ("tile", "keys", "n", "raw")}})
    meeting = (pairs.join(side(places, "a"), ["label", "dim", "a"]).join(side(places, "b"), ["label", "dim", "b"])
               .where("a <> b or tile_a <= tile_b"))
    full = meeting.join(side(tiles, "a"), ["label", "dim", "a", "tile_a"]).join(side(tiles, "b"), ["label", "dim", "b", "tile_b"])
    found = materialize(full.select("dim", F.expr("a = b and tile_a = tile_b").alias("same"), "keys_a", "keys_b", "n_a", "n_b", "raw_a", "raw_b")
                        .mapInArrow(_compared(threshold), "key binary, links long, top binary"), "compared")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("key").alias("a"), F.col("top").alias("b"))).withColumnRenamed("node", "key")
    of_class = classes.select("key", "n", "least").join(links, "key", "left").join(reached, "key", "left").withColumn("component", F.coalesce("component", "key"))
    of_class = materialize(of_class, "linked")
    smallest = of_class.groupBy("component").agg(F.min("least").alias("smallest"))
    known = of_class.join(smallest, "component").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "smallest")
    return coded.select("vec", "key").join(known, "key", "left").select(
        "vec", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec")).otherwise(F.col("smallest")).alias("component")).withColumn("kept", F.col("vec").eqNullSafe(F.col("component")))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)
  AND list_contains(list_transform(e, lambda x: x <> 0), true)),
links AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b, id FROM links UNION SELECT reach.a, links.b, links.id FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a AS r, min(id) AS least FROM reach GROUP BY a),
out AS (
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, CASE WHEN least IS NULL OR least > vec_id THEN vec_id ELSE least END AS component_id
  FROM v LEFT JOIN n USING (r) LEFT JOIN c USING (r))
SELECT *, vec_id IS NOT DISTINCT FROM component_id AS kept FROM out
"""
