"""Block deltas between two versions of keyed binary values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import schemas as S
from concordat.functions import blocks as B
from concordat.operators.propagate import source_bytes, source_status

# Fixed value: only larger files are worth a delta.
DELTA_THRESHOLD = 1 << 20


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row, however often the
    function uses it (a nested lambda would repeat the expression)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _block(content: Column, index: Column, size: Column) -> Column:
    return F.substring(content, index * size + 1, size)


def _block_hashes(content: Column, size: Column) -> Column:
    last = F.ceil(F.octet_length(content) / size).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: _bind(
        _block(content, i, size), lambda piece: F.struct(
            i.alias("block_no"), F.octet_length(piece).alias("block_len"), F.md5(piece).alias("strong"))))


def block_signatures(old: DataFrame, key: str = "path", content: str = "content",
                     weak: bool = True) -> DataFrame:
    """Signature rows of the consecutive blocks of each value. Blocks are
    hashed inside the row; the content itself is never exploded. (The outer
    explode keeps the optimizer from testing the array, and so hashing
    everything, once more in a filter; no array here is empty.)"""
    c = F.col(content)
    size = F.col("block_size")
    hashed = _bind(c, lambda x: _bind(
        B.block_size(F.octet_length(x)), lambda n: F.struct(n.alias("n"), _block_hashes(x, n).alias("h"))))
    df = old.where(F.octet_length(c) > 0)
    if weak:
        weak_of = B.block_weak_hashes(c, B.block_size(F.octet_length(c)))
        flat = (df.select(key, hashed.alias("s"), weak_of.alias("w"))
                .select(key, F.col("s.n").alias("block_size"), F.explode_outer(F.arrays_zip(F.col("s.h").alias("h"), "w")).alias("z")))
        return flat.select(key, F.col("z.h.block_no").alias("block_no"), size,
                           F.col("z.h.block_len").alias("block_len"),
                           F.col("z.w").alias("weak"), F.col("z.h.strong").alias("strong"))
    flat = df.select(key, hashed.alias("s")).select(
        key, F.col("s.n").alias("block_size"), F.explode_outer("s.h").alias("h"))
    return flat.select(key, F.col("h.block_no").alias("block_no"), size,
                       F.col("h.block_len").alias("block_len"), F.col("h.strong").alias("strong"))


def _signature_arrays(sigs: DataFrame, key: str) -> DataFrame:
    """Distinct signatures per value, first block of each. Repeated blocks
    collapse before anything is gathered, and a value has at most
    length/block_size distinct ones."""
    distinct = (sigs.groupBy(key, "block_size", "weak", "strong")
                .agg(F.min("block_no").alias("number")))
    return (distinct.groupBy(key, "block_size")
            .agg(F.collect_list(F.struct("weak", "strong", "number")).alias("s"))
            .select(key, "block_size", F.col("s.weak").alias("weak"), F.col("s.strong").alias("strong"),
                    F.col("s.number").alias("number")))


def match_blocks(sigs: DataFrame, new: DataFrame, key: str = "path",
                 content: str = "content") -> DataFrame:
    """Each new value with the places (``m``: offset, block) where blocks of
    its old version occur: left to right, non-overlapping, lowest block number
    among equal ones. Values that are new or shorter than the smallest block
    have none."""
    arrays = _signature_arrays(sigs, key)
    j = new.select(key, F.col(content).alias("content")).join(arrays, key, "left")
    usable = F.col("block_size").isNotNull() & (F.octet_length("content") >= B.MIN_BLOCK)
    none = F.array().cast("array<string>")
    m = B.matching_offsets(
        F.when(usable, F.col("content")).otherwise(F.lit(b"")),
        F.coalesce("block_size", F.lit(B.MIN_BLOCK)),
        F.coalesce("weak", none.cast("array<int>")), F.coalesce("strong", none),
        F.coalesce("number", none.cast("array<int>")))
    return j.select(key, "content", F.coalesce("block_size", F.lit(B.MIN_BLOCK)).alias("block_size"),
                    m.alias("m"))


def delta_tokens(matches: DataFrame, key: str = "path") -> DataFrame:
    """Ordered tokens per value: literal bytes or a reference to an old block.

    The literal before each match and the tail are cut out inside the row.
    """
    c, size, m = F.col("content"), F.col("block_size"), F.col("m")
    token = lambda kind, block, literal: F.struct(
        F.lit(kind).alias("token"), block.cast("int").alias("block_index"),
        literal.cast("binary").alias("literal"))
    end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(
        F.get(m, i - 1)["off"] + size)
    literal = lambda start, stop: token(
        "literal", F.lit(None), F.substring(c, start + 1, stop - start))
    pairs = F.transform(m, lambda x, i: F.array(
        literal(end_before(i), x["off"]), token("block", x["block"], F.lit(None))))
    tail = F.array(literal(end_before(F.size(m)), F.octet_length(c)))
    all_tokens = F.filter(
        F.concat(F.flatten(pairs), tail),
        lambda t: (t["token"] == "block") | (F.octet_length(t["literal"]) > 0))
    rows = matches.select(key, F.posexplode_outer(all_tokens).alias("seq", "t")).where(F.col("seq").isNotNull())
    return rows.select(key, "seq", F.col("t.token").alias("token"),
                       F.col("t.block_index").alias("block_index"),
                       F.when(F.col("t.token") == "block", 1).alias("block_count"),
                       F.col("t.literal").alias("literal"))


def apply_delta(old: DataFrame, tokens: DataFrame, key: str = "path",
                content: str = "content") -> DataFrame:
    """Rebuild the new values. Tokens are gathered per value first, so the old
    content is joined once per value and not once per token. The pieces are
    joined byte by byte: the casts change the type, not the bytes."""
    per_value = (tokens.groupBy(key)
                 .agg(F.sort_array(F.collect_list(
                     F.struct("seq", "block_index", "block_count", "literal"))).alias("t")))
    j = per_value.join(old.select(key, F.col(content).alias("_old")), key, "left")
    piece = lambda t, size: F.coalesce(t["literal"], F.substring(
        F.col("_old"), t["block_index"] * size + 1, t["block_count"] * size))
    rebuilt = _bind(
        B.block_size(F.coalesce(F.octet_length("_old"), F.lit(0))),
        lambda size: F.array_join(F.transform("t", lambda t: piece(t, size).cast("string")), "").cast("binary"))
    return j.select(key, rebuilt.alias("content"))


def delta_stats(tokens: DataFrame, key: str = "path") -> DataFrame:
    """Literal bytes, literal and block tokens per value."""
    return tokens.groupBy(key).agg(
        F.coalesce(F.sum(F.octet_length("literal")), F.lit(0)).cast("long").alias("literal_bytes"),
        F.count(F.when(F.col("token") == "literal", 1)).alias("n_literals"),
        F.coalesce(F.sum("block_count"), F.lit(0)).cast("long").alias("n_blocks"))


def saved_fraction(literal_bytes: Column, total_bytes: Column) -> Column:
    return F.when(total_bytes > 0, 1 - literal_bytes / total_bytes).otherwise(F.lit(0.0))


def delta_candidates(plan: DataFrame, threshold: int = DELTA_THRESHOLD) -> DataFrame:
    """Keys whose transfer could be a delta: a file replaces a file and is
    larger than the threshold."""
    target_kind = F.when(F.col("direction") == S.L2R, F.col("left.prev_kind")).otherwise(
        F.col("right.prev_kind"))
    return plan.where((source_status() == S.MODIFIED) & (source_bytes() > threshold)
                      & (target_kind == "file"))


def shared_blocks(sigs: DataFrame, key: str = "path") -> DataFrame:
    """Blocks that occur in more than one value. Reduced to one row per
    (block, value) first, so a block found everywhere is only counted."""
    once = sigs.groupBy("strong", key).agg(F.count(F.lit(1)).alias("n"), F.max("block_len").alias("len"))
    return (once.groupBy("strong")
            .agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_blocks"),
                 F.max("len").alias("block_len"))
            .where(F.col("n_values") > 1))
