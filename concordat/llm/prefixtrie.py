"""The trie of conversation prefixes, by sorted shards and a splitter skeleton.

Conversations are rebuilt with the head of their hundred's first one, and become
paths, the digests of their turns in order. Paths are cut into segments of
``SEGMENT`` turns; a segment hangs below a root that stands for everything
before it (four sums of hashes), so no row grows with its conversation.

* A bounded sample of the segments gives splitters, which cut the sorted
  segments (root, path, conversation) into shards. The splitters are broadcast.
* A node whose path is no prefix of a splitter's lies in one shard, which
  finishes it while it walks along its sorted segments with a stack. Copies of
  one path are told apart by the conversation, so they fall into many shards.
* The others, the skeleton, and the roots give partial aggregates in each shard,
  which are summed up per node and then added to all its ancestors.
* Roots below the first form a forest of their own. Their totals climb it by
  doubling, in rounds that grow with the logarithm of its depth, and are then
  added to the nodes above each cut.

The ends of a node are hashed in order of the conversation as they come; of
skeleton nodes they travel as packed runs, one per shard and ``RUN`` ids.

A conversation's turns are all its rows, repeated ones included, in order of
(turn, digest), null turns first. Null roles and texts are empty. Rows without a
conversation id are left out. An empty table has no nodes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.arrow import partitions
from concordat.operators.ordered import rank_in_groups
from concordat.session import materialize

#: Turns of one segment.
SEGMENT = 512
#: Turns that a shard is meant to hold, and sampled segments for each splitter.
SHARD_TURNS = 1_000_000
SAMPLE = 20
#: Ids of one run of ends.
RUN = 8192
HUNDRED, HEADS = 100, 6
#: Bytes of a turn's digest.
WIDTH = 16


def digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the role's length keeps role and text apart."""
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(both, 256), 1, 2 * WIDTH))


def rebuilt(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv, depth, digest, chars``, the turns of rebuilt conversations, and
    ``conv, length`` of all of them, turnless ones included."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = log.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest(by, said).alias("digest"), F.char_length(said).cast("long").alias("chars"))
    placed = materialize(rank_in_groups(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place").drop("turn"), "placed")
    base = F.col("conv") - F.col("conv") % HUNDRED
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    heads = placed.where((F.col("conv") == base) & (F.col("place") < HEADS)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")).withColumnRenamed("conv", "base")
    sizes = placed.groupBy("conv").agg(F.max("place").alias("own")).select("conv", "own", base.alias("base"), h.alias("h"))
    known = materialize(sizes.join(heads, "base", "left").select(
        "conv", "own", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("head")), "heads")
    lengths = known.select("conv", "h", F.size("head").alias("used"), (F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("length"))
    first = known.select("conv", F.posexplode("head").alias("i", "t")).select("conv", (F.col("i") + 1).cast("long").alias("depth"), "t.digest", "t.chars")
    rest = placed.join(lengths, "conv").where("place > h").select("conv", (F.col("used") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars")
    return first.unionByName(rest), lengths.select("conv", "length")


def segments(turns: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """``tier, root, next, path, chars, conv, ends``: what the conversations are
    made of. ``next`` is the root below a full segment that goes on."""
    parts = turns.groupBy("conv", F.expr(f"(depth - 1) div {size}").alias("tier")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("m"))
    parts = parts.select("conv", "tier", F.expr("unhex(array_join(transform(m.digest, x -> hex(x)), ''))").alias("path"), F.col("m.chars").alias("chars"))
    empty = lengths.where("length = 0").select("conv", F.lit(0).cast("long").alias("tier"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("chars"))
    cut = materialize(parts.unionByName(empty).join(lengths, "conv").withColumn("ends", F.col("length") <= (F.col("tier") + 1) * size).drop("length"), "cut")
    upto = Window.partitionBy("conv").orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)
    sums = []
    for i in range(4):
        h = F.xxhash64("tier", "path", F.lit(i // 2))
        sums.append(F.sum(F.shiftrightunsigned(h, 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))).over(upto))
    below = cut.where("not ends").select("conv", "tier", F.concat_ws(".", (F.col("tier") + 1).cast("string"), *sums).alias("next"))
    roots = below.select("conv", (F.col("tier") + 1).alias("tier"), F.col("next").alias("root"))
    return cut.join(roots, ["conv", "tier"], "left").join(below, ["conv", "tier"], "left").select(
        "tier", F.coalesce("root", F.lit("")).alias("root"), "next", "path", "chars", "conv", "ends")


NODE = ("kind string, id long, key binary, parent_key binary, depth long, conv long, parent_conv long, n long, children long, leaves long, saved long, "
        "chars long, root string, next string, first long, blob binary, sha string")
_FIELDS = [f.split()[0] for f in NODE.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_TYPES = [_ARROW[f.split()[1]] for f in NODE.split(", ")]
NO_ENDS = hashlib.sha256().hexdigest()


def _place(splitters: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), batch.column("conv").to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect.bisect_right(splitters, k) for k in keys], pa.int32()))
    return run


class _Node:
    __slots__ = ("id", "key", "conv", "n", "children", "leaves", "saved", "chars", "sha", "ends", "goes_on", "next", "waiting", "cuts")

    def __init__(self, id_: int, key: bytes | None, chars: int):
        self.id, self.key, self.chars = id_, key, chars  # key: skeleton nodes only
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ends, self.goes_on, self.next, self.waiting, self.cuts = None, [], False, None, [], []


def node_key(root: str, path: bytes) -> bytes:
    """A skeleton node's name. The root's length comes first, so that keys of
    one root are prefixes of each other where the paths are."""
    name = root.encode()
    return len(name).to_bytes(2, "big") + name + path


def _walk(splitters: list[tuple], size: int):
    """The nodes of sorted segments, shard by shard."""
    skeleton = set()
    for root, path, _ in splitters:
        for i in range(0, len(path) + 1, WIDTH):
            skeleton.add((root, path[:i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Node] = []
        now, last, made = None, b"", 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_FIELDS)
            out.clear()
            return batch

        def emit(kind: str, **values) -> None:
            out.append((kind, *(values.get(f) for f in _FIELDS[1:])))

        def send_ends(node: _Node) -> None:
            emit("ends", key=node.key, first=node.ends[0], blob=",".join(map(str, node.ends)).encode())
            node.ends = []

        def open_node(root: str, path: bytes, depth: int, chars: int) -> None:
            nonlocal made
            made += 1
            at = path[:WIDTH * depth]
            stack.append(_Node(made, node_key(root, at) if not depth or (root, at) in skeleton else None, chars))

        def close() -> None:
            node, (_, tier, root) = stack.pop(), now
            depth = tier * size + len(stack)
            up = stack[-1] if stack else None
            if node.key is not None:
                if node.ends:
                    send_ends(node)
                emit("skeleton", key=node.key, parent_key=up.key if up else None, depth=depth, conv=node.conv, n=node.n, children=node.children,
                     leaves=node.leaves, saved=node.saved, chars=node.chars, root=root, next=node.next)
                mine = node.key
            else:
                if not node.children and not node.goes_on:
                    node.leaves = 1
                node.saved += (node.n - 1) * node.chars
                row = {"id": shard_base() + node.id, "depth": depth, "conv": node.conv, "n": node.n, "children": node.children, "leaves": node.leaves,
                       "saved": node.saved, "root": root, "next": node.next, "sha": node.sha.hexdigest() if node.sha else NO_ENDS}
                mine = None
                for child in node.waiting:
                    emit("node", parent_conv=node.conv, **child)
                if up.key is not None:
                    emit("node", parent_key=up.key, **row)
                else:
                    up.waiting.append(row)
            if node.next is not None:  # what lies below the cut is added to all nodes above it
                for a in (*stack, node):
                    emit("lift", id=None if a.key is not None else shard_base() + a.id, key=a.key, next=node.next)
            if up is not None:
                up.n += node.n
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
                if mine is None:
                    up.children += 1
                    up.leaves += node.leaves
                    up.saved += node.saved

        def shard_base() -> int:
            return now[0] << 40

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("shard", "tier", "root", "next", "path", "chars", "conv", "ends"))
            for shard, tier, root, below, path, chars, conv, ends in zip(*cols, strict=True):
                if (shard, tier, root) != now:
                    while stack:
                        close()
                    made = 0 if now is None or shard != now[0] else made
                    now, last = (shard, tier, root), b""
                    open_node(root, b"", 0, 0)
                common = len(stack) - 1
                if path != last:
                    common, most = 0, min(len(path), len(last)) // WIDTH
                    while common < most and path[WIDTH * common:WIDTH * common + WIDTH] == last[WIDTH * common:WIDTH * common + WIDTH]:
                        common += 1
                while len(stack) - 1 > common:
                    close()
                for d in range(common + 1, len(path) // WIDTH + 1):
                    open_node(root, path, d, chars[d - 1])
                last, top = path, stack[-1]
                top.n += 1
                top.conv = conv if top.conv is None else min(top.conv, conv)
                if ends and top.key is not None:
                    top.ends.append(conv)
                    if len(top.ends) >= RUN:
                        send_ends(top)
                elif ends:
                    if top.sha is None:
                        top.sha = hashlib.sha256(str(conv).encode())
                    else:
                        top.sha.update(b"," + str(conv).encode())
                else:
                    top.goes_on, top.next = True, below
                if len(out) > 5000:
                    yield flush()
        while stack:
            close()
            if len(out) > 5000:
                yield flush()
        if out:
            yield flush()
    return run


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the runs of each key, which come in order."""
    key, sha = None, None
    for batch in batches:
        keys, shas = [], []
        for k, blob in zip(batch.column("key").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k == key:
                sha.update(b"," + blob)
                continue
            if key is not None:
                keys.append(key)
                shas.append(sha.hexdigest())
            key, sha = k, hashlib.sha256(blob)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends_sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha"])


def _splitters(parts: DataFrame, rows: int, shards: int) -> list[tuple]:
    """At most ``shards`` places between the segments, from a sample of about
    ``SAMPLE`` of them for each; they balance the work and change no result."""
    picked = parts.select("root", "path", "conv", F.size("chars").alias("turns")).sample(min(1.0, shards * SAMPLE / max(1, rows)), seed=7).collect()
    ordered = sorted((r["root"], bytes(r["path"]), r["conv"], r["turns"] + 1) for r in picked)
    weight, total, cuts = 0, sum(r[3] for r in ordered), []
    for root, path, conv, turns in ordered:
        if weight * shards >= (len(cuts) + 1) * total:
            cuts.append((root, path, conv))
        weight += turns
    return cuts


def _totals(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``root, leaves, saved`` with all that lies below: every root's own sums
    climb 1, 2, 4, ... roots at a time."""
    total, jump = roots.select("root", "leaves", "saved"), links.select("root", "up")
    while True:
        jump = materialize(jump, "jump")
        more = total.join(jump, "root").groupBy(F.col("up").alias("root")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        total = materialize(total.join(more, "root", "left").select(
            "root", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "totals")
        jump = jump.join(jump.select(F.col("root").alias("up"), F.col("up").alias("further")), "up").select("root", F.col("further").alias("up"))
        if jump.isEmpty():
            return total


def trie(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``conv, depth, parent_conv, n, children, leaves, saved, ends_sha``, one row per node."""
    turns, lengths = rebuilt(log, conv, turn, role, text)
    parts = materialize(segments(turns, lengths, size), "segments")
    many = parts.agg(F.sum(F.size("chars")).alias("turns"), F.count("*").alias("rows")).first()
    shards = max(partitions(log), -(-((many["turns"] or 0) + many["rows"]) // shard_turns))
    cuts = _splitters(parts, many["rows"], shards)
    placed = parts.mapInArrow(_place(cuts), "tier long, root string, next string, path binary, chars array<long>, conv long, ends boolean, shard int")
    walked = materialize(placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "root", "path", "conv")
                         .mapInArrow(_walk(cuts, size), NODE), "walked")

    ends = walked.where("kind = 'ends'").select("key", "first", "blob").repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_runs, "key binary, ends_sha string")
    partial = walked.where("kind = 'skeleton'").groupBy("key", "parent_key", "depth", "root").agg(
        F.min("conv").alias("conv"), F.max("chars").alias("chars"), F.max("next").alias("next"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
    inner = partial.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    own = materialize(partial.join(inner, "key", "left").join(ends, "key", "left").withColumns({
        "children": F.col("children") + F.coalesce("more", F.lit(0)),
        "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars")}).withColumn(
        "leaves", F.col("leaves") + F.when((F.col("children") == 0) & F.col("next").isNull(), 1).otherwise(0)), "skeleton")
    head = "2 + cast(conv(hex(substring(key, 1, 2)), 16, 10) as int)"  # bytes before the path
    above = own.select(F.explode(F.expr(f"transform(sequence(0, (octet_length(key) - ({head})) div {WIDTH}), i -> substring(key, 1, {head} + {WIDTH} * i))")).alias("key"), "leaves", "saved")
    summed = above.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    bones = materialize(own.drop("leaves", "saved", "more").join(summed, "key"), "bones")

    top = F.expr(f"octet_length(key) = {head} and root <> ''")
    roots = bones.where(top).select("root", "children", "leaves", "saved")
    nodes = walked.where("kind = 'node'").select("id", F.lit(None).cast("binary").alias("key"), "parent_key", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "root", "next", F.col("sha").alias("ends_sha"))
    nodes = nodes.unionByName(bones.where(~top).select(
        F.lit(None).cast("long").alias("id"), "key", "parent_key", "depth", "conv", F.lit(None).cast("long").alias("parent_conv"), "n", "children", "leaves", "saved", "root", "next",
        F.coalesce("ends_sha", F.lit(NO_ENDS)).alias("ends_sha")))
    named = bones.where(~top).select("key", "conv")
    if not roots.isEmpty():
        cut = nodes.where("next is not null").select("root", "next", "conv")
        named = named.unionByName(cut.select(F.concat(F.unhex(F.lpad(F.hex(F.octet_length("next")), 4, "0")), F.col("next").cast("binary")).alias("key"), "conv"))
        total = _totals(roots, cut.where("root <> ''").select(F.col("next").alias("root"), F.col("root").alias("up")))
        lifted = walked.where("kind = 'lift'").select("id", "key", F.col("next").alias("root")).distinct().join(total, "root").groupBy("id", "key").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        lifted = materialize(lifted, "lifted")
        for name in ("id", "key"):
            add = lifted.where(F.col(name).isNotNull()).select(name, "more_leaves", "more_saved")
            nodes = nodes.join(add, name, "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved")
        nodes = nodes.join(roots.select(F.col("root").alias("next"), F.col("children").alias("more")), "next", "left").withColumn(
            "children", F.col("children") + F.coalesce("more", F.lit(0)))
    of_parent = named.select(F.col("key").alias("parent_key"), F.col("conv").alias("up"))
    return nodes.join(of_parent, "parent_key", "left").select(
        "conv", "depth", F.coalesce("parent_conv", "up").alias("parent_conv"), "n", "children", "leaves", "saved", "ends_sha")


SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % {HUNDRED} AS base, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % {HEADS} AS h
  FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT h.*, least(h, (SELECT count(*) FROM t WHERE t.c = h.base)) AS used FROM h),
own AS (
  SELECT k.c, i AS d, r, x FROM k JOIN t ON t.c = k.base AND t.i <= k.h
  UNION ALL SELECT k.c, k.used + i - k.h, r, x FROM k JOIN t ON t.c = k.c AND t.i > k.h),
path AS (SELECT k.c, coalesce(any_value(p), []) AS p, coalesce(any_value(l), []) AS l FROM k LEFT JOIN (
  SELECT c, list(length(r) || ':' || r || x ORDER BY d) AS p, list(length(x) ORDER BY d) AS l FROM own GROUP BY c) USING (c) GROUP BY k.c),
prefix AS (SELECT c, d, list_slice(p, 1, d) AS q, l[d] AS chars, len(p) = d AS ends FROM path, unnest(range(0, len(p) + 1)) AS u(d)),
node AS (
  SELECT q, d, min(c) AS c, count(*) AS n, coalesce(any_value(chars), 0) AS chars,
    sha256(coalesce(array_to_string(list(c::VARCHAR ORDER BY c) FILTER (WHERE ends), ','), '')) AS ends FROM prefix GROUP BY q, d),
kids AS (SELECT list_slice(q, 1, d - 1) AS q, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids, (n - 1) * chars AS saved FROM node LEFT JOIN kids USING (q)),
sums AS (SELECT list_slice(q, 1, a) AS q, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM full_node, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sums s USING (q) LEFT JOIN node up ON f.d > 0 AND up.q = list_slice(f.q, 1, f.d - 1)
"""
