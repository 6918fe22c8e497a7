"""Chat logs: snapshots that are prefixes of longer conversations collapse, and
what remains is rendered.

A conversation's turns are its distinct rows in order of (turn, role, text). A
prefix of k turns has a hash, the sums of hashes of (place, role, text) over its
turns, in four parts of 32 bits. A conversation goes when its whole hash is that
of a proper prefix of another, or of an equal conversation with a smaller id.
The smaller side of both anti-joins has one row per hash, so a first turn that
a third of all conversations share is pre-aggregated to one row.

No conversation is gathered: places and running sums are taken inside blocks of
``BLOCK`` turn numbers and the blocks' totals are added in a second step. A
rendered conversation comes in one part for each such block.

Rows without a conversation id are left out. A null role is ``unknown``, a null
text is empty, a null turn stands first. Markers inside texts are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
HASHES = ("s0", "s1", "s2", "s3")
UNKNOWN = "unknown"


def turns(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``conv, block, place, role, text, s0..s3``: places from 1, and the hash of
    the prefix that ends with the turn."""
    rows = log.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(UNKNOWN)).alias("role"),
        F.coalesce(text, F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv", "block").agg(F.count("*").alias("n")).select(
        "conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("place", F.row_number().over(inside)).join(starts, ["conv", "block"])
    placed = placed.withColumn("place", F.col("place") + F.col("start"))
    for i, name in enumerate(HASHES):
        h = F.xxhash64("place", "role", "text", F.lit(i // 2))
        placed = placed.withColumn(name, F.shiftrightunsigned(h, 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF)))
    totals = placed.groupBy("conv", "block").agg(*(F.sum(c).alias(c) for c in HASHES)).select(
        "conv", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in HASHES))
    along = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("conv", "block", "place", "role", "text", *(F.sum(c).over(along).alias(c) for c in HASHES))
    return summed.join(totals, ["conv", "block"]).select(
        "conv", "block", "place", "role", "text", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in HASHES))


def maximal(placed: DataFrame) -> DataFrame:
    """``conv, n``: conversations that are no prefix of a longer one, the
    smallest id of equal ones."""
    whole = placed.groupBy("conv").agg(F.max("place").alias("n"), *(F.max(c).alias(c) for c in HASHES))
    first = whole.groupBy("n", *HASHES).agg(F.min("conv").alias("conv"))
    last = whole.select("conv", "n")
    inner = (placed.select("conv", "place", *HASHES).join(last, "conv").where("place < n")
             .select(F.col("place").alias("n"), *HASHES).distinct())
    return first.join(inner, ["n", *HASHES], "left_anti").select("conv", "n")


def rendered(role: Column, text: Column) -> Column:
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "< |$1| >")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def collapse(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``conv, part, first_place, n_turns, text`` of the maximal conversations."""
    placed = turns(log, conv, turn, role, text, block)
    kept = placed.join(maximal(placed).select("conv"), "conv", "left_semi")
    line = F.struct("place", rendered(F.col("role"), F.col("text")).alias("line"))
    parts = kept.groupBy("conv", F.col("block").alias("part")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return parts.select("conv", "part", F.col("lines")[0]["place"].alias("first_place"), F.size("lines").alias("n_turns"),
                        F.array_join("lines.line", "").alias("text"))


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
conv AS (SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY i) AS turns FROM placed GROUP BY conv_id),
prefix AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM conv, unnest(range(1, n)) AS r(k)),
first AS (SELECT min(conv_id) AS conv_id, turns FROM conv GROUP BY turns),
kept AS (SELECT conv_id FROM first ANTI JOIN prefix USING (turns))
SELECT conv_id, coalesce(floor(turn / {BLOCK}), {-(1 << 40)})::BIGINT AS part, min(i) AS first_place, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '< |\\1| >', 'g') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM placed SEMI JOIN kept USING (conv_id) GROUP BY ALL
"""
