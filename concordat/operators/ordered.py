"""Positions and running totals that hold for groups of any size.

A plain window puts a whole group into one task. Here rows are range-sorted
over all tasks, numbered inside bounded pieces, and only one carry record per
piece crosses between them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import materialize

_PIECE, _ROW = "_piece", "_row"


def _sorted_pieces(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    ranged = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    pieces = (ranged.sortWithinPartitions(*order)
              .withColumn(_PIECE, F.spark_partition_id())
              .withColumn(_ROW, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    return materialize(pieces, "sorted")


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position",
                  partitions: int | None = None) -> DataFrame:
    """Number all rows from 1 in the given total order.

    The join with the piece sizes is broadcast: one row per task.
    """
    pieces = _sorted_pieces(df, order, partitions)
    earlier = Window.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.groupBy(_PIECE).count()
              .withColumn("_start", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
              .drop("count"))
    return (pieces.join(F.broadcast(starts), _PIECE)
            .withColumn(name, F.col("_start") + F.col(_ROW) + 1)
            .drop(_PIECE, _ROW, "_start"))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   sums: Mapping[str, Column], partitions: int | None = None) -> DataFrame:
    """Running sums (inclusive) inside each group in the given total order.

    Groups of every size are cut into the sorted pieces; a piece continues at
    most one group, so the carry table has at most one row per task and is
    broadcast.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    steps = {f"_step_{n}": c for n, c in sums.items()}
    keyed = df.withColumns(steps)
    pieces = _sorted_pieces(keyed, [*[F.col(g) for g in group], *order], partitions)
    local = upto(Window.partitionBy(_PIECE, *group).orderBy(_ROW))
    earlier = (Window.partitionBy(*group).orderBy(_PIECE)
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = pieces.groupBy(_PIECE, *group).agg(*[F.sum(s).alias(s) for s in steps])
    carry = (totals
             .withColumn("_prior", F.count(F.lit(1)).over(earlier))
             .withColumns({f"_carry_{n}": F.sum(f"_step_{n}").over(earlier) for n in sums})
             .where(F.col("_prior") > 0)
             .select(_PIECE, *[F.col(g).alias(f"_g_{g}") for g in group],
                     *[f"_carry_{n}" for n in sums]))
    same = F.col(_PIECE) == F.col("_carry_piece")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = (pieces.withColumns({n: F.sum(f"_step_{n}").over(local) for n in sums})
           .join(F.broadcast(carry.withColumnRenamed(_PIECE, "_carry_piece")), same, "left"))
    return (out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums})
            .select(*df.columns, *sums))


def rank_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                   name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row number inside each group, for groups of any size."""
    return running_totals(df, group, order, {name: F.lit(1).cast("long")}, partitions)


def session_starts(df: DataFrame, group: Sequence[str], lo: str, hi: str, gap: int, name: str = "start",
                   partitions: int | None = None) -> DataFrame:
    """For intervals ``lo .. hi`` of each group, which don't overlap, the ``lo`` at
    which their session began: one begins where more than ``gap`` lies behind
    the interval before. Groups of any size; between pieces only the last end
    and the last beginning cross over, one row per piece and broadcast."""
    pieces = _sorted_pieces(df, [*[F.col(g) for g in group], F.col(lo)], partitions)
    inside = Window.partitionBy(_PIECE, *group).orderBy(_ROW)
    earlier = Window.partitionBy(*group).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: str) -> DataFrame:
        """``rows`` with the greatest ``value`` of the group in earlier pieces."""
        last = (rows.groupBy(_PIECE, *group).agg(F.max(value).alias("_last"))
                .select(F.col(_PIECE).alias("_carry_piece"), *[F.col(g).alias(f"_g_{g}") for g in group], F.max("_last").over(earlier).alias("_carry"))
                .where("_carry is not null"))
        same = F.col(_PIECE) == F.col("_carry_piece")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        return rows.join(F.broadcast(last), same, "left").drop("_carry_piece", *[f"_g_{g}" for g in group])

    marked = carried(pieces, hi)
    before = F.coalesce(F.lag(hi).over(inside), F.col("_carry"))
    marked = marked.withColumn("_open", F.when(before.isNull() | (F.col(lo) - before > gap), F.col(lo))).drop("_carry")
    begun = marked.withColumn("_begun", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return carried(begun, "_begun").withColumn(name, F.coalesce("_begun", "_carry")).select(*df.columns, name)
