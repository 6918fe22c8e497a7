"""Connected components of a graph given as edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.session import materialize

#: Edges, or other small rows, that one task may take.
TASK_ROWS = 100_000


def in_fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` small rows at most, in as many tasks as
    they need, but no fewer than the cluster runs at once."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))


def _tied_to_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that they reach: the
    same components with a path of one edge."""
    up, values, schema = {}, {}, None

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        schema = batch.schema
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = (tuple((v is not None, v) for v in x.values()) if isinstance(x, dict) else x for x in pair)
            for x, value in ((a, pair[0]), (b, pair[1])):
                if x not in up:
                    up[x], values[x] = x, value
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if up[x] != x]
    for i in range(0, len(nodes), 10_000):
        some = nodes[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([values[x] for x in some], schema.field("a").type),
                                          pa.array([values[root(x)] for x in some], schema.field("b").type)], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Every node is a centre or tied to one centre alone: no further round
    would change anything."""
    ends = (edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre"))
            .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre"))))
    others = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied + centre > 1")
    return not others.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that edges ``a, b`` reach.

    Alternates two steps until all components are stars: every node ties its larger
    neighbours to its smallest neighbour (large star), then its smaller
    neighbours and itself to the smallest (small star). The number of rounds
    grows with the logarithm of the longest path. A node's neighbours are never
    collected; each step is a minimum per node and a join on the node. After
    each round the edges of a task become paths of one edge, which saves rounds.
    """
    downward = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = downward(edges)
    schema = edges.schema
    short = lambda e, label: materialize(downward(in_fewer_tasks(e, rows).mapInArrow(_tied_to_roots, schema)), label)
    rows = edges.count()
    now = materialize(in_fewer_tasks(edges.distinct(), rows), "edges")
    while not _stars(now):
        all_ways = both(now)
        least = all_ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = all_ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(in_fewer_tasks(large, rows), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = short(small, "small_star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
