"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut

#: So many links or fewer are finished in one task, as 211 small ones cost more than their work.
SMALL = 200_000


def _finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for batch in stream:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """edges(a, b) of longs -> (node, component): component is the smallest node reachable.

    Each round gives the nodes new random ranks, points every node at the neighbour of least rank, itself
    included, follows one pointer more, renames the ends of the edges and drops those that have become
    loops: stars vanish in one round and any graph shrinks by a constant factor. Only minima are taken
    per node: a node with very many edges is combined before the shuffle. What is left when it has come
    down to SMALL links is finished in one task. Nulls and loops are dropped; nodes without edges aren't
    returned.
    """
    small = SMALL if small is None else small
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, turn = None, 0
    while (n := edges.count()) > small:
        turn += 1
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("of"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", rank("a"))["of"].alias("root")))
        to = _follow(to, to)
        roots = to if roots is None else _follow(roots, to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    last = cut(edges.coalesce(1).mapInArrow(_finish, "node long, root long"))
    if roots is None:
        return last.select("node", F.col("root").alias("component"))
    roots = _follow(roots, last)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return cut(roots.join(least, "root").select("node", "component"))


def _follow(roots: DataFrame, to: DataFrame) -> DataFrame:
    up = to.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return cut(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
