"""Connected components of an edge table, in the cluster, with nothing gathered at the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Nodes that a task's own forest holds before it is given out and begun anew.
FOREST_NODES = 1_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (v, u) that join the same nodes as ``edges`` (v, u): each task turns its own into stars around least nodes.

    Tasks get even shares of the edges, whatever their nodes; few edges make one share.
    """

    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars():
            rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["v", "u"])

        for batch in batches:
            for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(v), find(u)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select("v", "u").hint("rebalance").mapInArrow(run, "v long, u long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node with an edge.

    ``edges`` has long columns ``a`` and ``b``. Tasks contract their own edges; where a
    node then has two parents, or a parent has one itself, large-star and small-star
    steps follow, until every edge leads to a root. The steps are partial aggregations
    and equi-joins, so a node with very many neighbours is combined before the exchange
    and split by adaptive skew joins.
    """
    now = cut(contracted(edges.where("a <> b").select(F.col("a").alias("v"), F.col("b").alias("u"))))
    while True:
        several = now.groupBy("v").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo <> hi").select(F.col("v").alias("x"))
        inner = now.join(now.select(F.col("v").alias("u")), "u", "left_semi").select(F.col("u").alias("x"))
        if several.unionByName(inner).isEmpty():
            break
        # Large star: of u's neighbours, those above u point to the least of all of them.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u"))
        # Small star: v and its lower neighbours point to the least of those.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        small = large.join(low, "v").select(F.explode(pairs).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        now = cut(contracted(small))
    children = now.select(F.col("v").alias("node"), F.col("u").alias("root")).distinct()
    return children.unionByName(now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root")))
