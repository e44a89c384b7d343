"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, stage

#: Edges that one task takes at once: as soon as no more are left, they need no further rounds.
CHUNK = 1 << 17


def _solved(edges: DataFrame) -> DataFrame:
    """node, root of at most CHUNK edges, by union and find in one task."""

    def run(batches):
        parent: dict = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            a, b = ([tuple(x.values()) for x in c.to_pylist()] if pa.types.is_struct(kind) else c.to_pylist() for c in batch.columns)
            for x, y in zip(a, b, strict=True):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])

    kind = edges.schema["a"].dataType
    return edges.select("a", "b").coalesce(1).mapInArrow(run, T.StructType([T.StructField(c, kind) for c in ("node", "root")]))


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b), of any type that has an order: one root for each component, which is one of its nodes.

    In each round every node moves to the neighbour (or itself) whose hash is least and the edges between merged nodes
    vanish. The hash changes with the round, so paths shrink as fast as stars: rounds grow as the logarithm of the
    nodes. Edges and labels stay in tables, the last round's alone; only their counts reach the driver. CHUNK edges or fewer are
    solved at once, whether they are all or what the rounds have left."""
    if edges.count() <= CHUNK:
        return stage(_solved(edges), "labels")
    left = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    rank = lambda c, k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
    k = 0
    while (n := left.count()) > 2 * CHUNK:  # each edge is there in both directions
        moves = stage(left.groupBy("a").agg(F.min(rank("b", k)).alias("m")).select("a", F.least("m", rank("a", k))["id"].alias("to")), "moves")
        old = labels, left, moves
        labels = stage(labels.join(moves.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = stage(left.join(moves, "a").select(F.col("to").alias("a"), F.col("b")).join(moves.withColumnRenamed("a", "b").withColumnRenamed("to", "c"), "b")
                     .select("a", F.col("c").alias("b")).where("a <> b").distinct(), "edges")
        drop(*old)
        k += 1
    if n:
        old = labels
        labels = stage(labels.join(_solved(left.where("a < b")).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        drop(old)
    drop(left)
    return labels
