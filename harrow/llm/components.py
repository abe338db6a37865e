"""Distributed connected components with DataFrame operations only.

Each round every vertex picks, of itself and its neighbours, the one with the smallest round-seeded hash, and
edges are contracted to the picks. Random priorities shrink paths, stars and cliques alike by a constant
factor a round, so the number of rounds grows with the logarithm of the vertices. Picks are found by a
partially aggregated ``min``, and looked up by joins that spread one vertex's edges, so a vertex with very many edges is not gathered. Every round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, drop_written, spread_join, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = BROADCAST_ROWS) -> DataFrame:
    """(vertex, root) for each vertex that an edge names; vertices of one component share the root.

    Null ends and loops are ignored; repeated edges and either direction are allowed. An empty table of edges
    gives an empty result. Tables of up to ``most`` rows are broadcast. ``root`` is some vertex of the component, not the smallest one.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while not e.isEmpty():
        pick = F.struct(F.xxhash64(F.lit(turn), F.col("w")).alias("h"), F.col("w").alias("w"))
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")), F.struct(F.col("a").alias("v"), F.col("a").alias("w")), F.struct(F.col("b").alias("v"), F.col("b").alias("w")))).alias("x")).select("x.v", "x.w")
        parent = written(both.groupBy("v").agg(F.min(pick).alias("p")).select("v", F.col("p.w").alias("p")), "parents")
        left, right = (parent.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in ("a", "b"))
        joined = spread_join(spread_join(e, left, "a", "inner", most), right, "b", "inner", most).where("pa <> pb")
        smaller = written(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parent.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
        else:
            moved = parent.select(F.col("v").alias("root"), F.col("p").alias("_p"))
            old, labels = labels, written(spread_join(labels, moved, "root", most=most).select("vertex", F.coalesce("_p", "root").alias("root")), "labels")
            if turn > 1:
                drop_written(old)
        drop_written(e)
        e, turn = smaller, turn + 1
    if labels is None:
        labels = e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return labels
