"""Connected components of an undirected graph, by contraction rounds that never gather a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id that ``edges`` names; equal ``comp`` means connected. ``comp`` is an opaque long.

    Distributed union-find by contraction: in each round every node is merged into the least hash among itself and its
    neighbours, and the edges are rewritten between the merged nodes, until none is left. Hashing the ids makes the
    order random, so the graph shrinks geometrically, whatever its shape. Minima are pre-aggregated before the shuffle
    and every round's tables are written, so a hub only skews plain joins of scans, which adaptive execution splits.
    """
    h = lambda c: F.xxhash64(F.col(c).cast("long"))  # noqa: E731  on one long a bijection: hashes are as good as ids
    cur = edges.select(h(a).alias("x"), h(b).alias("y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    cur = written(cur, "cc-edges")
    ids = written(edges.select(F.explode(F.array(F.col(a).cast("long"), F.col(b).cast("long"))).alias("id")).distinct().withColumn("x", F.xxhash64("id")), "cc-ids")
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.union(cur.select("y", "x"))
        parent = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("p")), "cc-parents")
        maps.append(parent)
        left = cur.join(parent, "x").select(F.col("p").alias("px"), F.col("y").alias("x"))
        nxt = left.join(parent, "x").select(F.least("px", "p").alias("x"), F.greatest("px", "p").alias("y")).where("x <> y").distinct()
        cur = written(nxt, "cc-edges")
    label = None
    for parent in reversed(maps):
        if label is None:
            label = parent.select("x", F.col("p").alias("comp"))
        else:
            deeper = label.select(F.col("x").alias("p"), "comp")
            label = parent.join(deeper, "p", "left").select("x", F.coalesce("comp", "p").alias("comp"))
        label = written(label, "cc-labels")
    if label is None:
        return ids.select("id", F.col("x").alias("comp"))
    return written(ids.join(label, "x", "left").select("id", F.coalesce("comp", "x").alias("comp")), "cc-components")
