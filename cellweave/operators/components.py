"""Connected components by hash-to-min: every node exchanges its cluster with the cluster's least member until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import Stored


def components(edges: DataFrame, part: str, a: str, b: str) -> DataFrame:
    """(part, node, component) of every node of the undirected edges; component is the least node, within `part`.

    A cluster is held as rows (node, member), so no task holds one whole. Rows with a NULL join nothing and are left out; loops
    and repeated edges are welcome. Each round is a table in the shared folder; there are as many as the graph needs, which grows with the
    logarithm of its size.
    """
    e = edges.select(F.col(part).alias("p"), F.col(a).alias("v"), F.col(b).alias("u")).dropna()
    both = e.union(e.select("p", F.col("u"), F.col("v")))
    state = Stored(both.union(both.select("p", "v", F.col("v"))).distinct())
    mark = None
    while True:
        now = state.df.agg(F.count("*"), F.sum(F.xxhash64("p", "v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        least = state.df.groupBy("p", "v").agg(F.min("u").alias("m"))
        told = state.df.join(least, ["p", "v"])
        sent = told.select("p", F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        following = Stored(sent.select("p", "x.v", "x.u").distinct())
        state.drop()
        state = following
    return state.df.groupBy(F.col("p").alias(part), F.col("v").alias("node")).agg(F.min("u").alias("component"))
