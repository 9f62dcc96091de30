"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, comp) for each node of ``edges(a, b)``; comp is the smallest node it is linked with.

    Alternates large-star and small-star rounds: every node hangs its larger,
    then its smaller neighbours on the smallest one it sees, until the links are
    stars.  Each round is one minimum per node (summed up map-side) and one
    join, so a hub with a third of all links costs no task more than its share
    of a split join.  Self links and repeated links are allowed; an empty table
    gives an empty one.  Links that aren't settled after ``max_rounds``, which is far
    beyond the logarithm of any table's size, raise an error.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        state = _state(edges)
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") >= F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), 2 * state[0])
    else:
        if _state(edges) != before:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
