"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import salted_join
from granary.session import Scratch, materialize


def _star(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Each edge (u, v) of ``edges`` with m, the least of u and its neighbours in ``near``; the edges of a node with many are salted."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return salted_join(edges, least, "u", "v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v longs): the least node it is connected with.

    Large-star links the larger neighbours of a node to its least neighbour, small-star the
    smaller ones; what remains is a star around the least node of each component. Both are a
    grouped minimum (partial sums before the shuffle) and a join; every round is written, so
    its lineage is cut and a lost executor does not repeat the rounds before. Null ends and
    loops are dropped, except that a loop still names its node.
    """
    # written first: the edges may be dear, and both the nodes and the first round read them
    work = Scratch(edges.sparkSession, "components")
    both = work.keep(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v"), "edges")
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = work.keep(both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "round")
    mark = None
    for _ in range(rounds):
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(around.filter("v > u"), around).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = work.keep(small.select("e.u", "e.v").filter("u <> v").distinct(), "round")
        work.drop_older("round")
        was, mark = mark, now.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = materialize(nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("label")), "component-labels")
    work.drop()
    return out
