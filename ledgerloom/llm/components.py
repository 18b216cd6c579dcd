"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable.

    Null ends are dropped, loops and repeated edges do no harm, no edges give no rows. Each step joins edges
    with one minimum a node, so a node with very many neighbours is pre-aggregated and never gathered.
    """
    now = common.materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        # large star: every greater neighbour of a node links to the node's smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        # small star: all smaller neighbours of a node and the node itself link to the smallest of them
        small = large.filter("x <> y").groupBy("x").agg(F.min("y").alias("m"))
        joined = large.filter("x <> y").join(small, "x")
        step = joined.select(F.col("m").alias("u"), F.col("y").alias("v")).union(small.select(F.col("m").alias("u"), F.col("x").alias("v"))).filter("u <> v").distinct()
        after = common.materialize(step, "edges")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        common.drop_table(now)
        now = after
        if mark == (seen["n"], seen["s"]):
            break
        mark = (seen["n"], seen["s"])
    else:
        raise RuntimeError("components did not settle")
    own = now.groupBy("v").agg(F.min("u").alias("comp"))
    return own.select(F.col("v").alias("node"), "comp").union(now.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
