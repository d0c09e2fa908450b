"""Connected components of an edge table by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every step is an aggregation
and an equi-join over narrow rows; the edge table is written to the shared folder after each round, so
lineage stays short and lost executors cost one step. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemill.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialise(both, "star-both")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = materialise(least, "star-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-down")
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges(u, v)`` but the roots, each the least node of its component.

    Nodes are of any type that can be ordered. Self-links and repeated edges are allowed.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select("u", F.col("v").alias("root"))
