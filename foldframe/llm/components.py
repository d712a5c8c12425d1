"""Distributed connected components by alternating large-star and small-star steps.

Each step links every node's neighbours to the smallest of them, so a component becomes a star around
its smallest node after a logarithmic number of rounds.  Every step is a grouped minimum (with
map-side combine, so a hub is one row per task) and a join that AQE splits where a hub is large.  The
edges of a round are written to the shared folder and the round before is dropped; nothing but two
numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch


def _state(e: DataFrame):
    r = e.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v: long, not null, any direction, loops and repeats allowed) -> (node, component).

    Only nodes with an edge to another node are returned; ``component`` is the smallest node reachable.
    """
    e = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "edges")
    state = _state(e)
    while state[0]:
        nxt = scratch.write(_small_star(_large_star(e)), "edges")
        scratch.drop(e)
        e, last, state = nxt, state, _state(nxt)
        if state == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
