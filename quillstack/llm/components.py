"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

#: Parts into which the rows of one key are dealt out, and rounds at most.
PARTS, ROUNDS = 64, 60


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the least ``value`` of each row's ``key``; the rows of a hot key stand in ``PARTS`` tasks."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(value), F.lit(PARTS)))
    some = dealt.groupBy(key, "part").agg(F.min(value).alias(name))
    whole = some.groupBy(key).agg(F.min(name).alias(name))
    return dealt.join(some.select(key, "part").join(whole, key), [key, "part"]).drop("part")


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``edges`` (a, b: long) -> (node, component: long), component = smallest reachable node.

    Each round points every node at the smallest node next to it, once from above and once from
    below, until the edges are stars around the smallest node. Both steps are a minimum per node
    (summed before the shuffle) and an equi-join whose hot keys are dealt out in parts, so a node
    with very many neighbours does not land in one task. Self links and nulls are ignored. Labels
    that still change after ``ROUNDS`` rounds (their number grows with the logarithm of the nodes) are an error.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = edges.filter("hi <> lo").distinct()
    before = None
    for k in range(ROUNDS):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = with_least(both, "u", "v", "m").filter("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).filter("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))  # as many rows as the node has roots of neighbours, so few after the first round
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct()
        seen = Observation()
        edges = scratch.save(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("hi", "lo").cast("long")).alias("one"), F.sum(F.hash("lo", "hi").cast("long")).alias("two")), f"{name}{k}")
        found = seen.get
        if k:
            scratch.drop(f"{name}{k - 1}")
        if found == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = found
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
