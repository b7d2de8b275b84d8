"""Connected components by alternating star contractions, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charta.llm.workdir import written


#: Edges up to this number, counted, have the table of smallest neighbours (two numbers a node) broadcast.
BROADCAST_EDGES = 200_000


def _hooked(edges: DataFrame, own: bool, few: bool) -> DataFrame:
    """Hook neighbours to the smallest node beside them.

    ``edges`` (hi, lo), hi > lo. own=False: every larger neighbour of a node goes to the smallest of
    the node and its neighbours. own=True: a node and its smaller neighbours go to the smallest one.
    few: the smallest neighbours are broadcast; else they are written, so that the join reads two
    plain shuffles and a hot node's edges can be split between tasks.
    """
    near = F.broadcast if few else lambda df: written(df, "least")
    if own:
        least = near(edges.groupBy("hi").agg(F.min("lo").alias("to")))
        return (
            edges.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("to").alias("lo")), F.struct("hi", F.col("to").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .filter("hi <> lo")
            .distinct()
        )
    both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
    least = near(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("to").alias("lo")).filter("hi <> lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long): the smallest node it reaches.

    The number of rounds grows with the logarithm of the longest chain. Each round is written to the
    shared folder; only two totals of it come to the driver. Nulls and self-links are left out.
    """
    now = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    few, mark = now.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES, None
    while True:
        now = written(_hooked(_hooked(now, False, few), True, few), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("component")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("component")))).alias("e")).select("e.node", "e.component").distinct()
