"""Connected components of an edge table by large-star and small-star steps.

Edges are rows ``(u, v)`` of 64-bit ids.  Each step is one aggregation and one join whose rows
number no more than the edges; the table is written to the shared folder after each pair of steps,
and the one before it removed.

Results for odd input: loops and rows with a null end link nothing; repeated edges count once; an
empty table gives no rows; columns other than ``u`` and ``v`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least node of its component) for each node that has an edge to a smaller one."""
    table = scratch.save(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:  # each pair of steps moves nodes to smaller ones until nothing changes
        now = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now["n"] == 0 or now == mark:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = scratch.save(_large_star(table), "large")
        mark, old, table = now, table, scratch.save(_small_star(large), "small")
        scratch.drop(large)
        scratch.drop(old)
