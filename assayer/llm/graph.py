"""Connected components by alternating large and small stars.

Both steps are an aggregation (the least neighbour) and a join back to the
edges, so a vertex with very many neighbours is never gathered in one place:
partial sums do the first, and Spark splits skewed joins. Each round is staged.
Each shuffle of a round also costs the driver a thread, a plan and its tasks'
records; so there are few, and a round's go before the next.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import discard, released, shuffle_partitions, staged


EDGES_PER_TASK = 10_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges (u, v), u > v. Large: every larger neighbour of a vertex goes to its least neighbour or itself; small: every smaller one and itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(tasks)
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex that isn't the least of its component, with the least. edges: columns u and v of one ordered type; loops and nulls are left out."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(now, "edges")
    # a small graph takes few tasks: a round has several shuffles, and each would have as many tasks as there are partitions
    tasks = max(2, min(shuffle_partitions(edges.sparkSession), -(-now.count() // EDGES_PER_TASK)))
    for i in count():  # each round brings what isn't a star yet nearer to one, so they end
        before, now = now, staged(_star(_star(now, True, tasks), False, tasks), f"edges-{i}")
        discard(before)
        released(edges.sparkSession)
        # a star: no vertex has two neighbours, none is both an end and a middle
        ends = now.select("u", F.lit(1).alias("n"), F.lit(0).alias("middle")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("middle")))
        held = ends.coalesce(tasks).groupBy("u").agg(F.sum("n").alias("n"), F.max("middle").alias("middle"))
        if held.where("n + middle > 1 and n > 0").coalesce(tasks).isEmpty():
            return now
