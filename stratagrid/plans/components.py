"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, rounds: int = 60, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) and the smallest node that it can reach. ``edges`` should be a written table.

    Large-star and small-star by turns (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): each is an
    aggregation over the edges and a join with its result, written out by ``keep``, until nothing changes; the number of rounds
    grows with the logarithm. The least nodes are written before they are joined, so that Spark may send them to all tasks
    where they are few, and may split a hub's edges where they are many.
    """
    def star(df: DataFrame, both: bool) -> DataFrame:
        # the hub u of each star, its neighbours v, and m, the least of all
        around = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            around = around.unionByName(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = keep(around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        joined = around.join(least, "u")
        if both:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b"), None
    for _ in range(rounds):
        large = keep(star(now, True), "stars")
        now = keep(star(large, False).where("a > b").distinct(), "stars")
        # edges only move towards smaller nodes, so equal sums and counts mean that nothing has moved
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
