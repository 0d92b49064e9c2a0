"""Distributed connected components by alternating large and small stars, in DataFrame operations.

Each round of a long edge list costs four aggregations and joins over the edges and is checkpointed, so the lineage
stays short and lost executors cost one round. The number of rounds grows with the logarithm of the
largest component. A node with very many neighbours is pre-aggregated (a minimum per node and task)
and otherwise only takes part in joins, which the engine can split. Rounds over few edges cost as many tasks
and shuffle files as rounds over many, so where a caller allows it (``few``) a short list is followed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import components_here
from .common import shared_dir, stored, trimmed

MOST_ROUNDS = 100
#: At most so many edges are followed in one task, some 100 bytes each while they are.
FEW = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least.withColumnRenamed("a", "of"), F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """node and component (the least node) for every node of an edge list, by value order.

    Null ends and loops are left out. A node without an edge to another node has no row. A list of ``few``
    edges or less (with repeats) is followed in one task, in Python; at 0 all is left to the engine.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    if few:
        now = stored(now, "edges", rows=F.count(F.lit(1)))
        if now.metrics["rows"] <= few:
            names = now.select(F.col("a").alias("id"), F.col("b").alias("root")).schema
            here = now.coalesce(1).mapInArrow(lambda batches: trimmed(components_here(batches)), names)
            return stored(here, "components").select(F.col("id").alias("node"), F.col("root").alias("component"))
    now = now.distinct().checkpoint()
    mark = None
    for _ in range(MOST_ROUNDS):
        count, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or (count, total) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (count, total)
        now = _small_star(_large_star(now)).checkpoint()
    raise RuntimeError("components did not settle")
