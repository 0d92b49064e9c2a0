"""The trunk: the chain from the global minimum to the root, and labels by an as-of lookup on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import value
from ..storage import stored
from .fixpoint import ancestors
from .ordered import before
from .tree import climb


def trunk_chain(nodes: DataFrame) -> DataFrame:
    """node, f and next: the nodes from the global minimum to the root, each with the one above."""
    lowest = nodes.agg(F.min(value("f", "node")).alias("v")).select(F.col("v.id").alias("id"))
    path = ancestors(nodes.select("node", "saddle"), "node", "saddle", of=lowest).select(F.col("ancestor").alias("node"))
    return nodes.join(path, "node").select("node", "f", F.col("saddle").alias("next"))


def chained(danglings: DataFrame) -> DataFrame:
    """node and next from loose nodes (node, f) put in order: each is linked to the next greater one, the last to none."""
    rows = danglings.select(F.lit(0).alias("grp"), "f", F.col("node").alias("id"), F.lit(True).alias("is_node"))
    return before(rows, descending=True).select(F.col("id").alias("node"), F.col("prev").alias("next"))


def as_of(vertices: DataFrame, chain: DataFrame) -> DataFrame:
    """id and arc: for ``vertices`` (id, f) the greatest node of ``chain`` (node, f) that is not above; null if all are.

    Both go through one order, dealt by ranges; neither side is sent to all tasks or to the driver.
    """
    both = vertices.select(F.lit(0).alias("grp"), "f", "id", F.lit(False).alias("is_node")).unionByName(chain.select(F.lit(0).alias("grp"), "f", F.col("node").alias("id"), F.lit(True).alias("is_node")))
    return before(both).filter("NOT is_node").select("id", F.col("prev").alias("arc"))


def trunk_labels(field: DataFrame, basin: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, arc and arc_value like ``labels_of``: climb to the trunk, then look up on it."""
    chain = stored(trunk_chain(nodes).select("node", "f"), "trunk")
    on = chain.select("node")
    start = field.select("id", "f").join(basin.select("id", F.col("basin").alias("arc")), "id")
    # The trunk's nodes absorb: nothing climbs on from them.
    side = nodes.join(on, "node", "left_anti")
    reached = stored(climb(start, side).join(field.select("id", "f"), "id"), "reached")
    off = reached.join(on, F.col("arc") == F.col("node"), "left_anti").select("id", "arc")
    looked = as_of(reached.join(on, F.col("arc") == F.col("node"), "left_semi").select("id", "f"), chain)
    at = nodes.select(F.col("node").alias("arc"), F.col("f").alias("arc_value"))
    return off.unionByName(looked).join(at, "arc").select("id", "arc", "arc_value")
