"""The join tree: basin graph, spanning tree, arcs and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import value
from ..schema import GridSpec
from ..storage import stored
from .critical import steepest
from .fixpoint import pointer_jump
from .grid import edges

#: Beyond so many basin edges they are cut down to a spanning forest before the ordered merge.
DIRECT_EDGES = 200_000


def basins(field: DataFrame, spec: GridSpec) -> DataFrame:
    """id and basin: the minimum that steepest descent ends in."""
    return pointer_jump(steepest(field, spec)).withColumnRenamed("root", "basin")


def basin_edges(field: DataFrame, spec: GridSpec, basin: DataFrame) -> DataFrame:
    """a, b, f and s, a < b: for neighbouring basins the least vertex at which they are joined.

    An edge of the grid joins two sublevel components when its greater end appears.
    """
    of = lambda end: basin.select(F.col("id").alias(end), F.col("basin").alias(f"b{end}"))
    e = edges(field, spec).join(of("u"), "u").join(of("v"), "v").filter("bu <> bv")
    top = F.greatest(value("fu", "u"), value("fv", "v"))
    made = e.groupBy(F.least("bu", "bv").alias("a"), F.greatest("bu", "bv").alias("b")).agg(F.min(top).alias("w"))
    return made.select("a", "b", F.col("w.f").alias("f"), F.col("w.id").alias("s"))


def spanning_forest(graph: DataFrame) -> DataFrame:
    """The edges of ``graph`` (a, b, f, s) that a minimum spanning forest keeps, ties by (f, s, a, b).

    Boruvka's rounds in DataFrame operations: each component takes its least edge, components that
    are linked by these become one. The order is total, so no round closes a cycle.
    """
    left = stored(graph.select("a", "b", "f", "s", F.col("a").alias("ca"), F.col("b").alias("cb")), "graph", rows=F.count(F.lit(1)))
    kept = None
    key = F.struct("f", "s", "a", "b")
    while left.metrics["rows"]:
        sides = left.select(F.col("ca").alias("c"), key.alias("e"), F.col("cb").alias("to")).union(left.select("cb", key, "ca"))
        least = stored(sides.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e.*", F.col("m.to").alias("to")), "least")
        taken = least.select("a", "b", "f", "s").distinct()
        kept = taken if kept is None else kept.union(taken)
        # Of two components that took one edge the smaller becomes the root; the rest point on.
        back = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
        pointers = least.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        root = pointer_jump(pointers, "c", "p")
        of = lambda n: root.select(F.col("id").alias(f"c{n}"), F.col("root").alias(f"r{n}"))
        left = stored(left.join(of("a"), "ca").join(of("b"), "cb").filter("ra <> rb").select("a", "b", "f", "s", F.col("ra").alias("ca"), F.col("rb").alias("cb")), "graph", rows=F.count(F.lit(1)))
    return stored(kept, "forest") if kept is not None else graph.select("a", "b", "f", "s")


def merge_in_order(a: np.ndarray, b: np.ndarray, s: np.ndarray, f: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Nodes, the saddles above them and these' values, from edges sorted by (f, s).

    The current node of a union is the last saddle that made it. A saddle that joins several
    components at once is one node, so a component whose node is the saddle itself isn't linked again.
    """
    ends, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)].tolist(), places[len(a) :].tolist()
    up, node = list(range(len(ends))), ends.tolist()

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    nodes, saddles, values = [], [], []
    for k, (saddle, height) in enumerate(zip(s.tolist(), f.tolist())):
        one, two = find(left[k]), find(right[k])
        if one == two:
            continue
        for side in (one, two):
            if node[side] != saddle:
                nodes.append(node[side])
                saddles.append(saddle)
                values.append(height)
        up[one] = two
        node[two] = saddle
    return nodes, saddles, values


def merges(graph: DataFrame) -> DataFrame:
    """node, saddle and fs from basin edges; one ordered task, over basins and never over vertices."""
    schema = "node long, saddle long, fs float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).sort_by([("f", "ascending"), ("s", "ascending")])
            made = merge_in_order(*(whole.column(n).to_numpy() for n in ("a", "b", "s", "f")))
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float32())], names=["node", "saddle", "fs"])

    return graph.select("a", "b", "s", "f").coalesce(1).mapInArrow(run, schema)


def node_table(field: DataFrame, basin: DataFrame, graph: DataFrame) -> DataFrame:
    """node, f, saddle, fs (both null for the root) and is_leaf, stored."""
    if graph.count() > DIRECT_EDGES:
        graph = spanning_forest(graph)
    linked = stored(merges(graph), "merges")
    leaves = basin.filter("id = basin").select(F.col("id").alias("node")).join(field.select(F.col("id").alias("node"), "f"), "node").withColumn("is_leaf", F.lit(True))
    inner = linked.select(F.col("saddle").alias("node"), F.col("fs").alias("f")).distinct().withColumn("is_leaf", F.lit(False))
    return stored(leaves.unionByName(inner).join(linked, "node", "left").select("node", "f", "saddle", "fs", "is_leaf"), "nodes")


def arcs_of(nodes: DataFrame) -> DataFrame:
    """extremum, saddle and is_leaf."""
    return nodes.select(F.col("node").alias("extremum"), "saddle", "is_leaf")


def children(arcs: DataFrame) -> DataFrame:
    """saddle and its sorted children."""
    return arcs.filter("saddle IS NOT NULL").groupBy("saddle").agg(F.sort_array(F.collect_set("extremum")).alias("children"))


def saddles(arcs: DataFrame) -> DataFrame:
    """Saddles with the number of arcs that end there."""
    return arcs.filter("saddle IS NOT NULL").groupBy("saddle").agg(F.count(F.lit(1)).alias("arcs"))


def root(arcs: DataFrame) -> DataFrame:
    return arcs.filter("saddle IS NULL").select(F.col("extremum").alias("root"))


def arc_count(arcs: DataFrame) -> DataFrame:
    """Numbers of nodes, of arcs with a saddle, and of leaves."""
    return arcs.agg(F.count(F.lit(1)).alias("nodes"), F.count("saddle").alias("edges"), F.count_if("is_leaf").alias("leaves"))


def climb(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and arc: from ``vertices`` (id, f, arc) up the tree as long as the saddle is not above the vertex.

    Binary lifting: tables of the 1st, 2nd, 4th, ... ancestor, applied from the highest down. A table
    of nodes is broadcast only if its size is below the engine's threshold.
    """
    hop = stored(nodes.filter("saddle IS NOT NULL").select("node", F.col("saddle").alias("up"), F.col("fs").alias("fu")), "hops", rows=F.count(F.lit(1)))
    hops = []
    while hop.metrics["rows"]:
        hops.append(hop)
        far = hop.select(F.col("node").alias("n"), F.col("up").alias("up2"), F.col("fu").alias("fu2"))
        hop = stored(hop.join(far, F.col("up") == F.col("n")).select("node", F.col("up2").alias("up"), F.col("fu2").alias("fu")), "hops", rows=F.count(F.lit(1)))
    now = vertices.select("id", "f", "arc")
    for hop in reversed(hops):
        now = now.join(hop, F.col("arc") == F.col("node"), "left").select("id", "f", F.when(F.col("up").isNotNull() & (value("fu", "up") <= value()), F.col("up")).otherwise(F.col("arc")).alias("arc"))
    return now.select("id", "arc")


def labels_of(field: DataFrame, basin: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, arc and arc_value of every vertex; a node is in its own arc."""
    start = field.select("id", "f").join(basin.select("id", F.col("basin").alias("arc")), "id")
    at = nodes.select(F.col("node").alias("arc"), F.col("f").alias("arc_value"))
    return climb(start, nodes).join(at, "arc").select("id", "arc", "arc_value")


def arc_size(labels: DataFrame) -> DataFrame:
    return labels.groupBy("arc").agg(F.count(F.lit(1)).alias("vertices"))


def arc_members(labels: DataFrame) -> DataFrame:
    """arc and its sorted members; for display, since one arc can hold any number of vertices."""
    return labels.groupBy("arc").agg(F.sort_array(F.collect_list("id")).alias("members"))
